"""Ids by plain forms of parts, and runs of licences without Python workers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import licences
from spanweave.llm.licences import licence_scan
from spanweave.llm.tokens import Encoder, tokenizer_path


def test_encoder_keeps_one_part_for_cases_and_stops():
    """Letters in either case and a last stop or comma share their parts; ids stay the library's."""
    from tokenizers import Tokenizer

    enc, whole = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    enc.ids([b"Abc, abc. ABC abc Abc."])
    assert set(enc.parts) == {b"abc", b",", b"."}
    texts = ["a, b. C,\nd.", "x!, y., z.. ,q .r", "It's. I'll, 3.5a, 7. don't.", "<|endoftext|>, Ab. <|startoftext|> <|ENDOFTEXT|>", "J̌, J̌. H̱ T̈. W̊, Y̊", "KK, İ. İ, Σ. AΣ,", "Été, é. ». a»,", "a. b, a, b. a.\u0085", "a,\r\nb.\tc,\x0bd.\x0c", ".", ",", "a.", "A,"]
    for t, got in zip(texts, enc.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, enc.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_licence_scan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "released under the MIT License")], "doc_id long, text string")
    assert "Python" not in licence_scan(docs)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("starts", [1, 3, 32])
def test_best_of_equals_plain_search(spark, monkeypatch, starts):
    """The search of runs in SQL functions, starts bounded together, against that of each end: Dice, start and end."""
    monkeypatch.setattr(licences, "STARTS", starts)
    rng = np.random.default_rng(starts)
    rows, want = [], []
    for n in range(300):
        row = rng.integers(0, 14, rng.integers(1, 90))
        own, longest = set(rng.choice(14, 6, replace=False).tolist()), int(rng.integers(9, 16))
        prev = np.array([max((k for k in range(j) if row[k] == row[j]), default=-1) for j in range(len(row))])
        hit = np.array([x in own for x in row.tolist()])
        rows.append((n, [(i, int(p), bool(h)) for i, (p, h) in enumerate(zip(prev, hit, strict=True))], (6, 4, longest)))
        want.append(licences._best_run(row, prev, hit, 6, 0.8, longest))
    d = spark.createDataFrame(rows, "n int, hits array<struct<i:int,p:int,h:boolean>>, t struct<size:int,least:int,longest:int>")
    got = {r["n"]: r["r"] and tuple(r["r"]) for r in d.select("n", licences._best_of(F.col("hits"), F.col("t"), 0.8).alias("r")).collect()}
    assert [got[n] for n in range(300)] == want and sum(w is not None for w in want) > 30
