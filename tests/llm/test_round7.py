"""What packing's tasks hold at a time when texts are long or have no white space."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from spanweave.llm.packing import _cut
from spanweave.llm.tokens import Encoder, tokenizer_path


def test_encoder_keeps_bounded_bytes_of_long_parts():
    """Texts without white space are a part each, and distinct; the parts kept are bounded by bytes too, with the same ids."""
    rng = random.Random(7)
    letters = "abcdefgh0123-,.äß" + "一二三四あก"
    texts = ["".join(rng.choices(letters, k=3000)).encode() for _ in range(60)]
    texts += [b"one two, three.", b"".join(texts[:2]), b"", *texts[:5]]
    enc = Encoder(tokenizer_path(), max_bytes=64 << 10)
    kept, got = [], []
    for t in texts:
        got += enc.ids([t])
        kept.append(sum(map(len, enc.parts)) + sum(len(w.encode()) for w in enc.words))
    assert sum(map(len, texts)) > 4 * (64 << 10)
    assert max(kept) <= 2 * (64 << 10)
    want = [enc.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype=enc.kind).tolist() for x in got] == want


def test_long_documents_are_cut_a_few_at_a_time():
    """What a task makes of a batch at a time is bounded by bytes, not only by rows; the pieces are whole and in order."""
    size, n = 2048, 3_000_000
    docs, wide = 12, 2
    ids = [np.full(n, i, dtype="<u2").tobytes() for i in range(docs)]
    longs = {"full": n * docs // size, "tail": 0, "n": n, "before": 0}
    columns = {"doc_id": list(range(docs)), "source": ["s"] * docs, "queue": [0] * docs, "offset": [n * i for i in range(docs)], **{k: [v] * docs for k, v in longs.items()}}
    batch = pa.RecordBatch.from_pydict({**columns, "wide": pa.array([wide] * docs, pa.int32()), "ids": pa.array(ids, pa.binary())})
    made = list(_cut(size)([batch]))
    assert max(sum(len(x) for x in b.column("ids").to_pylist()) for b in made) <= 4 // wide * (16 << 20)
    rows = [r for b in made for r in b.to_pylist()]
    assert sum(r["length"] for r in rows) == n * docs == sum(len(r["ids"]) // 4 for r in rows)
    for i in range(docs):
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
        assert np.array_equal(np.frombuffer(b"".join(x for _, x in own), dtype="<u4"), np.full(n, i))
