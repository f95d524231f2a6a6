"""What the pipeline keeps in the shared folder."""

from __future__ import annotations

import os

import corpus_pipeline
from spanweave.llm.staging import shared_dir


def test_pipeline_keeps_no_stage_that_nothing_reads(spark, tmp_path):
    """Stages' results don't pile up until the last stage; only what the last one reads is there, and the input stays."""
    text = "\n".join(" ".join(f"w{i * j % 97}x{j}" for i in range(2, 14)) for j in range(12))
    docs = [(i, text.replace("w", f"v{i}y"), "en", f"host{i % 2}", len(text)) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before if x.startswith("pipeline-")}
    assert left == {"pipeline-mixture"}
    assert packed.count() > 0 and spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 6
