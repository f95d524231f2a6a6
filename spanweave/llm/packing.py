"""Mixture-controlled packing: deficit round-robin over source queues fills windows of sequences to target proportions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import sized, staged
from spanweave.llm.tokens import encoder, slices

#: Sequences of a queue that are made of one row.
RUN = 4096


def _encode(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, sent = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], dtype=enc.kind).tobytes()
        for batch in batches:
            for b in slices(batch, "text"):
                ids = [x + end for x in enc.ids(b.column("text").to_pylist())]
                sizes = [len(x) // enc.kind.itemsize for x in ids]
                sources, before = b.column("source").to_pylist(), []
                for s, n in zip(sources, sizes, strict=True):
                    before.append(sent.get(s, 0))
                    sent[s] = before[-1] + n
                wide = enc.kind.itemsize
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array([wide] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "part", "before", "n", "wide", "ids"],
                )

    return run


def with_total_before(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows before each in order: by ranges, so that no task holds all rows.

    The ranges are written, their sums are one row each.
    """
    ranged = staged(rows.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.sum("_v").alias("_s")).select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_v", "_range", "_start")


def queues_of(totals: DataFrame, size: int, weights: DataFrame | None, temper: float) -> DataFrame:
    """(source, queue, full, tail, weight) of totals(source, n): a queue for each source, however many there are.

    queue: its number in order of the sources; full: sequences that its tokens fill; tail: where its last tokens,
    less than a sequence, are among all such; weight: from weights(source, weight), 0 without one, or n to the power temper.
    """
    if weights is None:
        weighed = totals.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = totals.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    numbered = with_total_before(weighed, ["source"], F.lit(1), "queue")
    tailed = with_total_before(numbered, ["source"], F.col("n") % size, "tail")
    return tailed.select("source", "queue", F.floor(F.col("n") / size).cast("long").alias("full"), "tail", "weight")


def sequence_ids(queues: DataFrame) -> DataFrame:
    """(queue, k, sequence_id) of the full sequences of all queues, in the order of deficit round-robin.

    A queue's credit grows with its weight; when it reaches a sequence's tokens, the queue sends one, and what is
    left of the credit, its deficit, stays for later windows. So sequence k of a queue of weight w goes at time
    (k + 1) / w, ties by queue and k; queues without weight follow when all others are empty, one after another.
    All sequences are sorted by that time in ranges.
    """
    runs = queues.where("full > 0").select("queue", "weight", "full", F.explode(F.sequence(F.lit(0), F.floor((F.col("full") - 1) / RUN))).alias("_run")).repartition("queue", "_run")
    each = runs.select("queue", "weight", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("full"), (F.col("_run") + 1) * RUN) - 1)).alias("k"))
    time = F.when(F.col("weight") > 0, (F.col("k") + 1) / F.col("weight")).otherwise(F.lit(float("inf")))
    return with_total_before(each.withColumn("time", time).drop("weight"), ["time", "queue", "k"], F.lit(1), "sequence_id").select("queue", "k", "sequence_id")


def pieces(first: np.ndarray, n: np.ndarray, full: np.ndarray, tail: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, k, offset, is_tail) of documents at first of their queues, with n tokens each.

    k: the sequence's number in the queue, or for the end of a queue its number among the sequences of all ends.
    """
    limit = full * size
    move = tail - limit  # the way from a place in the queue's end to its place among all ends
    inside = np.clip(limit - first, 0, n)
    out = []
    for lo, length, shift, is_tail in ((first, inside, np.zeros_like(first), False), (first + inside + move, n - inside, move, True)):
        has = np.flatnonzero(length > 0)
        a, z = lo[has] // size, (lo[has] + length[has] - 1) // size
        doc = np.repeat(has, z - a + 1)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(z - a + 1) - (z - a + 1), z - a + 1) + np.repeat(a, z - a + 1)
        start = np.maximum(k * size, lo[doc])
        stop = np.minimum((k + 1) * size, lo[doc] + length[doc])
        out.append((doc, start - shift[doc] - first[doc], stop - start, k, start - k * size, np.full(len(doc), is_tail)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_PIECE = "doc_id long, source string, queue long, start long, length long, doc_tokens long, k long, offset long, is_tail boolean, ids binary"


def _cut(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {2: "<u2", 4: "<u4"}
        for batch in batches:
            for b in slices(batch, "ids"):
                col = {k: b.column(k).to_numpy() for k in ("offset", "before", "n", "full", "tail")}
                doc, start, length, k, offset, is_tail = pieces(col["offset"] + col["before"], col["n"], col["full"], col["tail"], size)
                whole = [np.frombuffer(x, dtype=kind[w]).astype("<u4").tobytes() for x, w in zip(b.column("ids").to_pylist(), b.column("wide").to_pylist(), strict=True)]
                ids = [whole[d][4 * s : 4 * (s + m)] for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(own) for c in ("doc_id", "source", "queue")], pa.array(start), pa.array(length), pa.array(col["n"][doc]), pa.array(k), pa.array(offset), pa.array(is_tail), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "queue", "start", "length", "doc_tokens", "k", "offset", "is_tail", "ids"],
                )

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, weights: DataFrame | dict[str, float] | None = None, temper: float = 0.7, window: int = 64, end_id: int = 1) -> DataFrame:
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, window, ids): a row for each piece of a document.

    A document is its ids and then end_id. Pieces fill sequences of size tokens without gaps; only the last
    sequence has room left. A sequence holds one source's tokens, but for the last ones, which hold the sources'
    ends. window: each run of so many sequences holds the target proportions of tokens of the sources that aren't
    empty yet, up to less than two sequences a source; what a window owes a source, the next ones give. weights: targets by
    source, as a dict or a table (source, weight); sources without one get none until the others are empty, then
    follow. Without it a source's target is its number of tokens to the power temper: 1 keeps the corpus's own
    proportions, less lifts the small sources. ids: little-endian unsigned 32-bit.

    Ids are written once to the shared folder with each document's place among its source's tokens in its
    partition. Sums by partition and source give each partition's place in its queue; the sequences of all
    queues, one row each without ids, are sorted by credit. Pieces get their sequences by a join that broadcasts
    the sequences within a measured bound and shuffles beyond it. The number of sources has no limit.

    Nulls: a null text has end_id only; a null source is ''; a null doc_id stays null. Each row is packed,
    repeated ones too. An empty table gives an empty result. Other columns are left out.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))
    tokens = staged(d.mapInArrow(_encode(tokenizer, end_id), "doc_id long, source string, part int, before long, n long, wide int, ids binary"), "token-ids", dictionary=False)
    parts = staged(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    if isinstance(weights, dict):
        weights = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
    queues = staged(queues_of(parts.groupBy("source").agg(F.sum("n").alias("n")), size, weights, temper), "queues")
    ranks = staged(sequence_ids(queues), "sequences")
    n_full = queues.agg(F.coalesce(F.sum("full"), F.lit(0))).head()[0]
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n").join(sized(queues), "source").drop("weight")
    rows = tokens.join(sized(staged(offsets, "offsets")), ["part", "source"]).select("doc_id", "source", "queue", "full", "tail", "offset", "before", "n", "wide", "ids")
    cut = rows.mapInArrow(_cut(size), _PIECE)
    # The ends' pieces match no full sequence; they follow all of those.
    key = F.when(~F.col("is_tail"), F.col("k"))
    ranks = ranks.select(F.col("queue").alias("_q"), F.col("k").alias("_k"), "sequence_id")
    placed = cut.join(sized(ranks), (F.col("queue") == F.col("_q")) & (key == F.col("_k")), "left").withColumn("sequence_id", F.coalesce("sequence_id", F.col("k") + F.lit(n_full)))
    return placed.select("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", F.floor(F.col("sequence_id") / window).cast("long").alias("window"), "ids")
