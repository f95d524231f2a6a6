"""A trie of conversations by their first turns, with totals of each node's subtree by a rollup in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import discard, staged

#: Levels of a band: a node is added to so many ancestors at most in a round, and rounds grow with the depth's logarithm.
BAND = 16
#: Turns of a conversation whose prefixes one task makes at a time (a multiple of BAND), and bytes of a run of ids.
TURNS, RUN = 4096, 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["k1", "k2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns without their texts: a content hash of 128 bits, the text's digest to order ties by, and its words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text).alias("digest"),
        F.xxhash64(F.lit(1), role, text).alias("c1"), F.xxhash64(F.lit(2), role, text).alias("c2"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with _part and _at, runs): turns sorted in ranges of their order, and each conversation's runs in the ranges.

    A run has the place of its first turn (begin), its turns (n) and the turns before it (before), so that no
    conversation has to be in one task to number its turns.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    t = staged(turns, "turns")
    s = staged(t.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "sorted-turns")
    discard(t)
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = s.groupBy("conv_id", "_part").agg(F.min("_at").alias("begin"), F.count("*").alias("n"))
    return s, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(conversations: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(items, convs): the turns of the rebuilt conversations by depth from 1, and the conversations with n_turns.

    Conversation c starts with the first h = crc32(c) % (most + 1) turns of conversation c - c % group and goes on
    with its own behind its first h.
    """
    s, runs = _placed(_turns(conversations))
    runs = staged(runs, "runs")
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1))
    heads = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"))
    convs = convs.join(heads, "base", "left").withColumn("n_head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "h", "n_head", (F.col("n_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "convs")
    near = runs.join(convs.select("conv_id", "base", "h", "n_head", "n_turns"), "conv_id").withColumnRenamed("n", "_n")
    own = s.join(near, ["conv_id", "_part"]).withColumn("pos", F.col("_at") - F.col("begin") + F.col("before") + 1)
    first = own.where((F.col("conv_id") == F.col("base")) & (F.col("pos") <= most)).select("base", "pos", "c1", "c2", "words")
    given = convs.where("n_head > 0").select("conv_id", "base", "n_turns", F.explode(F.sequence(F.lit(1).cast("long"), "n_head")).alias("pos")).join(first, ["base", "pos"])
    kept = own.where("pos > h").withColumn("pos", F.col("n_head") + F.col("pos") - F.col("h"))
    columns = ["conv_id", F.col("pos").alias("depth"), "c1", "c2", "words", (F.col("pos") == F.col("n_turns")).alias("ends")]
    items = staged(given.select(*columns).unionByName(kept.select(*columns)), "items")
    discard(s, runs)
    return items, convs


def _prefixes(items: DataFrame, convs: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, ends, path) of each conversation and depth: node, parent and the band's nodes down to it.

    A node's key is the exclusive or of the hashes of its turns, each with its depth: a turn less gives the parent's.
    """
    s1, s2 = F.xxhash64("depth", "c1", "c2"), F.xxhash64("c2", "depth", "c1")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.lit(0).cast("long").alias("words"), (F.col("n_turns") == 0).alias("ends"))
    rows = items.select("conv_id", "depth", s1.alias("s1"), s2.alias("s2"), "words", "ends").unionByName(roots)
    rows = rows.withColumn("block", F.floor(F.col("depth") / TURNS)).withColumn("band", F.floor(F.col("depth") / BAND))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k1", F.bit_xor("s1").over(upto)).withColumn("k2", F.bit_xor("s2").over(upto))
    if deepest >= TURNS:  # what the blocks before have
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("s1").alias("b1"), F.bit_xor("s2").alias("b2"))
        blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("b1", "b2")])
        rows = rows.join(blocks, ["conv_id", "block"]).withColumn("k1", F.col("k1").bitwiseXOR(F.col("b1"))).withColumn("k2", F.col("k2").bitwiseXOR(F.col("b2")))
    within = Window.partitionBy("conv_id", "block", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    parent = lambda k, s: F.when(F.col("depth") > 0, F.col(k).bitwiseXOR(F.col(s)))
    return rows.select("conv_id", "depth", "k1", "k2", parent("k1", "s1").alias("p1"), parent("k2", "s2").alias("p2"), "words", "ends", F.collect_list(F.struct("k1", "k2")).over(within).alias("path"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, _KEY, "left")


def _contracted(rows: DataFrame, step: int) -> DataFrame:
    """(k1, k2, p1, p2, depth, path) of the tree that has every step-th depth only: step is a power of BAND."""
    r = rows.where(F.col("depth") % step == 0).select("conv_id", (F.col("depth") / step).cast("long").alias("depth"), *_KEY)
    band = Window.partitionBy("conv_id", F.floor(F.col("depth") / BAND)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    above = r.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    r = r.withColumn("path", F.collect_list(F.struct(*_KEY)).over(band)).join(above, ["conv_id", "depth"], "left")
    return r.groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in ("p1", "p2", "depth", "path")])


def rollup(nodes: DataFrame, rows: DataFrame, values: list[str], deepest: int, step: int = 1) -> DataFrame:
    """(k1, k2, values): sums over each node's subtree.

    Inside a band a node is added to its ancestors there, BAND at most. The roots of the bands below bring their
    totals to their parents' bands; these totals come from the same rollup over the tree of band roots, which has a
    BAND-th of the depth. So there are log(depth) rounds, and no node is added to more than BAND others in one.
    """
    if deepest >= BAND:
        root = F.get("path", F.lit(0))
        own = nodes.groupBy(root["k1"].alias("k1"), root["k2"].alias("k2")).agg(*[F.sum(v).alias(v) for v in values])
        tops = staged(_contracted(rows, step * BAND).join(own, _KEY), "band-roots")
        below = rollup(tops, rows, values, deepest // BAND, step * BAND)
        deeper = nodes.where((F.col("depth") % BAND == 0) & (F.col("depth") > 0)).select(*_KEY, "p1", "p2").join(below, _KEY)
        deeper = deeper.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        nodes = _joined(nodes, deeper).select("path", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
    each = nodes.select(F.explode("path").alias("k"), *values)
    out = staged(each.groupBy(F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).agg(*[F.sum(v).alias(v) for v in values]), "subtrees")
    if deepest >= BAND:
        discard(tops, below)
    return out


def _grouped(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node, in order, joined to runs of about RUN bytes."""
    at, ids, size, out = None, [], 0, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "first", "ids"])

    for k1, k2, i in _grouped(batches, "k1", "k2", "conv_id"):
        if ids and (at != (k1, k2) or size >= RUN):
            out.append((*at, ids[0], ",".join(map(str, ids))))
            ids, size = [], 0
            if len(out) >= 1024:
                yield rows()
                out = []
        at = (k1, k2)
        ids.append(i)
        size += 20
    if ids:
        out.append((*at, ids[0], ",".join(map(str, ids))))
    if out:
        yield rows()


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs, which come in order; no more than a run is held at a time."""
    at, sha, out = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    for k1, k2, ids in _grouped(batches, "k1", "k2", "ids"):
        if at == (k1, k2):
            sha.update(b"," + ids.encode())
            continue
        if at:
            out.append((*at, sha.hexdigest()))
        if len(out) >= 4096:
            yield rows()
            out = []
        at, sha = (k1, k2), hashlib.sha256(ids.encode())
    if at:
        out.append((*at, sha.hexdigest()))
    if out:
        yield rows()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of ends(k1, k2, conv_id): the ids of a node, ascending and comma-joined, as a digest.

    Ids are sorted in ranges and joined to runs there, so that a task that hashes a common node reads runs, not ids.
    """
    runs = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_runs, "k1 long, k2 long, first long, ids string")
    return runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the rebuilt conversations.

    A node is a sequence of first turns (role and text); conv_id is its smallest member, which with depth names it.
    saved_tokens: over the node's subtree, (n_convs - 1) times the words of a node's last text.

    Turns are ordered by turn (nulls first), then by role and by the text's MD5; rows that agree in all of these are
    turns each. Null roles and texts are empty. Rows with a null conv_id take no part; c % group has c's sign. An
    empty table gives an empty result; other columns are left out.
    """
    items, convs = rebuilt(conversations, group, most)
    deepest = convs.agg(F.max("n_turns")).head()[0] or 0
    rows = staged(_prefixes(items, convs, deepest), "prefixes")
    found = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "p1", "p2", "words", "path")])
    found = staged(found, "nodes")
    children = found.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("words")
    nodes = staged(_joined(found, children).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", saved), "counted-nodes")
    sums = rollup(nodes, rows, ["n_leaves", "saved_tokens"], deepest)

    # Parents with more than a thousandth of all nodes as children are fewer than a thousand and are broadcast; the children of others meet them by key.
    many = max(1000, nodes.count() // 1000)
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = parents.where(F.col("n_children") > many).drop("n_children")
    own = nodes.select("conv_id", "depth", "n_convs", "n_children", "p1", "p2", *_KEY)
    known = own.join(F.broadcast(hot), ["p1", "p2"])
    other = own.join(F.broadcast(hot), ["p1", "p2"], "left_anti").join(parents.where((F.col("n_children") > 0) & (F.col("n_children") <= many)).drop("n_children"), ["p1", "p2"], "left")
    out = reduce(_joined, [sums, ends_digests(rows.where("ends").select(*_KEY, "conv_id"))], known.unionByName(other))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
