"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens until buckets are small."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.components import components
from spanweave.llm.staging import discard, sized, staged

#: Sampled tokens of a set: the smallest hash in each of so many ranges of the hash; of a set with at most so many
#: shingles the smallest under each of so many hash functions.
TOKENS = 64
#: A bucket with so many sets is compared pair by pair.
SMALL = 64
#: Sets of a block; larger buckets and clusters are compared block against block. Buckets hold sampled tokens
#: only, clusters whole sets.
BUCKET_BLOCK, CLUSTER_BLOCK = 1024, 256
#: Words of the sets that a task hashes at a time, and of a cluster's block on average.
WORDS = 500_000
DEPTH, BRANCHES = 3, 2

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in lower case; words end at space and U+0009 to U+000D."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(flat: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each n-word shingle; a text of fewer words has one shingle of them all, an empty one none."""
    ends = np.asarray(ends, dtype=np.int64)
    sizes = np.diff(ends)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends[:-1], counts)
    words = np.concatenate([flat.view(np.uint64), np.zeros(n, dtype=np.uint64)])
    h = np.zeros(len(doc), dtype=np.uint64)
    short = sizes[doc] < n
    for k in range(n):
        part = words[at + k] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
        part[short & (sizes[doc] <= k)] = k + 1
        h += part
    return doc, _mix(h)


def sampled_tokens(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs x TOKENS, docs): a token of each hash range, and whether a range had none of its own.

    Two sets agree on a token with the probability of their similarity. A range without a token borrows from the
    next one that has some, so that the tokens of a set with few shingles depend on each other.
    """
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(docs * TOKENS, none)
    np.minimum.at(best, doc * TOKENS + (h >> np.uint64(64 - 6)).astype(np.int64), h)
    best = best.reshape(docs, TOKENS)
    there = np.where(best != none, np.arange(TOKENS), 4 * TOKENS)
    twice = np.concatenate([there, np.where(there < TOKENS, there + TOKENS, 4 * TOKENS)], axis=1)
    nearest = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :TOKENS]
    out = np.take_along_axis(best, nearest % TOKENS, axis=1) + (nearest - np.arange(TOKENS)).astype(np.uint64) * _ODD[1]
    return _short(out), (best == none).any(axis=1)


def least_tokens(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sets x TOKENS: of each set, whose hashes begin at starts, the least one under each of TOKENS hash functions.

    Two sets agree on each token with the probability of their similarity, whatever the others are.
    """
    out = np.empty((len(starts), TOKENS), dtype=np.uint64)
    turns = np.arange(1, TOKENS + 1, dtype=np.uint64) * _ODD[0]
    for k in range(TOKENS if len(starts) else 0):
        out[:, k] = np.minimum.reduceat(_mix(h + turns[k]), starts)
    return _short(out)


def _short(h: np.ndarray) -> np.ndarray:
    return (_mix(h) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a set's number and a hash, each once, by set."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    once = np.ones(len(h), dtype=bool)
    once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[once], h[once]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows with about WORDS words at a time, or one row."""
    for b in batches:
        ends, a = b.column("w").offsets.to_numpy(), 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + WORDS, side="right")) - 1)
            yield b.slice(a, z - a)
            a = z


def _with_tokens(n: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            w = b.column("w")
            ends = w.offsets.to_numpy() - w.offsets[0].as_py()
            doc, h = shingles(w.flatten().to_numpy(zero_copy_only=False), ends, n)
            ranged, gaps = sampled_tokens(doc, h, b.num_rows)
            # A set whose tokens fill every range has TOKENS shingles at least.
            doc, h = _distinct(doc[gaps[doc]], h[gaps[doc]])
            sizes = np.bincount(doc, minlength=b.num_rows)
            small = (sizes > 0) & (sizes <= TOKENS)
            doc, h = doc[small[doc]], h[small[doc]]
            sizes[~small] = 0
            least = np.zeros_like(ranged)
            least[small] = least_tokens(h, (np.cumsum(sizes) - sizes)[small])
            # A small set similar to a larger one has tokens of both kinds.
            kept = np.repeat(np.stack([~small | (sizes >= threshold * TOKENS), small], axis=1), TOKENS, axis=1)
            tokens = np.concatenate([ranged, least], axis=1)[kept]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]).astype(np.int32)), pa.array(v)) for k, v in ((kept.sum(axis=1), tokens), (sizes, h.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("doc_id", "k1", "k2", "n")] + lists, names=["doc_id", "k1", "k2", "n", "tokens", "few"])

    return run


def _roots(pairs: np.ndarray, m: int) -> np.ndarray:
    """For each of m items the smallest item that the pairs connect it to."""
    root = np.arange(m)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in batches sorted by them; a run has at most two blocks of rows."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *change.tolist(), t.num_rows]
        for a, z in zip(cuts[:-2], cuts[1:-1], strict=True):
            if z - a > 1:
                yield t.slice(a, z - a)
        rest = t.slice(cuts[-2])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _pairs_within(hit: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of a boolean matrix; between two blocks only those from one to the other."""
    hit = np.triu(hit, 1)
    if side.any() and not side.all():
        hit &= side[:, None] != side[None, :]
    return np.argwhere(hit)


def _shared(doc: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, m x m sizes of intersections) of m sets given as pairs of a set's number and a hash, repeats allowed."""
    h, doc = _distinct(h, doc)
    sizes = np.bincount(doc, minlength=m)
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    token = np.cumsum(new) - 1
    shared = np.bincount(token, minlength=1) > 1
    keep = shared[token]
    doc, token = doc[keep], (np.cumsum(shared) - 1)[token[keep]]
    common = np.zeros((m, m), dtype=np.float32)
    for a in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(token, [a, a + 4096])
        x = np.zeros((m, 4096), dtype=np.float32)
        x[doc[lo:hi], token[lo:hi] - a] = 1
        common += x @ x.T
    return sizes, common


def _similar(sizes: np.ndarray, common: np.ndarray, threshold: float) -> np.ndarray:
    return (common > 0) & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6)


def _near_in_bucket(least: float, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["path", "x", "y"]):
            node = g.column("node").to_numpy()
            few = g.column("few").combine_chunks()
            sizes = np.diff(few.offsets.to_numpy())
            small = np.flatnonzero(sizes)
            hit = np.zeros((len(node), len(node)), dtype=bool)
            if len(small) < len(node):  # a bucket by ranges: their tokens come first
                lists = g.column("tokens").combine_chunks()
                firsts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
                tokens = lists.flatten().to_numpy()[firsts[:, None] + np.arange(TOKENS)]
                same = np.zeros(hit.shape, dtype=np.int16)
                for k in range(TOKENS):
                    same += tokens[:, k, None] == tokens[None, :, k]
                hit = same >= least * TOKENS
            if len(small) > 1:  # sets as small as the samples are compared whole
                found, common = _shared(np.repeat(np.arange(len(small)), sizes[small]), few.flatten().to_numpy(zero_copy_only=False), len(small))
                hit[np.ix_(small, small)] = _similar(found, common, threshold)
            pairs = _pairs_within(hit, g.column("block").to_numpy() != g.column("x").to_numpy())
            root = _roots(pairs, len(node))
            own = np.flatnonzero(root != np.arange(len(node)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])

    return run


def _exact_in_cluster(n: int, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["cluster", "x", "y"]):
            node, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
            w = g.column("w").combine_chunks()
            doc, h = shingles(w.flatten().to_numpy(zero_copy_only=False), w.offsets.to_numpy() - w.offsets[0].as_py(), n)
            m = len(node)
            sizes, common = _shared(doc, h, m)
            pairs = _pairs_within(_similar(sizes, common, threshold), g.column("block").to_numpy() != g.column("x").to_numpy())
            if not len(pairs):
                continue
            links = np.zeros(m, dtype=np.int64)
            np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
            np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
            root, own = _roots(pairs, m), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]]), pa.array(links[own])], names=["a", "b", "links"])

    return run


def _in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows with block and the pair of blocks (x, y) in which they are compared; m is the size of a row's key.

    A key with m up to most is one block. Of a larger one each block meets every other once, so that no
    task gets more than two blocks of a key and no pair is left out.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / most)).cast("int")
    d = rows.withColumn("_b", blocks)
    d = d.withColumn("block", F.when(F.col("_b") > 1, F.pmod(F.xxhash64("node", F.lit(7)), F.col("_b"))).otherwise(0).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return d.withColumn("x", F.least("block", "_o").cast("int")).withColumn("y", F.greatest("block", "_o").cast("int")).drop("_b", "_o", "m")


def _buckets(sets: DataFrame, runs: int) -> DataFrame:
    """(path, node, m): the buckets with two sets or more in which the chosen paths of all runs end, written.

    Paths over the tokens of ranges and over the least tokens are runs of their own; a set with both kinds has
    them one after the other, and skip is where a path's kind begins.
    """
    columns = ["node", "tokens", "path", "skip"]

    def split(d: DataFrame, level: int) -> DataFrame:
        branch = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
        d = d.select(*columns, branch.alias("j")).withColumn("c", F.pmod(F.xxhash64("path", F.lit(level), "j"), F.lit(TOKENS)).cast("int"))
        return d.select("node", "skip", F.xxhash64("path", "c", F.get("tokens", F.col("skip") + F.col("c"))).alias("path")).distinct()

    small, both = F.size("few") > 0, F.size("tokens") > TOKENS
    first, last = F.when(small & ~both, runs + 1).otherwise(1), F.when(small, 2 * runs).otherwise(runs)
    started = sets.select("node", "tokens", both.alias("both"), F.explode(F.sequence(first, last).cast("array<bigint>")).alias("path"))
    active = started.withColumn("skip", F.when(F.col("both") & (F.col("path") > runs), TOKENS).otherwise(0)).select(*columns)
    ends: DataFrame | None = None
    levels: list[DataFrame] = []
    for level in range(DEPTH):
        rows = staged(split(active, level), "paths")
        levels.append(rows)
        # Written before the joins, so that a bucket with many sets can be split as a skewed one.
        sizes = staged(rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        levels.append(sizes)
        last_level = level == DEPTH - 1
        done = rows.join(sizes if last_level else sizes.where(F.col("m") <= SMALL), "path").select("path", "node", "m")
        ends = done if ends is None else ends.unionByName(done)
        if not last_level:
            large = rows.join(sizes.where(F.col("m") > SMALL), "path", "left_semi")
            active = large.join(sets.select("node", "tokens"), "node").select(*columns)
    ends = staged(ends, "buckets")
    discard(*levels)
    return ends


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, target_recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links), a row for each of docs: the join of documents whose n-word shingle sets have at least this Jaccard similarity.

    class_id: smallest doc_id of all documents that links connect. n_links: documents linked to this one,
    copies among them. copy_of: smallest doc_id with the same words. A text of fewer than n words has one
    shingle of all its words; one without words has no links and is its own class (class_id is its doc_id).
    Words are compared in lower case.

    Documents with the same words are joined by a hash of them and take part once. Each run starts with all sets
    in one bucket; a bucket with more than SMALL sets is split on BRANCHES sampled tokens, DEPTH times at most,
    and the rest of a larger one is compared in blocks. The runs are as many as a pair at the threshold needs to
    meet in one with probability target_recall. Sets of at most TOKENS shingles are split on tokens that are
    sampled independently, so that this holds for them too; those that may be similar to larger sets take part in
    the runs of both. Sets that agree on half of their sampled tokens form clusters
    (sets of at most TOKENS shingles are compared whole), and within a cluster every pair is verified on whole sets.

    Nulls: a null text is empty; a document with a null doc_id has a class_id from the others of its class, or null.
    Repeated rows count as copies of each other. Empty tables give empty results. Other columns take no part.
    """
    runs = math.ceil(math.log(1 - target_recall) / math.log(1 - (1 - (1 - threshold) ** BRANCHES) ** DEPTH))
    w = word_hashes(F.col("text"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), w.alias("w"))
    keyed = keyed.select("doc_id", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"), F.size("w").alias("n"), "w")
    each = staged(keyed.mapInArrow(_with_tokens(n, threshold), "doc_id long, k1 long, k2 long, n int, tokens array<int>, few array<bigint>"), "tokens")
    classes = each.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"), F.first("few").alias("few"))
    classes = staged(classes.withColumn("node", F.col("k1")), "classes")

    ends = _buckets(classes, runs)
    met = _in_blocks(ends, BUCKET_BLOCK).join(classes.select("node", "tokens", "few"), "node")
    met = met.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    near = met.select("path", "x", "y", "block", "node", "tokens", "few").mapInArrow(_near_in_bucket(0.5, threshold), "a long, b long")
    clusters = components(near).withColumnRenamed("label", "cluster")

    # Whole sets only of documents in clusters: one text of each class, found before its words are hashed or moved.
    one = clusters.join(classes.select("node", "k2", "copy_of", "copies"), "node")
    one = sized(staged(one.select("cluster", "node", "k2", "copies", F.col("copy_of").alias("_id")), "clustered"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(one, F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = texts.select("cluster", "node", "k2", "copies", word_hashes(F.col("text")).alias("w")).where((F.xxhash64("w") == F.col("node")) & (F.xxhash64(F.lit(1), "w") == F.col("k2")))
    sets = sets.groupBy("cluster", "node").agg(F.first("w").alias("w"), F.first("copies").alias("copies"))
    sets = staged(sets, "sets")
    # A cluster of long texts has smaller blocks, so that a task's two have a bounded number of words.
    weight = F.greatest(F.count("*"), F.sum(F.size("w")) * CLUSTER_BLOCK / WORDS).alias("m")
    # Written before the join, so that a cluster with many sets can be split as a skewed one.
    spread = _in_blocks(sets.join(staged(sets.groupBy("cluster").agg(weight), "sizes"), "cluster"), CLUSTER_BLOCK)
    spread = spread.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    links = spread.select("cluster", "x", "y", "block", "node", "copies", "w").mapInArrow(_exact_in_cluster(n, threshold), "a long, b long, links long")
    links = staged(links, "exact")
    discard(ends, sets)
    classed = classes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    classed = classed.join(links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    ids = classed.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    classed = classed.join(ids, "label").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "class_id", "copy_of", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))

    d = each.select("doc_id", F.col("k1"), F.col("k2")).join(classed, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    alone = F.col("_k1").isNull()
    return d.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those whose class has a smaller doc_id; rows with a null doc_id stay. Columns stay as they are."""
    others = jaccard_classes(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("__other_id")).distinct()
    return docs.join(others.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("__other_id"), "left_anti")
