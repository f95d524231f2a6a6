"""Hard negatives: candidates in blocks along a Hilbert curve, with zone maps whose bounds choose the blocks that anchors read."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import discard, staged

#: Bits of a dimension in a Hilbert key; rows of a block; blocks of a page of zone maps; anchors that a task has at a time.
BITS, BLOCKS, PAGE, ANCHORS = 4, (1024, 32768), 1024, 8192
#: Products of a block and so many numbers of anchors at a time.
STEP = 1 << 22
#: Scores lie between -LIMIT and LIMIT.
LIMIT = 1 << 62


def hilbert_keys(levels: np.ndarray, bits: int) -> list[bytes]:
    """Keys whose bytes sort as the points of a grid (rows of levels below 2**bits) lie on a Hilbert curve.

    Each bit of a level, from the top, reflects or swaps the lower bits of the axes, as the curve turns there; then
    the axes' bits are read across as a Gray code.
    """
    x = levels.T.astype(np.uint32).copy()
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for d in range(len(x)):
            turned = (x[d] >> np.uint32(b)) & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    odd = np.zeros(x.shape[1], dtype=np.uint32)
    for b in range(bits - 1, 0, -1):
        odd ^= np.where((x[-1] >> np.uint32(b)) & 1 == 1, np.uint32((1 << b) - 1), np.uint32(0)).astype(np.uint32)
    x ^= odd
    across = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)])  # bits, axes, points
    packed = np.packbits(across.reshape(-1, x.shape[1]).T.astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def _keyed(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors as binary, with their lengths and Hilbert keys on a grid from -most to most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pa.array(np.diff(whole.column("q").offsets.to_numpy()))
            for size in np.unique(sizes.to_numpy()).tolist():
                b = whole.filter(pa.array(sizes.to_numpy() == size))
                q = b.column("q").flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(b.num_rows, size)
                levels = np.clip((q.astype(np.float64) + most) / (2 * most + 1) * (1 << BITS), 0, (1 << BITS) - 1)
                keys = hilbert_keys(levels, BITS) if size else [b""] * b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(np.full(b.num_rows, size, dtype=np.int32)), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in q], pa.binary())], names=["vec_id", "label", "size", "key", "q"])

    return run


_BLOCK = "block long, size int, n int, min_label long, max_label long, min_id long, low binary, high binary, ids binary, labels binary, q binary"


def _blocks(most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each block of vectors, as they come in order, with its zone map: the ends of every dimension, of the labels and of the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, ids, labels, rows = TaskContext.get().partitionId() << 32, None, [], [], []

        def out() -> pa.RecordBatch:
            q = np.frombuffer(b"".join(rows), dtype="<i8").reshape(len(rows), size)
            i, k = np.array(ids, dtype="<i8"), np.array(labels, dtype="<i8")
            one = [block, size, len(rows), int(k.min()), int(k.max()), int(i.min()), q.min(axis=0).tobytes(), q.max(axis=0).tobytes(), i.tobytes(), k.tobytes(), q.tobytes()]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for b in batches:
            for i, label, s, q in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "size", "q")), strict=True):
                if rows and (len(rows) == most or s != size):
                    yield out()
                    block, ids, labels, rows = block + 1, [], [], []
                size = s
                ids.append(i)
                labels.append(label)
                rows.append(q)
        if rows:
            yield out()

    return run


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), size)


def _anchors(every: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, size, i, k, q in zip(*(b.column(c).to_pylist() for c in ("block", "size", "ids", "labels", "q")), strict=True):
                ids, labels = np.frombuffer(i, dtype="<i8"), np.frombuffer(k, dtype="<i8")
                at = np.flatnonzero(ids % every == 0)
                own = [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array([q[8 * size * a : 8 * size * (a + 1)] for a in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=["home", "at", "vec_id", "label", "size", "q"])

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b: in doubles where these hold every sum, else in integers."""
    most = [int(max(abs(int(x.min())), abs(int(x.max())))) if x.size else 0 for x in (a, b)]
    if a.shape[1] * most[0] * most[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T  # below LIMIT, as the vectors' lengths are


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and most that inner products of vectors a and any vectors within boxes can be, widened by what doubles round."""
    up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
    low, high = low.T.astype(np.float64), high.T.astype(np.float64)
    slack = 1e-12 * (np.abs(a).astype(np.float64) @ np.maximum(np.abs(low), np.abs(high)))
    return up @ low + down @ high - slack, up @ high + down @ low + slack


#: An anchor with its windows: scores from low to high, of which those above worst (or as high, with an id below worst_id) are still wanted.
_ASKED = "home long, at int, vec_id long, label long, size int, q binary, low array<long>, high array<long>, worst array<long>, worst_id array<long>"


def _lists(table: pa.Table, columns: list[str], widest: int) -> list[np.ndarray]:
    """Lists as rows of a matrix; windows that a row doesn't have are empty ones."""
    fill = {"low": LIMIT, "high": -LIMIT, "worst": LIMIT, "worst_id": 0}
    return [np.array([x + [fill[c]] * (widest - len(x)) for x in table.column(c).to_pylist()], dtype=np.int64).reshape(table.num_rows, widest) for c in columns]


def _chosen(same: bool, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The blocks of a page that each anchor reads, by zone maps: at first the square root of their number that reach highest, then all others that may hold a wanted score."""

    def run(asked: pa.Table, zones: pa.Table) -> pa.Table:
        out = []
        for size in set(asked.column("size").to_pylist()) & set(zones.column("size").to_pylist()):
            q, z = asked.filter(pa.array([s == size for s in asked.column("size").to_pylist()])), zones.filter(pa.array([s == size for s in zones.column("size").to_pylist()]))
            z = z.sort_by("block")
            least, most = _bounds(_matrix(q.column("q"), size), _matrix(z.column("low"), size), _matrix(z.column("high"), size))
            label, from_, to, min_id = q.column("label").to_numpy()[:, None], z.column("min_label").to_numpy(), z.column("max_label").to_numpy(), z.column("min_id").to_numpy()
            fit = (from_ <= label) & (label <= to) if same else (from_ != label) | (to != label)
            low, high, worst, worst_id = _lists(q, ["low", "high", "worst", "worst_id"], max(map(len, q.column("low").to_pylist()), default=0))
            may, still = np.zeros(fit.shape, dtype=bool), np.zeros(fit.shape, dtype=bool)
            for j in range(low.shape[1]):
                in_window = fit & (most >= low[:, j, None]) & (least <= high[:, j, None])
                may |= in_window
                still |= in_window & ((most > worst[:, j, None]) | ((most >= worst[:, j, None]) & (min_id < worst_id[:, j, None])))
            n = math.isqrt(len(from_) - 1) + 1
            reach = np.where(may, most, -np.inf)
            early = np.zeros(fit.shape, dtype=bool)
            np.put_along_axis(early, np.argsort(-reach, axis=1, kind="stable")[:, :n], True, axis=1)
            rows, blocks = np.nonzero(may & early if first else still & ~early)
            out.append(q.select([c.split()[0] for c in _ASKED.split(", ")]).take(pa.array(rows)).append_column("block", pa.array(z.column("block").to_numpy()[blocks], pa.int64())))
        names = [c.split()[0] for c in _ASKED.split(", ")]
        t = pa.concat_tables(out) if out else asked.select(names).slice(0, 0).append_column("block", pa.array([], pa.int64()))
        return pa.table({c: t.column(c).cast(pa.list_(pa.int64())) if pa.types.is_list(t.schema.field(c).type) else t.column(c) for c in t.column_names})

    return run


_FOUND = "home long, at int, win int, score long, id long"


def _searched(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first k rows of a block in each window of the anchors that read it."""

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        if asked.num_rows and block.num_rows:
            b = block.to_pylist()[0]
            ids, labels = np.frombuffer(b["ids"], dtype="<i8"), np.frombuffer(b["labels"], dtype="<i8")
            data, q = np.frombuffer(b["q"], dtype="<i8").reshape(len(ids), b["size"]), _matrix(asked.column("q"), b["size"])
            home, at, label = (asked.column(c).to_numpy() for c in ("home", "at", "label"))
            low, high, worst, worst_id = _lists(asked, ["low", "high", "worst", "worst_id"], max(map(len, asked.column("low").to_pylist())))
            floor, one = np.maximum(low, worst).min(axis=1), labels.min() == labels.max()
            step = max(1, STEP // len(ids))
            for s in range(0, len(q), step):
                scores = _dots(q[s : s + step], data)
                for i, own in enumerate(scores, s):
                    rows = np.flatnonzero(own >= floor[i])
                    if not one or (labels[0] == label[i]) != same:
                        rows = rows[(labels[rows] == label[i]) == same]
                    if home[i] == b["block"]:
                        rows = rows[rows != at[i]]
                    if not len(rows):
                        continue
                    x, y = own[rows], ids[rows]
                    order = np.lexsort((y, -x))
                    x, y = x[order], y[order]
                    for j in range(low.shape[1]):
                        here = np.flatnonzero((x >= low[i, j]) & (x <= high[i, j]) & ((x > worst[i, j]) | ((x == worst[i, j]) & (y < worst_id[i, j]))))[:k]
                        for to, values in zip(found, (np.full(len(here), home[i]), np.full(len(here), at[i]), np.full(len(here), j), x[here], y[here]), strict=True):
                            to.append(values)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({c.split()[0]: pa.array(np.concatenate(x) if x else np.empty(0), t) for c, x, t in zip(_FOUND.split(", "), found, kinds, strict=True)})

    return run


class Candidates:
    """Blocks of candidates in a written table, and the searches of anchors' windows in them."""

    def __init__(self, blocks: DataFrame, anchors: int) -> None:
        self.blocks, self.n = blocks, blocks.count()
        self.pages, self.parts = max(1, math.ceil(self.n / PAGE)), max(1, math.ceil(anchors / ANCHORS))
        part = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part")
        self.zones = blocks.select("block", "size", "min_label", "max_label", "min_id", "low", "high", F.pmod(F.xxhash64("block"), F.lit(self.pages)).cast("int").alias("page"), part)

    def _read(self, asked: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        """One round: zone maps choose blocks, and only these are read, each by at most ANCHORS anchors in a task."""
        keys, part = ["page", "part"], F.pmod(F.xxhash64("home", "at"), F.lit(self.parts)).cast("int")
        paged = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.pages - 1))).alias("page"), part.alias("part"))
        wants = staged(paged.groupBy(*keys).cogroup(self.zones.groupBy(*keys)).applyInArrow(_chosen(same, first), f"{_ASKED}, block long"), "wants", dictionary=False)
        wanted = wants.withColumn("part", part)
        against = self.blocks.select("block", "size", "ids", "labels", "q").join(wants.select("block", part.alias("part")).distinct(), "block")
        keys = ["block", "part"]
        found = staged(wanted.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInArrow(_searched(k, same), _FOUND), "found")
        discard(wants)
        return found

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(home, at, win, score, id, rank): the first k rows of the same label, or of others, in each window.

        The k-th score of a first round over few blocks is the bound below which the second round skips blocks and rows.
        """
        best = Window.partitionBy("home", "at", "win").orderBy(F.desc("score"), "id")
        top = lambda d: d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        early = self._read(asked, k, same, True)
        reached = top(early).where(F.col("rank") == k).groupBy("home", "at").agg(F.map_from_entries(F.collect_list(F.struct("win", F.struct("score", "id")))).alias("_k"))
        each = F.sequence(F.lit(0), F.size("low") - 1)
        worst = lambda f, other: F.transform(each, lambda j: F.coalesce(F.try_element_at("_k", j)[f], F.lit(other).cast("long")))
        again = asked.drop("worst", "worst_id").join(reached, ["home", "at"], "left").withColumn("worst", worst("score", -LIMIT)).withColumn("worst_id", worst("id", 0)).drop("_k")
        late = self._read(again.select(*asked.columns), k, same, False)
        out = staged(top(early.unionByName(late)), "best")
        discard(early, late)
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows without nulls whose vector's squared length is below LIMIT, so that every score is a long."""
    d = vectors.where("vec_id is not null and label is not null and q is not null").where(F.forall("q", lambda x: x.isNotNull()))
    length = F.aggregate("q", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double"), F.lit(2.0)))
    return d.where(length < float(LIMIT) * 0.999).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("q").cast("array<long>").alias("q"))


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, q: integers).

    Anchors are the rows whose vec_id every divides. A row's score is its inner product with the anchor. For each of
    an anchor's first positives rows of its label: the first negatives rows of other labels whose scores lie from
    low to high percent of the positive's. Higher scores come first, ties by the smaller vec_id. Results are exact.

    Candidates are sorted by label and along a Hilbert curve over all dimensions and written in blocks; a block's
    zone map bounds its scores with an anchor by interval arithmetic. Each search has two rounds (Candidates.search).
    Where vectors are spread over many dimensions the bounds rule out few blocks, and an anchor reads nearly all.

    Rows with a null vec_id, label, vector or component, or with a squared length of about 2**62 or more, take no
    part; vectors are scored with those of their own length. Every row is a candidate but the anchor's own: repeated
    rows and rows that share a vec_id count each. An anchor without a positive, or a positive without a negative,
    gives no row. An empty table gives an empty result; other columns are left out.
    """
    v = staged(usable(vectors), "vectors")
    n, most = v.agg(F.count("*"), F.max(F.array_max(F.transform("q", F.abs)))).head()
    block = block or min(max(n // 64, BLOCKS[0]), BLOCKS[1])
    keyed = v.mapInArrow(_keyed(most or 0), "vec_id long, label long, size int, key binary, q binary")
    order = ["size", "label", "key", "vec_id"]
    laid = keyed.repartitionByRange(max(1, math.ceil(n / (4 * block))), *order).sortWithinPartitions(*order)
    blocks = staged(laid.mapInArrow(_blocks(block), _BLOCK), "blocks", dictionary=False)
    anchors = staged(blocks.select("block", "size", "ids", "labels", "q").mapInArrow(_anchors(every), "home long, at int, vec_id long, label long, size int, q binary"), "anchors", dictionary=False)
    discard(v)
    candidates = Candidates(blocks, anchors.count())

    def ask(d: DataFrame, wins: str) -> DataFrame:
        """Anchors with windows: an array of (low, high)."""
        return d.select("home", "at", "vec_id", "label", "size", "q", F.col(f"{wins}.low").alias("low"), F.col(f"{wins}.high").alias("high"), *[F.array_repeat(F.lit(o).cast("long"), F.size(wins)).alias(c) for c, o in (("worst", -LIMIT), ("worst_id", 0))])

    everything = F.array(F.struct(F.lit(-LIMIT).cast("long").alias("low"), F.lit(LIMIT).cast("long").alias("high")))
    near = candidates.search(ask(anchors.withColumn("w", everything), "w"), positives, True)
    percent = lambda p: F.col("score").cast("decimal(20,0)") * p / 100
    window = F.struct(F.ceil(percent(low)).cast("long").alias("low"), F.floor(percent(high)).cast("long").alias("high"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")
    wins = near.select("home", "at", window.alias("w")).where("w.low <= w.high").groupBy("home", "at").agg(F.sort_array(F.collect_list("w")).alias("w"))
    asked = staged(anchors.join(wins, ["home", "at"]), "windows", dictionary=False)
    hard = candidates.search(ask(asked, "w"), negatives, False)
    pairs = asked.select("home", "at", F.col("vec_id").alias("anchor_id"), F.posexplode("w").alias("win", "w"))
    out = hard.join(pairs, ["home", "at", "win"])
    return out.select("anchor_id", F.col("w.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("w.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
