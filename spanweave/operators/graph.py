"""Graph operators on edges(src, dst): traversal by frontiers, levels, layout, paths and linking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.operators.checkpoints import cut

#: Node size, gaps and padding of a layout, and its least width.
NODE_W, NODE_H, GAP_X, GAP_Y, PAD, MIN_W = 220, 70, 40, 72, 56, 800


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth): every node at its smallest distance from each root, up to max_depth.

    A frontier of new nodes is joined to the edges once a level; visited nodes are left out by an anti-join.
    Each level is checkpointed, so that the plan stays flat. edges: (src, dst); roots: (root).
    """
    edges = cut(edges.select("src", "dst").distinct())
    visited = frontier = cut(roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(visited, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return cut(visited)


def trace_forward(edges: DataFrame, roots: DataFrame, max_depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges that start at an expanded node) of what the roots call, as sets."""
    edges = cut(edges.select("src", "dst").distinct())
    nodes = reach(edges, roots, max_depth)
    inner = nodes.where(F.col("depth") < max_depth)
    return nodes, inner.join(edges, inner.node == F.col("src")).where("src <> dst").select("root", "src", "dst")


def trace_backward(edges: DataFrame, roots: DataFrame, max_depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges) of what calls the roots; edges that lead back to visited nodes stay."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    nodes, back = trace_forward(turned, roots, max_depth)
    return nodes, back.select("root", F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends among nodes(node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def levels(edges: DataFrame, root: DataFrame, max_steps: int = 100) -> DataFrame:
    """(node, level): distance from root(root); then nodes with an edge into a levelled node get that one's level + 1, until none does."""
    edges = cut(edges.select("src", "dst").distinct())
    done = reach(edges, root, max_steps).groupBy("node").agg(F.min("depth").alias("level"))
    done = cut(done)
    while True:
        new = edges.join(done, edges.dst == done.node).groupBy(F.col("src").alias("node")).agg(F.min(F.col("level") + 1).alias("level"))
        new = cut(new.join(done, "node", "left_anti"))
        if new.isEmpty():
            return done
        done = cut(done.unionByName(new))


def layout(levelled: DataFrame, backward: bool = False) -> DataFrame:
    """(node, level, x, y, width, height): rows of a level by node, centred on the widest one."""
    at = F.row_number().over(Window.partitionBy("level").orderBy("node")) - 1
    row = levelled.groupBy("level").agg(F.count("*").alias("n"))
    size = row.agg(F.max(F.col("n") * (NODE_W + GAP_X) - GAP_X).alias("widest"), F.max("level").alias("deepest"))
    d = levelled.withColumn("i", at).join(F.broadcast(row), "level").join(F.broadcast(size))
    total = (F.col("deepest") + 1) * (NODE_H + GAP_Y) - GAP_Y
    down = F.col("level") * (NODE_H + GAP_Y)
    x = (F.col("widest") - (F.col("n") * (NODE_W + GAP_X) - GAP_X)) / 2 + F.col("i") * (NODE_W + GAP_X)
    return d.select(
        "node", "level", x.alias("x"), (total - down - NODE_H if backward else down).cast("long").alias("y"), F.greatest(F.lit(MIN_W), F.col("widest") + 2 * PAD).cast("long").alias("width"), (total + 2 * PAD + 20).cast("long").alias("height")
    )


def backward_layout(nodes: DataFrame, edges: DataFrame, root: DataFrame, max_steps: int = 100) -> tuple[DataFrame, DataFrame]:
    """(layout upside down, edges between laid out nodes) of nodes(node, ord) that the levels from root(root) reach.

    A root that is no node is replaced by the first node. Nodes that neither come after nor lead into the root's levels are left out.
    """
    known = root.join(nodes.select(F.col("node").alias("root")), "root", "left_semi")
    first = nodes.agg(F.min_by("node", F.struct("ord", "node")).alias("root")).where("root is not null")
    start = cut(known.withColumn("_r", F.lit(0)).unionByName(first.withColumn("_r", F.lit(1))).orderBy("_r").limit(1).select("root"))
    own = cut(induced(nodes, edges))
    levelled = cut(levels(own, start, max_steps))
    return layout(levelled, backward=True), induced(levelled, own)


def paths(edges: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """(root, path): for each root the path to every node without further edges, at most max_depth edges away.

    A node is visited once for a root, so the work grows with the edges and not with the number of paths: by the
    shortest path, ties by the smaller one. A node whose ends are all visited gives none.
    """
    edges = cut(edges.select("src", "dst").distinct())
    starts = edges.select(F.col("src").alias("node")).distinct()
    visited = open_ = cut(roots.select("root", F.col("root").alias("node"), F.array("root").alias("path")).distinct())
    for _ in range(max_depth):
        step = open_.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(visited.select("root", "node"), ["root", "node"], "left_anti").groupBy("root", "node").agg(F.min("path").alias("path"))
        open_ = cut(step)
        if open_.isEmpty():
            break
        visited = visited.unionByName(open_)
    return visited.join(starts, "node", "left_anti").select("root", "path")


def trace_ui_to_backend(edges: DataFrame, events: DataFrame, max_depth: int = 20) -> DataFrame:
    """(root, path) from UI events(root) over edges(src, dst, type) of calls and handles."""
    return paths(edges.where(F.col("type").isin("calls", "handles")), events, max_depth)


def edges_of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("type") == kind)


def outgoing(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("src") == F.lit(node))


def incoming(edges: DataFrame, node: object) -> DataFrame:
    return edges.where(F.col("dst") == F.lit(node))


def numeric_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, num), edges(src_num, dst_num)): nodes(node, ord) numbered from 0 in order, edges between numbered ones.

    The order is by ranges: rows before each range are counted first, so that no task holds all nodes.
    """
    ranged = cut(nodes.select("node", "ord").repartitionByRange("ord", "node").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "start")
    num = (F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("ord", "node")) - 1).cast("long")
    numbered = ranged.join(F.broadcast(starts), "part").select("node", num.alias("num"))
    a, b = (numbered.select(F.col("node").alias(end), F.col("num").alias(f"{end}_num")) for end in ("src", "dst"))
    return numbered, edges.join(a, "src").join(b, "dst").select("src_num", "dst_num")
