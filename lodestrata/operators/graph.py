"""The typed graph as two tables: nodes, and distinct directed edges (src, dst, edge_type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.storage import materialize

#: Edges along which a change spreads, in the order that names the way to a node.
IMPACT_TYPES = ("calls", "inherits", "imports")
MAX_DEPTH = 4
RELATED = 5


def typed_edges(*parts: DataFrame) -> DataFrame:
    """Edges of several sources as a set, without self-loops."""
    every = reduce(DataFrame.unionByName, parts)
    return every.where(F.col("src") != F.col("dst")).select("src", "dst", "edge_type").dropDuplicates()


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node id; of several, the last (by ``ord``) non-null attribute counts."""
    names = [c for c in nodes.columns if c not in ("node_id", "ord")]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v")))).getField("v").alias(c) for c in names]
    return nodes.groupBy("node_id").agg(*last)


def neighbours(edges: DataFrame, starts: DataFrame, edge_type: str, reverse: bool = False) -> DataFrame:
    """(start) -> (start, node): one step along edges of a type, or against them."""
    here, there = ("dst", "src") if reverse else ("src", "dst")
    step = edges.where(F.col("edge_type") == edge_type).select(F.col(here).alias("start"), F.col(there).alias("node"))
    return starts.select("start").distinct().join(step, "start")


def callers_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbours(edges, starts, "calls", reverse=True)


def callees_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbours(edges, starts, "calls")


def subclasses_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbours(edges, starts, "inherits", reverse=True)


def importers_of(edges: DataFrame, starts: DataFrame) -> DataFrame:
    return neighbours(edges, starts, "imports", reverse=True)


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, types: tuple[str, ...] = IMPACT_TYPES) -> DataFrame:
    """(start) -> (start, node, depth, via): all that depends on a start, at its least depth.

    A node reached at that depth in several ways has the first of ``types`` as its way. Edges are
    written once, turned round, so no level computes them again. Each level is one join with the
    frontier and one anti-join with what was seen, and is written out, so the plan doesn't grow with
    depth. There is no limit on the number of rows.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("edge_type"))
    back = materialize(edges.where(F.col("edge_type").isin(*types)).select(F.col("dst").alias("node"), F.col("src").alias("next"), order.alias("way")), "impact-edges")
    frontier = seen = starts.select("start", F.col("start").alias("node")).distinct()
    levels = []
    for depth in range(1, max_depth + 1):
        reached = frontier.join(back, "node").groupBy("start", F.col("next").alias("node")).agg(F.min("way").alias("way")).join(seen, ["start", "node"], "left_anti")
        level = materialize(reached, "impact")
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
        frontier = level.select("start", "node")
        seen = seen.unionByName(frontier)
    found = reduce(DataFrame.unionByName, levels) if levels else frontier.where("false").withColumn("way", F.lit(1).cast("bigint")).withColumn("depth", F.lit(0))
    return found.select("start", "node", "depth", F.element_at(F.array(*[F.lit(t) for t in types]), F.col("way").cast("int")).alias("via"))


#: Starts whose marks one long holds.
WORD_BITS = 64
#: Rows of marks, and starts, up to which they are broadcast; more are joined by shuffles.
BROADCAST_MARKS = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS else df


def impact_many(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, types: tuple[str, ...] = IMPACT_TYPES) -> DataFrame:
    """The same as ``impact`` for many starts at once, 64 to a row; ``edges`` may hold an edge more than once.

    Starts are numbered in the order of their names, so that those of one file or kind share words, and
    a node's marks are longs, one for each word of numbers. Only edges to nodes that have dependents of
    their own take part in the levels, which or the marks of a node's neighbours together and take away
    those it had. Most edges lead to nodes that nothing depends on; all edges are met once, at the end,
    by the marks of every level, a column for each, and what comes by them is or-ed by node and word for
    each depth and type. A start's depth and way are the first of these that have its bit. So edges are
    shuffled once to find the inner ones and once for the result, at any depth, and no table that is
    written grows with edges to outer nodes. Rows of one start come apart in the result only.
    """
    if max_depth < 1:
        starts = starts.where("false")
    bits = "bigint"
    none = F.lit(0).cast(bits)
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("edge_type"))
    turned = edges.where(F.col("edge_type").isin(*types) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("node"), F.col("src").alias("next"), order.cast("int").alias("way"))
    inner = materialize(turned.select("node", "next").join(turned.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node", "next"), "impact-edges")
    # Numbers are dense within a partition, so that words are full but for each partition's last.
    named = materialize(starts.select("start").distinct().repartitionByRange("start").sortWithinPartitions("start").withColumn("number", F.monotonically_increasing_id()), "impact-starts")
    mark = F.call_function("shiftleft", F.lit(1).cast(bits), F.col("number").bitwiseAND(WORD_BITS - 1).cast("int"))
    level = materialize(named.groupBy(F.col("start").alias("node"), F.shiftright("number", 6).alias("word")).agg(F.bit_or(mark).alias("marks")), "impact")
    levels = [level]
    for _ in range(1, max_depth):
        reached = inner.join(level, "node").select(F.col("next").alias("node"), "word", "marks", none.alias("had"))
        seen = [m.select("node", "word", none.alias("marks"), F.col("marks").alias("had")) for m in levels]
        new = reduce(DataFrame.unionByName, seen, reached).groupBy("node", "word").agg(F.bit_or("marks").alias("marks"), F.bit_or("had").alias("had"))
        level = materialize(new.select("node", "word", F.col("marks").bitwiseAND(F.bitwise_not("had")).alias("marks")).where("marks <> 0"), "impact")
        if level.isEmpty():
            break
        levels.append(level)
    at = [f"at{k}" for k in range(len(levels))]
    side = [m.select("node", "word", *[(F.col("marks") if c == own else none).alias(c) for c in at]) for own, m in zip(at, levels, strict=True)]
    held = materialize(reduce(DataFrame.unionByName, side).groupBy("node", "word").agg(*[F.bit_or(c).alias(c) for c in at]), "impact-held")
    few = _few(held)
    # Where marks are broadcast, edges lie by the node that they lead to, and nothing is shuffled after the join. Parts
    # are stated, as those of the size that Spark would join them to take long and hold 1 GB of groups.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = turned.repartition(parts, "next").join(few, "node") if few is not held else turned.join(held, "node")
    masks = {(depth, k): f"m{depth}_{k}" for depth in range(1, len(at) + 1) for k in range(1, len(types) + 1)}
    marked = met.groupBy("next", "word").agg(*[F.bit_or(F.when(F.col("way") == k, F.col(at[depth - 1])).otherwise(none)).alias(c) for (depth, k), c in masks.items()])
    every = reduce(lambda a, b: a.bitwiseOR(b), [F.col(c) for c in masks.values()])
    # A single mark's place is the number of bits below it, the highest one's has no number one less.
    place = F.coalesce(F.bit_count(F.try_subtract(every, F.lit(1).cast(bits))), F.lit(WORD_BITS - 1))
    places = F.when(F.bit_count(every) == 1, F.array(place)).otherwise(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)))

    def has(c: Column) -> Column:
        return F.call_function("shiftright", c, F.col("bit")).bitwiseAND(F.lit(1).cast(bits)) != 0

    each = marked.where(every != 0).select(F.col("next").alias("node"), "word", *masks.values(), F.explode(places).alias("bit")).where(has(every))
    first = F.coalesce(*[F.when(has(F.col(c)), F.lit((depth - 1) * len(types) + k - 1)) for (depth, k), c in masks.items()])
    found = each.select("node", (F.shiftleft("word", 6) + F.col("bit")).alias("number"), first.alias("first")).join(_few(named), "number").where(F.col("start") != F.col("node"))
    depth, way = F.floor(F.col("first") / len(types)).cast("int") + 1, F.col("first") % len(types) + 1
    return found.select("start", "node", depth.alias("depth"), F.element_at(F.array(*[F.lit(t) for t in types]), way).alias("via"))


def remove_file(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph without a file's node, the symbols it contains and every edge at one of them."""
    contained = edges.where((F.col("edge_type") == "contains") & (F.col("src") == file_id)).select(F.col("dst").alias("node_id"))
    gone = contained.unionByName(nodes.sparkSession.createDataFrame([(file_id,)], "node_id string")).distinct()
    left = nodes.join(gone, "node_id", "left_anti")
    for side in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", side), side, "left_anti")
    return left, edges.select("src", "dst", "edge_type")


def adjacency(edges: DataFrame) -> DataFrame:
    """(edge_type, src, dsts): the nested form of the edges, targets in order."""
    return edges.groupBy("edge_type", "src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


def from_adjacency(nested: DataFrame) -> DataFrame:
    return nested.select("src", F.explode("dsts").alias("dst"), "edge_type")


def related(edges: DataFrame, nodes: DataFrame, starts: DataFrame, limit: int = RELATED) -> DataFrame:
    """(start) -> (start, pos, relation, symbol, file, line): callers, then callees, then subclasses, ``limit`` in all."""
    steps = [f(edges, starts).withColumn("pos", F.lit(k)).withColumn("relation", F.lit(name)) for k, (name, f) in enumerate((("caller", callers_of), ("callee", callees_of), ("subclass", subclasses_of)))]
    found = reduce(DataFrame.unionByName, steps).join(nodes.where("type = 'symbol'"), F.col("node") == F.col("node_id"))
    place = F.row_number().over(W.partitionBy("start").orderBy("pos", "node"))
    return found.withColumn("pos", place).where(F.col("pos") <= limit).select("start", "pos", "relation", F.col("qualified").alias("symbol"), F.col("path").alias("file"), "line")
