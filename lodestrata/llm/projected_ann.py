"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Largest inner product is turned into least Euclidean distance: every vector gets one more component,
sqrt(M^2 - |x|^2) with M the greatest norm, and a query gets zero there. A few Gaussian (2-stable)
projections follow. Whatever lies at distance d lies, projected, at a squared distance of d^2 times
a chi-square variable with as many degrees of freedom as there are projections.

Vectors are dealt by a kd-split of the projections, learned on a bounded sample, into cells, and a
cell of many into blocks; each block's kd-tree is built once and stored with its vectors. A query
first searches its own cell. What it has found bounds the other cells that it is sent to: those
whose boxes pass the stopping test already stay untouched. In a block it walks the tree's nodes in
the order of their boxes' projected distance and verifies a leaf's vectors against the originals. It
stops once the next node is so far that any closer vector beyond it would have to have drawn a
chi-square value above its ``CERTAINTY`` quantile.

Of equal vectors only the ``neighbours`` + 1 smallest ids can ever be among a query's nearest, so no
others are kept as candidates. Many queries of one block are dealt to several tasks: a stated query
set against all rows, in blocks.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, table

PROJECTIONS = 8
LEAF = 256
NEIGHBOURS = 20
QUERY_EVERY = 20
#: Quantile of the chi-square distribution at which a query stops.
CERTAINTY = 0.90
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
#: Cells that the first split makes, at most, and vectors that it is learned on.
CELLS, SAMPLE = 512, 8192
SEED = 5


def chi_square_quantile(p: float, k: int) -> float:
    """By bisection on the regularised incomplete gamma function's series."""

    def cdf(x: float) -> float:
        a, h = k / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    low, high = 1e-9, 10.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return low


def box_distances(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances from one point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=-1)


def kd_split(points: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, value, left, right) of a split into ``parts`` cells of about equal numbers; child -1 - c is cell c."""
    nodes: list[list] = []
    stack = [(points, parts, -1, 0)]
    cells = 0
    while stack:
        own, n, parent, side = stack.pop()
        if n == 1:
            here, cells = -1 - cells, cells + 1
        else:
            here, left = len(nodes), n // 2
            spread = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(points.shape[1])
            axis = int(np.argmax(spread))
            value = float(np.quantile(own[:, axis], left / n)) if len(own) else 0.0
            nodes.append([axis, value, 0, 0])
            below = own[:, axis] < value
            stack += [(own[below], left, here, 2), (own[~below], n - left, here, 3)]
        if parent >= 0:
            nodes[parent][side] = here
    return [tuple(n) for n in nodes]


def cells_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    at = np.full(len(points), 0 if nodes else -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        axis, value, left, right = (np.array(x) for x in zip(*[nodes[k] for k in at[inner]], strict=True))
        at[inner] = np.where(points[inner, axis] < value, left, right)
    return -1 - at


class ProjectedTree:
    """A block's vectors and a balanced kd-tree over their projections.

    Equal vectors are one point, with their ids in order. Nodes are arrays: box, children (-1 for
    none) and the slice of the points below them, which lie in the tree's order.
    """

    ARRAYS = ("vectors", "members", "begin", "low", "high", "left", "right", "first", "last")

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, greatest: float, leaf: int = LEAF) -> ProjectedTree:
        tree = cls()
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        distinct, group = np.unique(vectors, axis=0, return_inverse=True)
        own = distinct.astype(np.float64)
        rest = np.sqrt(np.maximum(greatest**2 - (own**2).sum(axis=1), 0))
        points = np.column_stack([own, rest]) @ axes
        order = np.arange(len(points))
        low, high, left, right, first, last = [], [], [], [], [], []
        stack = [(0, len(points), -1, None)]
        while stack:
            a, b, parent, side = stack.pop()
            part = points[order[a:b]]
            here = len(low)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            left.append(-1)
            right.append(-1)
            first.append(a)
            last.append(b)
            if parent >= 0:
                side[parent] = here
            if b - a > leaf:
                axis, mid = int(np.argmax(high[-1] - low[-1])), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
                stack += [(a + mid, b, here, right), (a, a + mid, here, left)]
        tree.low, tree.high = np.stack(low), np.stack(high)
        tree.left, tree.right, tree.first, tree.last = (np.array(x) for x in (left, right, first, last))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tree.vectors = distinct[order]
        group = place[group.ravel()]
        by_group = np.argsort(group, kind="stable")
        tree.members, tree.begin = ids[by_group], np.searchsorted(group[by_group], np.arange(len(order) + 1))
        return tree

    def dumps(self) -> bytes:
        buffer = io.BytesIO()
        np.savez(buffer, **{n: getattr(self, n) for n in self.ARRAYS})
        return buffer.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> ProjectedTree:
        tree = cls()
        with np.load(io.BytesIO(data)) as held:
            for n in cls.ARRAYS:
                setattr(tree, n, held[n])
        return tree

    @property
    def leaves(self) -> int:
        return int((self.left < 0).sum())

    def search(self, own: int, query: np.ndarray, shown: np.ndarray, greatest: float, bound: float, neighbours: int = NEIGHBOURS, least: float = -math.inf) -> tuple[list[tuple[float, int]], int]:
        """([(product, -id)] of the best, at most ``neighbours`` and none below ``least``; leaves visited)."""
        norms = float(query @ query) + greatest**2
        best: list[tuple[float, int]] = []  # a heap, the worst first
        nodes, visited = [(float(box_distances(self.low[0], self.high[0], shown)), 0)], 0
        while nodes:
            far, node = heapq.heappop(nodes)
            worst = max(best[0][0], least) if len(best) == neighbours else least
            # Squared distance of the worst of the best; nothing nearer is to be expected beyond the bound.
            if far > bound * max(norms - 2 * worst, 0.0):
                break
            if self.left[node] >= 0:
                below = [self.left[node], self.right[node]]
                for d, k in zip(box_distances(self.low[below], self.high[below], shown).tolist(), below, strict=True):
                    heapq.heappush(nodes, (d, int(k)))
                continue
            visited += 1
            a, b = self.first[node], self.last[node]
            products = self.vectors[a:b].astype(np.float64, copy=False) @ query
            good = np.flatnonzero(products >= worst)
            if len(good) > neighbours + 1:
                # All that tie with the last of so many stay.
                cut = np.partition(products[good], len(good) - neighbours - 1)[len(good) - neighbours - 1]
                good = good[products[good] >= cut]
            for k in good[np.argsort(-products[good], kind="stable")].tolist():
                score = float(products[k])
                if len(best) == neighbours and score < best[0][0]:
                    break
                for i in self.members[self.begin[a + k] : self.begin[a + k + 1]][: neighbours + 1].tolist():
                    if i == own:
                        continue
                    if len(best) < neighbours:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                    else:
                        break
        return best, visited


def axes_of(dim: int, seed: int = SEED) -> np.ndarray:
    """Gaussian projections of vectors with their further component."""
    return np.random.default_rng(seed).normal(size=(dim + 1, PROJECTIONS))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS, certainty: float = CERTAINTY, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its nearest by inner product.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own. Vectors that are null, zero, of another length than most or that hold a null or non-finite
    component take no part, nor do rows with a null id; of several rows of one id and vector one
    takes part. With fewer candidates all are returned; an empty table gives no rows. Other columns
    are ignored.
    """
    return searched(vectors, id_col, vector_col, every, neighbours, certainty, vector_block, query_block)[0]


def searched(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS, certainty: float = CERTAINTY, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """What ``nearest`` returns, and one row (leaves, visited): summed over all queries and all blocks of all cells."""
    spark = vectors.sparkSession
    v = F.col("v")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & usable)
    clean = materialize(clean.dropDuplicates(), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = clean.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(squares).alias("norm")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), spark.createDataFrame([], "leaves long, visited long")
    dim, n, norm = facts[0]
    greatest, axes, bound = math.sqrt(norm), axes_of(dim), chi_square_quantile(certainty, PROJECTIONS)
    clean = clean.where(F.size("v") == dim)

    def shown(batch: pd.Series, as_query: bool = False) -> np.ndarray:
        own = np.stack(batch.to_numpy()).astype(np.float64)
        rest = 0 if as_query else np.sqrt(np.maximum(greatest**2 - (own**2).sum(axis=1), 0))
        return own @ axes[:dim] + np.multiply.outer(rest * np.ones(len(own)), axes[dim])

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        return pd.Series(list(shown(batch)))

    # A row count and a bounded sample of projections are all that the split is learned on.
    one_in = max(1, n // SAMPLE)
    sample = clean.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(one_in)) == 0).select("id", project("v").alias("p")).orderBy(F.xxhash64("id"), "id", "p").limit(SAMPLE).collect()
    nodes = kd_split(np.array([r.p for r in sample]).reshape(-1, PROJECTIONS), min(CELLS, max(1, -(-n // vector_block))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells_of(nodes, shown(batch["v"])).astype(np.int32))

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = pd.DataFrame(shown(batch["v"]))
                by = batch["cell"].to_numpy()
                low, high = points.groupby(by).min(), points.groupby(by).max()
                yield pd.DataFrame({"cell": low.index.astype(np.int32), "n": points.groupby(by).size().to_numpy(), "low": list(low.to_numpy()), "high": list(high.to_numpy())})

    smallest = F.row_number().over(W.partitionBy("v").orderBy("id"))
    held = materialize(clean.withColumn("nth", smallest).where(F.col("nth") <= neighbours + 1).drop("nth").mapInPandas(place, f"id long, v {kind}, cell int"), "cells")
    edges = lambda name, f: F.array(*[f(F.col(name)[k]) for k in range(PROJECTIONS)]).alias(name)
    cells = held.mapInPandas(outline, "cell int, n long, low array<double>, high array<double>").groupBy("cell").agg(F.sum("n").alias("n"), edges("low", F.min), edges("high", F.max)).orderBy("cell").collect()
    low, high = np.array([r.low for r in cells]), np.array([r.high for r in cells])
    blocks = np.array([max(1, -(-r.n // vector_block)) for r in cells])
    begin = np.concatenate([[0], np.cumsum(blocks)])
    number = {r.cell: k for k, r in enumerate(cells)}

    @F.pandas_udf("int")
    def block_of(cell: pd.Series, salt: pd.Series) -> pd.Series:
        at = cell.map(number).to_numpy()
        return pd.Series(begin[at] + salt.to_numpy() % blocks[at], dtype="int32")

    def build(own: pd.DataFrame) -> pd.DataFrame:
        tree = ProjectedTree.build(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), axes, greatest)
        return pd.DataFrame({"block": [own["block"].iloc[0]], "leaves": [tree.leaves], "tree": [tree.dumps()]})

    dealt = held.select("id", "v", block_of("cell", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))).alias("block"))
    trees = materialize(dealt.repartition(int(begin[-1]), "block").groupBy("block").applyInPandas(build, "block int, leaves long, tree binary"), "trees")

    asks = materialize(clean.where(F.col("id") % every == 0), "queries")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, q, point in zip(batch["id"], batch["v"], shown(batch["v"], True) if len(batch) else (), strict=True):
                c = int(np.argmin(box_distances(low, high, point)))
                own = range(begin[c], begin[c + 1])
                yield pd.DataFrame({"id": i, "v": [q] * len(own), "least": -math.inf, "block": np.array(own, np.int32)})

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, q, least, point in zip(batch["id"], batch["v"], batch["least"], shown(batch["v"], True) if len(batch) else (), strict=True):
                far = box_distances(low, high, point)
                reach = far <= bound * max(float(np.asarray(q, np.float64) @ np.asarray(q, np.float64)) + greatest**2 - 2 * least, 0.0)
                reach[np.argmin(far)] = False
                own = np.concatenate([np.arange(begin[c], begin[c + 1]) for c in np.flatnonzero(reach)] or [np.empty(0, int)]).astype(np.int32)
                yield pd.DataFrame({"id": np.full(len(own), i, np.int64), "v": pd.Series([q] * len(own), dtype="object"), "least": np.full(len(own), least), "block": own})

    def search(key: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        made: list[tuple] = []
        if len(tree) and len(queries):
            held, points = ProjectedTree.loads(tree["tree"].iloc[0]), shown(queries["v"], True)
            held.vectors = held.vectors.astype(np.float64)
            for i, q, least, point in zip(queries["id"].tolist(), queries["v"], queries["least"], points, strict=True):
                best, visited = held.search(i, np.asarray(q, np.float64), point, greatest, bound, neighbours, least)
                made += [(i, -k, s, 0) for s, k in best] + [(i, None, None, visited)]
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score", "visited"]).astype({"query_id": "int64", "vec_id": "Int64", "score": "float64", "visited": "int64"})

    def answers(sent: DataFrame, name: str) -> DataFrame:
        sent = materialize(sent, f"{name}-sent")
        # Blocks that many queries ask are searched by several tasks.
        parts = sent.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
        copies = trees.join(parts, "block").select("block", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        asked = sent.join(F.broadcast(parts) if len(cells) == int(begin[-1]) else parts, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int")).drop("parts")
        both = copies.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
        found = materialize(both.applyInPandas(search, "query_id long, vec_id long, score double, visited long"), name)
        drop_table(sent)
        return found

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    first = answers(asks.mapInPandas(home, f"id long, v {kind}, least double, block int"), "home")
    last = ranked(first).where(F.col("rank") == neighbours).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    again = asks.join(last, "id", "left").select("id", "v", F.coalesce("least", F.lit(-math.inf)).alias("least"))
    found = first
    if len(cells) > 1:
        found = first.unionByName(answers(again.mapInPandas(elsewhere, f"id long, v {kind}, least double, block int"), "elsewhere"))
    stats = trees.agg(F.sum("leaves").alias("leaves")).crossJoin(asks.agg(F.count("*").alias("asked"))).select((F.col("leaves") * F.col("asked")).alias("leaves")).crossJoin(found.agg(F.sum("visited").alias("visited")))
    drop_table(held)
    return ranked(found).select("query_id", "rank", "vec_id", "score"), stats


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Exact neighbours; the query's recall against these rows is measured in the tests.
EXACT_SQL = """
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
) WHERE rank <= 20
"""
