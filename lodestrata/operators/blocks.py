"""BM25 over blocks of postings, with bounds that let most blocks be skipped.

Documents are numbered and cut into ranges of ``1 << BITS``; a block holds one term's postings of one
range. Beside them it keeps the pairs (tf, dl) that no other posting of it beats in both, from which
the greatest contribution of the block follows for any mean length, so blocks stay valid while the
corpus changes around them. The sum of its blocks' bounds is a bound on every score in a range.

A search deals the blocks of its queries' terms out by range, some hundreds of ranges to a task, and
each task scores the most promising ranges of each query first. The score that ends its best ``k`` is a
threshold; of all other ranges only those whose bound reaches it are scored. Nothing is lost: a
document of a skipped range scores less than ``k`` others. No pair of a query and a range or a document
leaves a task, but the best ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.functions.terms import half_up
from lodestrata.operators.lexical import B, K1, exploded, idf
from lodestrata.operators.lexical_tasks import QUERIES, Weights
from lodestrata.storage import materialize

BITS = 4
#: Postings that a task makes into blocks, and documents that a task searches, about.
POSTINGS_PER_TASK, DOCUMENTS_PER_TASK = 1_000_000, 16_384
#: A range's number holds its place within a task in so many bits, and above them the task's, in ``PART_BITS``.
PLACE_BITS, PART_BITS = 20, 12
#: Ranges of each query that a task scores before there is a threshold.
SEEDS = 4
#: Values up to which terms or ranges become a filter on the stored table.
FILTER_VALUES = 1024
#: More of them up to which a list is broadcast, at some 50 bytes each.
BROADCAST_VALUES = 100_000
#: Rounding of sums can't lift a score above its bound by more.
SLACK = 1e-5


@dataclass(frozen=True)
class Blocks:
    """``documents``: (range, slot, keys); ``postings``: (range, term, n, terms, peaks, entries), entries (tf, less, slot) with a negative length; ``dead``: (range, slot) of documents
    that count no more; ``size``: how many do, and the sum of their lengths."""

    documents: DataFrame
    postings: DataFrame
    size: tuple[int, int]
    dead: DataFrame | None = None


def peaks(entries: Column) -> Column:
    """Of entries by falling tf, then rising dl: those that are shorter than all before them."""
    none = F.array().cast("array<struct<tf:int,dl:int>>")
    beats = lambda kept, e: (F.size(kept) == 0) | (-e["less"] < F.element_at(kept, -1)["dl"])
    return F.aggregate(entries, none, lambda kept, e: F.when(beats(kept, e), F.concat(kept, F.array(F.struct(e["tf"].alias("tf"), (-e["less"]).alias("dl"))))).otherwise(kept))


def in_ranges(numbered: DataFrame, bits: int = BITS, first: int = 0) -> DataFrame:
    """(ord, ...) -> (range, slot, ...): ``ord`` counts from 0, ``first`` is the first range's number."""
    place = F.col("ord")
    return numbered.withColumn("range", F.shiftright(place, bits) + first).withColumn("slot", place.bitwiseAND((1 << bits) - 1).cast("int")).drop("ord")


def posting_blocks(texts: DataFrame, tokens: Column) -> DataFrame:
    """(range, slot, ...) -> (range, term, n, terms, peaks, entries), in order of term within each task.

    Rows are dealt by range once, before ``tokens`` is evaluated, as texts are shorter than their terms.
    """
    dealt = texts.repartition("range").select("range", "slot", tokens.alias("tokens")).select("range", "slot", F.size("tokens").alias("dl"), "tokens")
    counts = exploded(dealt, "range", "slot", "dl").groupBy("range", "slot", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    entries = F.sort_array(F.collect_list(F.struct("tf", (-F.col("dl")).alias("less"), "slot")), asc=False).alias("entries")
    blocks = counts.groupBy("range", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("terms"), entries)
    alone = F.array(F.struct(F.col("entries")[0]["tf"].alias("tf"), (-F.col("entries")[0]["less"]).alias("dl")))
    most = F.when(F.col("n") == 1, alone).otherwise(peaks(F.col("entries")))
    return blocks.select("range", "term", "n", "terms", most.alias("peaks"), "entries").sortWithinPartitions("term", "range")


_PEAK, _ENTRY = pa.struct([("tf", pa.int32()), ("dl", pa.int32())]), pa.struct([("tf", pa.int32()), ("less", pa.int32()), ("slot", pa.int32())])
_BLOCKS = "range long, term string, n long, terms long, peaks array<struct<tf:int,dl:int>>, entries array<struct<tf:int,less:int,slot:int>>"


def tasks_for(postings: int) -> int:
    """So many that a task's share of postings doesn't grow with their number."""
    return min(max(1, -(-postings // POSTINGS_PER_TASK)), (1 << PART_BITS) - 1)


def stored_counts(counts: DataFrame) -> tuple[DataFrame, tuple[int, int, int]]:
    """``counts`` as a table, and its rows, the sum of their lengths and that of their postings, counted while it is written."""
    seen, zero = Observation(), F.lit(0).cast("long")
    of = {"n": F.count("*"), "words": F.coalesce(F.sum("dl"), zero), "postings": F.coalesce(F.sum(F.size("terms").cast("long")), zero)}
    stored = materialize(counts.observe(seen, *[c.alias(k) for k, c in of.items()]), "term-counts")
    return stored, (seen.get["n"], seen.get["words"], seen.get["postings"])


def ranged(rows: DataFrame, tasks: int, *keys: str, bits: int = BITS, first: int = 0) -> DataFrame:
    """``rows`` with ``range`` and ``slot`` in order of ``keys``, which aren't repeated; no range lies in two tasks."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("at", place)
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    number = F.shiftleft(F.shiftright("at", 33), PLACE_BITS) + F.shiftright(within, bits) + first
    return dealt.withColumn("range", number).withColumn("slot", within.bitwiseAND((1 << bits) - 1).cast("int")).drop("at")


def counted_blocks(counts: DataFrame, tasks: int) -> DataFrame:
    """(range, slot, dl, terms, tfs) -> what ``posting_blocks`` makes of their terms, with no more than a range of postings as objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, {}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                ranges, names, entries = [], [], []
                for r in batch.slice(begin, 256).to_pylist():
                    if r["range"] != at:
                        ranges += [at] * len(found)
                        names += found
                        entries += found.values()
                        at, found = r["range"], {}
                    less, slot = -r["dl"], r["slot"]
                    for t, tf in zip(r["terms"], r["tfs"], strict=True):
                        found.setdefault(t, []).append((tf, less, slot))
                if ranges:
                    yield _block_batch(ranges, names, entries)
        if found:
            yield _block_batch([at] * len(found), list(found), list(found.values()))

    dealt = counts.select("range", "slot", "dl", "terms", "tfs").repartition(tasks, "range").sortWithinPartitions("range", "slot")
    return dealt.mapInArrow(run, _BLOCKS).sortWithinPartitions("term", "range")


def _block_batch(ranges: list[int], names: list[str], entries: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    peaks, sizes = [], []
    for own in entries:
        own.sort(reverse=True)
        before = len(peaks)
        for tf, less, _ in own:
            if len(peaks) == before or -less < peaks[-1][1]:
                peaks.append((tf, -less))
        sizes.append(len(peaks) - before)

    def nested(counts: list[int], rows: list[tuple], kind: pa.StructType) -> pa.ListArray:
        columns = zip(*rows, strict=True) if rows else [()] * kind.num_fields
        flat = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), flat)

    n = [len(own) for own in entries]
    columns = [pa.array(ranges, pa.int64()), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array([sum(e[0] for e in own) for own in entries], pa.int64()), nested(sizes, peaks, _PEAK), nested(n, [e for own in entries for e in own], _ENTRY)]
    return pa.RecordBatch.from_arrays(columns, names=["range", "term", "n", "terms", "peaks", "entries"])


def stored_blocks(df: DataFrame, write: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """What ``write`` makes of posting blocks, and how many terms they hold, counted on the way."""
    seen = Observation()
    stored = write(df.observe(seen, F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")))
    return stored, seen.get["terms"]


def pushed(stored: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """Rows whose ``column`` is asked for, as a filter that reaches the scan while the values are few."""
    wanted = asked.select(column).distinct()
    few = [r[0] for r in wanted.limit(FILTER_VALUES + 1).collect()]
    if len(few) <= FILTER_VALUES:
        return stored.where(F.col(column).isin(few))
    some = wanted.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    return stored.join(F.broadcast(wanted) if some else wanted, column, "left_semi")


@dataclass(frozen=True)
class Search:
    """``hits``: (query_id, range, slot, score), ties with the last one included; ``effort``: (query_id, blocks, blocks_read)."""

    hits: DataFrame
    effort: DataFrame


def _first(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query and all that tie with the last of them."""
    place = F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    return scores.withColumn("place", place).where(F.col("place") <= k).drop("place")


def term_weights(blocks: Blocks, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, term, qtf) -> with ``idf``, of documents that count."""
    known = pushed(blocks.postings, "term", queries)
    df = known.groupBy("term").agg(F.sum("n").alias("df"))
    if blocks.dead is not None:
        # Only blocks of ranges with dead documents are opened for them.
        touched = known.join(blocks.dead.select("range").distinct(), "range", "left_semi").select("term", "range", F.explode("entries").alias("e"))
        lost = touched.select("term", "range", F.col("e.slot").alias("slot")).join(blocks.dead, ["range", "slot"], "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
        df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).where("df > 0")
    return queries.join(df, "term").select("query_id", "term", "qtf", idf(F.lit(n), F.col("df")).alias("idf"))


def search(blocks: Blocks, queries: DataFrame, k: int, round_to: int | None = None, seeds: int = SEEDS) -> Search:
    """The best ``k`` documents of each query (query_id, term, qtf) with a score above 0."""
    n, words = blocks.size
    weights = [tuple(r) for r in term_weights(blocks, queries, n).select("query_id", "term", "qtf", "idf").orderBy("query_id", "term").collect()]
    ids = list(dict.fromkeys(q for q, *_ in weights))
    spark, id_kind = blocks.postings.sparkSession, dict(queries.dtypes)["query_id"]
    found = spark.createDataFrame([], f"query_id {id_kind}, range long, slot int, score double, blocks long, blocks_read long")
    for begin in range(0, len(ids), QUERIES):
        own = ids[begin : begin + QUERIES]
        number = {q: i for i, q in enumerate(own)}
        vocabulary = {t: i for i, t in enumerate(sorted({t for q, t, *_ in weights if q in number}))}
        asked = Weights.of([(number[q], vocabulary[t], f, w) for q, t, f, w in weights if q in number], len(vocabulary))
        names = spark.createDataFrame(list(enumerate(own)), f"q int, query_id {id_kind}")
        rows = _pass(blocks, vocabulary, asked, len(own), (words / n if n else 0.0) or 1.0, k, round_to, seeds)
        # As many rows as a pass has queries at most.
        found = found.unionByName(rows.join(F.broadcast(names), "q").drop("q"))
    found = materialize(found, "found")
    effort = found.where("slot < 0").groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("blocks_read").alias("blocks_read"))
    return Search(_first(found.where("slot >= 0").select("query_id", "range", "slot", "score"), k), effort)


def _pass(blocks: Blocks, vocabulary: dict[str, int], weights: Weights, queries: int, avgdl: float, k: int, round_to: int | None, seeds: int) -> DataFrame:
    """(q, range, slot, score) of each task's best, and rows with slot -1 that say how many blocks a query has there and how many were read."""
    spark = blocks.postings.sparkSession
    places = spark.createDataFrame(list(vocabulary.items()), "term string, place int")
    posts = pushed(blocks.postings, "term", places).join(F.broadcast(places) if len(vocabulary) <= BROADCAST_VALUES else places, "term")
    rows = posts.select("range", "place", F.col("peaks.tf").alias("top_tf"), F.col("peaks.dl").alias("top_dl"), F.col("entries.tf").alias("tf"), F.col("entries.less").alias("less"), F.col("entries.slot").alias("slot"))
    if blocks.dead is not None:
        none = F.array().cast("array<int>")
        gone = blocks.dead.groupBy("range").agg(F.collect_list("slot").alias("slot"))
        rows = rows.unionByName(gone.select("range", F.lit(-1).alias("place"), none.alias("top_tf"), none.alias("top_dl"), none.alias("tf"), none.alias("less"), "slot"))
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            yield from _searched(table.combine_chunks(), shared.value, queries, avgdl, k, round_to, seeds)

    tasks = max(1, math.ceil(blocks.size[0] / DOCUMENTS_PER_TASK))
    return rows.repartition(tasks, "range").mapInArrow(run, "q int, range long, slot int, score double, blocks long, blocks_read long")


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat values of a column of lists."""
    lists = table.column(name).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.value_lengths().to_numpy(), lists.flatten().to_numpy()


def _share(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(dl, 1) / avgdl))


def _searched(table: pa.Table, weights: Weights, queries: int, avgdl: float, k: int, round_to: int | None, seeds: int) -> Iterator[pa.RecordBatch]:
    ranges, at = np.unique(table.column("range").to_numpy(), return_inverse=True)
    term = table.column("place").to_numpy()
    order = np.argsort(at, kind="stable")
    order = order[term[order] >= 0]
    sizes, slots = _column(table, "slot")
    width = int(slots.max(initial=0)) + 1
    dead = np.zeros(len(ranges) * width, bool)
    gone = np.repeat(term < 0, sizes)
    dead[(np.repeat(at, sizes) * width + slots)[gone]] = True
    # The greatest contribution of a block, and its postings, as parts of what a term weighs.
    top_sizes, tops = _column(table, "top_tf")
    most = np.zeros(table.num_rows)
    np.maximum.at(most, np.repeat(np.arange(table.num_rows), top_sizes), _share(tops, _column(table, "top_dl")[1], avgdl))
    per_range = np.bincount(at[order], minlength=len(ranges))
    bound = weights.scores(per_range, term[order], most[order], queries)
    blocks = weights.scores(per_range, term[order], np.ones(len(order)), queries, plain=True)
    keep = ~gone
    post_doc, post_term = (np.repeat(at, sizes) * width + slots)[keep], np.repeat(term, sizes)[keep]
    tf, less = _column(table, "tf")[1], _column(table, "less")[1]
    sorted_ = np.argsort(post_doc, kind="stable")
    sorted_ = sorted_[~dead[post_doc[sorted_]]]
    post_doc, post_term, share = post_doc[sorted_], post_term[sorted_], _share(tf, -less, avgdl)[sorted_]
    first = np.searchsorted(post_doc, np.arange(len(ranges) + 1) * width)

    least = np.full(queries, -np.inf)
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(queries)]

    def read(live: np.ndarray) -> None:
        """Score the pairs (range, query) that are marked, some ranges at a time."""
        some = np.flatnonzero(live.any(1))
        for begin in range(0, len(some), 16):
            own = some[begin : begin + 16]
            place = np.concatenate([np.arange(first[r], first[r + 1]) for r in own])
            doc = np.concatenate([r * width + np.arange(width) for r in own])
            per_doc = np.bincount(np.searchsorted(doc, post_doc[place]), minlength=len(doc))
            exact = weights.scores(per_doc, post_term[place], share[place], queries)
            score = half_up(exact, round_to)
            query, row = np.nonzero(((exact > 0) & np.repeat(live[own], width, 0) & (score >= least)).T)
            for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1) if len(query) else ():
                q = int(query[part[0]])
                docs, scores = (np.concatenate([old, new]) for old, new in zip(kept[q] or (np.empty(0, np.int64), np.empty(0)), (doc[row[part]], score[row[part], q]), strict=True))
                if len(scores) >= k:
                    # What ties with the last of the best stays.
                    least[q] = np.partition(scores, len(scores) - k)[len(scores) - k]
                    docs, scores = docs[scores >= least[q]], scores[scores >= least[q]]
                kept[q] = [docs, scores]

    asked = bound > 0
    begun = np.zeros_like(asked)
    # The ranges with the greatest bounds of each query, ties to the lesser number.
    best_first = np.argsort(-bound, axis=0, kind="stable")[:seeds]
    np.put_along_axis(begun, best_first, True, 0)
    begun &= asked
    read(begun)
    rest = asked & ~begun & (bound >= least - SLACK)
    read(rest)
    every, taken = blocks.sum(0), (blocks * (begun | rest)).sum(0)
    columns = [(q, int(ranges[d // width]), int(d % width), float(s), 0, 0) for q, own in enumerate(kept) if own for d, s in zip(own[0].tolist(), own[1].tolist(), strict=True)]
    columns += [(q, 0, -1, 0.0, int(every[q]), int(taken[q])) for q in range(queries) if every[q]]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
    if columns:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*columns, strict=True), kinds, strict=True)], names=["q", "range", "slot", "score", "blocks", "blocks_read"])


def best(found: Search, blocks: Blocks, k: int, *key: str) -> DataFrame:
    """(query_id, key, score, rank): the best ``k``, from rank 0, ties in order of ``key``."""
    named = found.hits.join(blocks.documents.select("range", "slot", *key), ["range", "slot"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *key)) - 1
    return named.withColumn("rank", rank).where(F.col("rank") < k).select("query_id", *key, "score", "rank")
