"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised and closed by an end id; longer ones are cut into pieces of the capacity,
of which only the first may be shorter. Whole pieces fill a sequence of their own. The rest is
dealt by hash into blocks of a few thousand pieces, and each block is packed by a grouping genetic
algorithm: a chromosome is a list of bins; crossover injects whole well-filled bins of one parent
into the other, removes bins that now hold duplicates, and best-fits the displaced pieces, largest
first. Several islands evolve each block from different seeds in tasks of their own; between epochs
each island's elite migrates to the next island, in blocks that aren't at their lower bound yet. A
block's best packing is kept. Bins that stay
poorly filled at the end are dissolved and packed once more across blocks.

All sizes are bounded: a block by its expected ``BLOCK_PIECES``, a migrant by its block.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, short, table
from lodestrata.llm.tokens import default_path, encoder_of

CAPACITY = 2048
END_ID = 0
BLOCK_PIECES = 4096
ISLANDS, MIGRATIONS, POPULATION, GENERATIONS = 2, 2, 5, 8
#: Bins filled to this share at least are injected by crossover.
WELL_FILLED = 0.995
#: Bins filled to less are dissolved in the round across blocks.
POOR = 0.98
PIECES = "piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class _Free:
    """Bins by what is free in them; a bit for each amount finds the tightest fit."""

    __slots__ = ("by", "mask")

    def __init__(self) -> None:
        self.by: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, bin_: int, free: int) -> None:
        at = self.by.get(free)
        if at:
            at.append(bin_)
        else:
            self.by[free] = [bin_]
            self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        left = self.mask >> size
        if not left:
            return None
        free = size + (left & -left).bit_length() - 1
        at = self.by[free]
        bin_ = at.pop()
        if not at:
            self.mask ^= 1 << free
        return bin_, free


def best_fit(sizes: list[int], bins: list[list[int]], items: list[int], capacity: int) -> list[list[int]]:
    """Add items, in the order given, each to the fullest bin that still holds it."""
    free = _Free()
    for k, b in enumerate(bins):
        if left := capacity - sum(sizes[i] for i in b):
            free.put(k, left)
    for i in items:
        size = sizes[i]
        hit = free.take(size)
        if hit is None:
            bins.append([i])
            if capacity > size:
                free.put(len(bins) - 1, capacity - size)
        else:
            k, left = hit
            bins[k].append(i)
            if left > size:
                free.put(k, left - size)
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Less is better: number of bins, then how unevenly they are filled."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(sizes: list[int], host: list[list[int]], donor: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    filled = [b for b in donor if sum(sizes[i] for i in b) >= WELL_FILLED * capacity]
    if filled:
        take = rng.random(len(filled)) < 0.5
        filled = [b for b, t in zip(filled, take, strict=True) if t]
    used = {i for b in filled for i in b}
    kept, displaced = [list(b) for b in filled], []
    for b in host:
        if used.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in used]
    # Poorly filled bins are opened as well, so that new matches can form.
    stay = []
    for b in kept:
        if sum(sizes[i] for i in b) < WELL_FILLED * capacity and rng.random() < 0.6:
            displaced += b
        else:
            stay.append(b)
    return best_fit(sizes, stay, sorted(displaced), capacity)


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer: by volume, and as no two pieces beyond half the capacity share a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def evolve(sizes: list[int], start: list[list[list[int]]], capacity: int, seed: int) -> list[list[int]]:
    """Sizes in falling order; ``start``: elites to begin with. The best packing found."""
    rng = np.random.default_rng(seed)
    least = least_bins(sizes, capacity)
    every = list(range(len(sizes)))
    people = [[list(b) for b in one] for one in start] or [best_fit(sizes, [], every, capacity)]
    score = [fitness(sizes, p, capacity) for p in people]
    if min(score)[0] > least:
        while len(people) < POPULATION:
            # Largest first, but for some noise.
            noisy = sorted(every, key=lambda i, noise=rng.normal(0, 0.03 * capacity, len(sizes)): -sizes[i] + noise[i])
            people.append(best_fit(sizes, [], noisy, capacity))
            score.append(fitness(sizes, people[-1], capacity))
        for _ in range(GENERATIONS):
            if min(score)[0] <= least:
                break
            order = sorted(range(len(people)), key=score.__getitem__)
            host, donor = people[order[0]], people[order[1 + int(rng.integers(len(order) - 1))]]
            if rng.random() < 0.5:
                host, donor = donor, host
            child = crossover(sizes, host, donor, capacity, rng)
            own = fitness(sizes, child, capacity)
            if own < score[order[-1]]:
                people[order[-1]], score[order[-1]] = child, own
    return people[min(range(len(people)), key=score.__getitem__)]


def _places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(places: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(places.max()) + 1)] if len(places) else []
    for i, k in enumerate(places):
        out[k].append(i)
    return out


def _epoch(rows: DataFrame, capacity: int, epoch: int, tasks: int) -> DataFrame:
    """Rows (block, island, sizes, elites) -> (block, island, sizes, n_bins, least, elite)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in short(batches):
            made = []
            for block, island, sizes, elites in zip(batch["block"], batch["island"], batch["sizes"], batch["elites"], strict=True):
                own = [int(s) for s in sizes]
                best = evolve(own, [_bins(np.asarray(e)) for e in elites], capacity, seed=(int(block) * ISLANDS + int(island)) * MIGRATIONS + epoch)
                made.append((block, island, sizes, len(best), least_bins(own, capacity), _places(best, len(own))))
            yield pd.DataFrame(made, columns=["block", "island", "sizes", "n_bins", "least", "elite"])

    return rows.repartition(tasks, "block", "island").mapInPandas(run, "block long, island int, sizes array<int>, n_bins int, least int, elite array<int>")


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Rows (pid, length), lengths from 1 to below capacity -> (pid, block, bin, offset)."""
    n = pieces.count()
    blocks = max(1, math.ceil(n / block_pieces))
    dealt = pieces.select("pid", "length", F.pmod(F.xxhash64("pid", F.lit(blocks)), F.lit(blocks)).alias("block"))
    # In falling order of length, ties by pid: the order in which a packing names its pieces.
    grouped = dealt.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("length"), asc=False), lambda x: x.cast("int")).alias("sizes"))
    none = F.array().cast("array<array<int>>")
    islands = grouped.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "sizes").withColumn("elites", none)
    tasks = blocks * ISLANDS
    ended = []
    for epoch in range(MIGRATIONS):
        settled = materialize(_epoch(islands, capacity, epoch, tasks), "islands")
        ended.append(settled)
        # A block that has as few bins as any packing can have is done; the others' elites migrate.
        open_ = materialize(settled.groupBy("block").agg(F.min(F.col("n_bins") - F.col("least")).alias("over")).where("over > 0").select("block"), "open")
        more = epoch + 1 < MIGRATIONS and not open_.isEmpty()
        if not more:
            drop_table(open_)
            break
        on = settled.join(open_, "block", "left_semi")
        guests = on.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("guest"))
        islands = on.join(guests, ["block", "island"]).select("block", "island", "sizes", F.array("elite", "guest").alias("elites"))
    every = functools.reduce(DataFrame.unionByName, [e.select("block", "n_bins", "island", "elite") for e in ended])
    best = every.groupBy("block").agg(F.min(F.struct("n_bins", "island", "elite")).alias("b")).select("block", F.col("b.elite").alias("elite"))

    def place(own: pd.DataFrame, packing: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "pid"], ascending=[False, True])
        own["bin"] = packing["elite"].iloc[0]
        own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
        return own[["pid", "block", "length", "bin", "offset"]]

    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, "pid long, block long, length long, bin long, offset long")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: id, piece, start, length, ids_crc32 (and ids)."""
    path = tokenizer or default_path()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for batch in short(batches):
            made = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length]
                    made.append((i, k, start, length, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
            yield pd.DataFrame(made, columns=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, {PIECES}" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Null ids stay null; repeated rows are packed as often
    as they stand there; other columns are ignored; an empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, end_id, tokenizer, with_ids).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "pid"]
    whole = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    partial = pieces.where(F.col("length") < capacity)
    first = materialize(pack_lengths(partial.select("pid", "length"), capacity), "packed")
    # Across blocks: bins that stayed poorly filled are packed again together.
    poor = first.groupBy("block", "bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < POOR * capacity).select("block", "bin")
    loose = materialize(first.join(poor, ["block", "bin"], "left_semi").select("pid", "length"), "loose")
    again = pack_lengths(loose, capacity)
    kept = first.join(poor, ["block", "bin"], "left_anti")
    number = lambda odd: (F.col("block") * 2 + odd) * (1 << 24) + F.col("bin")
    placed = kept.select("pid", number(0).alias("sequence_id"), "offset").unionByName(again.select("pid", number(1).alias("sequence_id"), "offset"))
    return partial.join(placed, "pid").select(*columns, "sequence_id", "offset").unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack_documents(with_ids=True)``: sequence_id, ids, piece_starts."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("piece_starts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
