"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts. For each of ``SAMPLES`` samples every
weighted word draws two gamma variates and one uniform from a hash of (word, sample), so equal
words draw alike everywhere; the word with the least value a is the sample, together with its
quantised log weight t. The chance that two documents agree in a sample is their generalised
Jaccard similarity, sum of least over sum of greatest weights. A sample is stored in 16 bits, and
the likeness is corrected for chance agreement.

Neighbouring documents are compared through one range-partitioned pass over the texts: block
bounds come from ids and the beginnings of texts, a block's first document is sent to the block before it as well,
and each task streams through its rows with one document kept in hand.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import short, table

SAMPLES = 128
SAMPLE_BITS = 16
#: Words whose draws for weight 1 one worker keeps, at about 660 bytes each; others are drawn anew.
KEPT_WORDS = 1 << 18
#: Repeated words whose draws one worker keeps; beyond it they are drawn anew.
KEPT_HEAVY = 8192
#: Words drawn anew, as a multiple of those kept, after which the table is filled afresh.
MISSED = 4
#: Documents in a block, about; blocks are smaller only as long as they are too few for the cores.
BLOCK_ROWS, LEAST_ROWS = 65_536, 4096
#: Code points of a text that bounds between rows of one id hold.
BOUND_CHARS = 64

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHANCE = 1.0 / (1 << SAMPLE_BITS)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Slots(dict):
    """Places in the table of draws: the first words met have one, others -1."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) == self.size:
            return -1
        self[word] = slot = len(self)
        return slot


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class Sampler:
    """Consistent weighted samples of bags of words.

    Draws come from a word's 64-bit hash. Those for weight 1 fill one table as words are first met;
    what finds no place there is drawn anew each time, and after many of these the table is filled
    afresh. Only words of more weight need all three draws, and recent ones are kept.
    """

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT_HEAVY, kept_words: int = KEPT_WORDS) -> None:
        self.samples = samples
        self.first = np.empty((kept_words, samples), np.float32)
        self.feature = np.empty(kept_words, np.uint64)
        self.heavy = np.empty((kept, 3, samples), np.float32)
        self.place = np.empty(kept_words, np.int32)
        self.slots = _Slots(kept_words)
        self.lane = np.arange(samples)
        self._clear()

    def _clear(self) -> None:
        self.slots.clear()
        self.place[:] = -1
        self.drawn = self.held = self.missed = 0

    def _draw(self, features: np.ndarray) -> np.ndarray:
        """For each feature r, beta and log c of every sample."""
        with np.errstate(over="ignore"):
            # Each 64 bits give two numbers of 24 bits.
            lanes = np.arange(1, self.samples * 3 + 1, dtype=np.uint64) * _STEP
            bits = _mix(_mix(features + np.uint64(1))[:, None] + lanes[None, :])
        u = np.concatenate([(bits >> np.uint64(40)).astype(np.float32), ((bits[:, : self.samples * 2] >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32)], axis=1)
        u = ((u + np.float32(0.5)) * np.float32(2.0**-24)).reshape(len(features), 5, self.samples)
        return np.stack([-np.log(u[:, 0] * u[:, 1]), u[:, 4], np.log(-np.log(u[:, 2] * u[:, 3]))], axis=1)

    def _light(self, features: np.ndarray) -> np.ndarray:
        r, beta, log_c = self._draw(features).transpose(1, 0, 2)
        return log_c + r * beta - r

    def _all_draws(self, slots: np.ndarray, features: np.ndarray) -> np.ndarray:
        if (slots < 0).any():
            out = np.empty((len(slots), 3, self.samples), np.float32)
            kept = slots >= 0
            out[~kept] = self._draw(features[~kept])
            if kept.any():
                out[kept] = self._all_draws(slots[kept], features[kept])
            return out
        new = np.flatnonzero(self.place[slots] < 0)
        if len(new):
            if self.held + len(new) > len(self.heavy):
                self.place[:] = -1
                self.held, new = 0, np.arange(len(slots))
            if len(new) > len(self.heavy):
                return self._draw(features)
            rows = np.arange(self.held, self.held + len(new))
            self.heavy[rows], self.place[slots[new]], self.held = self._draw(features[new]), rows, self.held + len(new)
        return self.heavy[self.place[slots]]

    def sample(self, bag: Counter) -> np.ndarray | None:
        """16-bit samples, None for an empty bag."""
        if not bag:
            return None
        if self.missed > MISSED * len(self.first):
            self._clear()
        slots = np.fromiter(map(self.slots.__getitem__, bag), np.int64, len(bag))
        counts = np.fromiter(bag.values(), np.float32, len(bag))
        features = self.feature[slots]
        unknown = np.flatnonzero((slots < 0) | (slots >= self.drawn))
        if len(unknown):
            words = list(bag)
            features[unknown] = _hashes([words[k] for k in unknown.tolist()])
            new = unknown[slots[unknown] >= 0]
            self.missed += len(unknown) - len(new)
            self.feature[slots[new]] = features[new]
            for k in range(0, len(new), 2048):
                part = new[k : k + 2048]
                self.first[slots[part]] = self._light(features[part])
            self.drawn = len(self.slots)
        best, code = None, None
        for k in range(0, len(features), 2048):
            value, own = self._part(slots[k : k + 2048], features[k : k + 2048], counts[k : k + 2048])
            code = own if best is None else np.where(value < best, own, code)
            best = value if best is None else np.minimum(value, best)
        return code

    def _part(self, slots: np.ndarray, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # With weight 1 the quantised log weight is 0.
        light = np.flatnonzero(counts == 1)
        value = np.full(self.samples, np.inf, np.float32)
        feature = np.zeros(self.samples, np.uint64)
        step = np.zeros(self.samples, np.int64)
        if len(light):
            a = self.first[slots[light]]
            missed = np.flatnonzero(slots[light] < 0)
            if len(missed):
                a[missed] = self._light(features[light[missed]])
            least = a.argmin(axis=0)
            value, feature = a[least, self.lane], features[light][least]
        heavy = np.flatnonzero(counts > 1)
        if len(heavy):
            r, beta, log_c = self._all_draws(slots[heavy], features[heavy]).transpose(1, 0, 2)
            t = np.floor(np.log(counts[heavy])[:, None] / r + beta)
            a = log_c - r * (t - beta) - r
            least = a.argmin(axis=0)
            other = a[least, self.lane]
            wins = other < value
            value = np.where(wins, other, value)
            feature = np.where(wins, features[heavy][least], feature)
            step = np.where(wins, t[least, self.lane].astype(np.int64), 0)
        with np.errstate(over="ignore"):
            code = _mix(feature + step.astype(np.uint64) * _STEP + (self.lane.astype(np.uint64) << np.uint64(32)))
        return value, (code >> np.uint64(64 - SAMPLE_BITS)).astype(np.uint16)


@functools.lru_cache(maxsize=1)
def sampler_of(samples: int) -> Sampler:
    """One sampler for all tasks of a worker."""
    return Sampler(samples)


def bag_of(text: str | None) -> Counter:
    """Words and their counts; a text without a word is one word itself; null and empty texts have none."""
    words = _WORD.findall((text or "").lower())
    return Counter(words) if words else Counter([text] if text else [])


def encode(code: np.ndarray | None) -> str:
    return "" if code is None else code.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated generalised Jaccard similarity; two empty documents are alike, an empty and another not."""
    if a is None or b is None:
        return float(a is None and b is None)
    return max(0.0, (float((a == b).mean()) - _CHANCE) / (1.0 - _CHANCE))


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (hex; empty text: empty string).

    Null texts count as empty; null ids stay null; repeated rows give repeated results; other
    columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = sampler_of(samples)
        for batch in short(batches):
            yield pd.DataFrame({id_col: batch["id"], "fingerprint": [encode(sampler.sample(bag_of(x))) for x in batch["text"]]})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def _block_bounds(docs: DataFrame, block_rows: int) -> list[tuple[int, bytes]]:
    """Least (key, begin) of each range of them, ascending: a row for each block comes to the driver."""
    keys = docs.select("key", "begin")
    n, cores = keys.count(), docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_rows), min(-(-n // LEAST_ROWS), 2 * cores))
    parts = keys.repartitionByRange(blocks, "key", "begin").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "begin")).alias("low"))
    # Spark compares strings by their bytes.
    return sorted((r.low.key, r.low.begin.encode("utf-8", "surrogatepass")) for r in parts.toLocalIterator())


def _blocks(keys: pd.Series, begins: pd.Series, bounds: list[tuple[int, bytes]]) -> tuple[list[int], list[bool]]:
    """The block of each row, the last whose bound isn't above it, and whether the row is at that bound."""
    low = np.array([k for k, _ in bounds], np.int64)
    own = keys.to_numpy()
    first, last = np.searchsorted(low, own, side="left"), np.searchsorted(low, own, side="right")
    at, equal = last - 1, np.zeros(len(own), bool)
    for k in np.flatnonzero(last > first):
        text = begins.iloc[k].encode("utf-8", "surrogatepass")
        at[k] = bisect.bisect_right(bounds, text, int(first[k]), int(last[k]), key=lambda b: b[1]) - 1
        equal[k] = at[k] >= first[k] and bounds[at[k]][1] == text
    return at.tolist(), equal.tolist()


def _slots(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n blocks, such that hash partitioning sends each to a partition of its own."""
    place = F.pmod(F.hash("id"), F.lit(n))
    found = {r.place: r.id for r in spark.range(24 * n + 64).groupBy(place.alias("place")).agg(F.min("id").alias("id")).toLocalIterator()}
    return [found.get(k, -1 - k) for k in range(n)]


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each document beside its edited text and the next document, in descending order of id.

    Null texts count as empty, a null id comes after all others. Rows of one id follow each other
    in the order of their texts and are dealt to several tasks if they are many; rows whose texts
    begin alike as well lie in one block. The last row's next is the first. A table of one row
    compares it with itself, an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    # Inverted ids ascend where ids descend.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.bitwise_not(number).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("begin", F.substring("text", 1, BOUND_CHARS))
    bounds = _block_bounds(rows, block_rows)
    out = T.StructType().add(id_col, "long").add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")
    if not bounds:
        return spark.createDataFrame([], out)
    n = len(bounds)
    slots = _slots(spark, n)

    @F.pandas_udf("array<long>")
    def blocks_of(keys: pd.Series, begins: pd.Series) -> pd.Series:
        own, first = _blocks(keys, begins, bounds)
        return pd.Series([[slots[b], slots[(b - 1) % n]] if f else [slots[b]] for b, f in zip(own, first, strict=True)])

    # A block's first row goes to its own block and, to be looked at only, to the end of the block before; the very first to the very last.
    dealt = rows.select("id", "key", "text", F.posexplode(blocks_of("key", "begin")).alias("ahead", "block"))
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", "ahead", "key", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = sampler_of(samples)
        held = None

        def row(prev: tuple, text: str, code: np.ndarray | None) -> tuple:
            new = edited_text(prev[1], text)
            other = sampler.sample(bag_of(new))
            return (prev[0], len(prev[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(prev[2]), encode(other), likeness(prev[2], other), likeness(prev[2], code))

        block = None
        for batch in short(batches):
            made = []
            # A null id can't be told from that of the least number but here.
            ids = [None if pd.isna(i) else ~key for i, key in zip(batch["id"], batch["key"].tolist(), strict=True)]
            for b, ahead, i, text in zip(batch["block"].tolist(), batch["ahead"].tolist(), ids, batch["text"], strict=True):
                if b != block:
                    block, held = b, None
                if ahead and held is None:
                    continue  # further rows at the bound
                code = sampler.sample(bag_of(text))
                if held is not None:
                    made.append(row(held, text, code))
                held = None if ahead else (i, text, code)
            yield pd.DataFrame(made, columns=out.names).astype({id_col: "Int64"})

    return dealt.mapInPandas(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
