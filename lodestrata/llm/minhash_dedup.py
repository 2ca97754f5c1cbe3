"""MinHash near-duplicate components with odd sketches.

Each document's set of distinct word shingles gives 256 MinHash samples. Four of the first 128 make
a band key; documents that share a key are candidates. All samples are folded into a 512-bit parity
bitmap (odd sketch): the population count of two sketches' XOR estimates their similarity, and
candidates whose estimate is far below what they would need are dropped. Every link is confirmed on
the full sets.

Documents with equal sets are one class from the start, so copies are never paired. A band bucket's
centre is the class that shares buckets with most others, and every class of the bucket is held
against it. Classes linked to the centre are in one component and need no further proof; with
D = (1 - t) / (1 + t) times two sets' sizes, a pair is linked if its sets differ in at most D shingles.

* Classes within distance 3(1 - t) of the centre are described by their differences from it: two
  sets differ in exactly those shingles in which their differences differ. If one of two isn't
  linked to the centre, a link needs more than half of the other's differences in common, so only
  pairs that share one of the rarest differences (a prefix filter) are looked at. Texts that fill one
  template share even those: such classes are held against each other in blocks, by sketches first. That
  costs time with the square of their number, about 10 core seconds for ten thousand, but no rows.
* Classes beyond distance 2(1 - t) are compared with each other, as far as sketches allow a link;
  by the triangle inequality they can't be linked to any of those within 2(1 - t) unless they lie
  within 3(1 - t), where the first rule finds them. Where a bucket has more than ``FEW`` of them,
  not all of its pairs are looked at, but only classes that share one of their rarest shingles,
  which two similar sets always do.

Nothing is lost by either rule, and a group of many near copies costs one comparison for each.
At threshold t a pair misses every band with a chance of (1 - t**4)**32: 6e-11 at 0.85, 5e-8 at
0.8. The sketches' margins add less than 1e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, short, table
from lodestrata.llm.components import connected_components

SAMPLES, BAND_ROWS, BANDS = 256, 4, 32
SKETCH_BITS = 512
SKETCH = [f"o{k}" for k in range(SKETCH_BITS // 64)]
#: Sketches may estimate so much below a similarity before it is taken to be out of reach.
MARGIN = 0.15
WIDE_MARGIN = 0.25
#: Class ids up to which a list of them is broadcast (8 bytes each, about 30 in a hash table).
BROADCAST_IDS = 200_000
#: Pairs of one centre that a task takes, about.
PART_PAIRS = 256
#: Classes of a bucket, beyond its centre's reach, up to which all of their sketches are compared. That
#: costs a class at most so many comparisons; the other way costs it a row for each of its shingles.
FEW = 64
#: Classes that may share a difference, or a shingle, for it to be looked up by; what more of them share tells little.
HOT = 16
#: Classes of one centre in a block; blocks of those with common differences are held against each other.
BLOCK_CLASSES = 2048

_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_LANE = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
_BAND = np.random.default_rng(13).integers(1, 1 << 63, (BANDS, BAND_ROWS + 1), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without any has none."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    size = min(words, len(own))
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, own), np.uint64, len(own))
    with np.errstate(over="ignore"):
        total = np.full(len(own) - size + 1, np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for k in range(size):
            total = _mix(total + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 1024):
            part = x[k : k + 1024, None] * _MULTIPLY
            part += _ADD
            low = np.minimum(low, part.min(axis=0))
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((samples[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64) * _BAND[:, :BAND_ROWS]).sum(axis=1) + _BAND[:, BAND_ROWS]).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Eight longs: the parity of the samples that fall on each of 512 bits."""
    at = (_mix(samples.astype(np.uint64) | _LANE) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """XOR population count at which two sketches' estimate falls below ``similarity``."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES / SKETCH_BITS * (1 - similarity))))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in short(batches):
            n, cls, bands, odd = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, words)
                samples = min_samples(s)
                n.append(len(s))
                cls.append(_class_of(s))
                bands.append(band_keys(samples) if len(s) else None)
                odd.append(odd_sketch(samples))
            odd = np.array(odd, np.int64).reshape(-1, len(SKETCH))
            yield pd.DataFrame({"id": batch["id"], "body": batch["body"], "n": n, "cls": cls, "bands": bands, **{c: odd[:, k] for k, c in enumerate(SKETCH)}})

    return docs.mapInPandas(run, f"id {dict(docs.dtypes)['id']}, body long, n long, cls long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH))


def _class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, n, shingles) of the wanted classes, rows (cls, body) with the hash of one text for each.

    Texts are found by their hash, never by an id, which may be repeated or null. Of equal texts a
    task hands on the first alone, so a text that stands everywhere is a row for each task.
    """

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            new = batch[~batch["body"].duplicated() & ~batch["body"].isin(seen)]
            seen.update(new["body"].tolist())
            yield new

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for batch in short(batches):
            cls, n, shingles = [], [], []
            for want, text in zip(batch["cls"].tolist(), batch["text"], strict=True):
                own = shingle_set(text, words) if want not in done else ()
                # Another text of the same hash would be another class.
                if len(own) and _class_of(own) == want:
                    done.add(want)
                    cls.append(want)
                    n.append(len(own))
                    shingles.append(own.view(np.int64))
            yield pd.DataFrame({"cls": pd.Series(cls, dtype="int64"), "n": pd.Series(n, dtype="int64"), "shingles": pd.Series(shingles, dtype="object")})

    if wanted.count() <= BROADCAST_IDS:
        texts = docs.select("body", "text").join(F.broadcast(wanted), "body")
    else:
        texts = docs.select("body", "text").mapInPandas(distinct, "body long, text string").join(wanted, "body")
    return texts.select("cls", "text").mapInPandas(run, "cls long, n long, shingles array<long>").dropDuplicates(["cls"])


def _possible(a: str, b: str, per_cent: int, margin: float) -> Column:
    """Lengths and sketches, in columns that begin with ``a`` and ``b``, leave the pair a similarity of ``per_cent`` hundredths."""
    low, high = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    differing = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCH), F.lit(0))
    return (low * 100 >= high * per_cent) & (differing <= most_differing_bits(per_cent / 100 - margin))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with both sets: nu, su, nv, sv."""
    left = sets.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("su"))
    right = sets.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("sv"))
    return pairs.join(right, "v").join(left, "u")


def _around_centres(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for pairs (u, v, parts) of centres u.

    A centre of many pairs has ``parts`` copies of its set, so that no task reads all of its pairs.
    """
    centres = pairs.groupBy("u").agg(F.max("parts").alias("parts"))
    left = centres.join(sets.select(F.col("cls").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("su")), "u")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    right = sets.select(F.col("cls").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("sv"))
    return pairs.withColumn("part", F.pmod(F.xxhash64("v"), "parts")).join(right, "v").join(left, ["u", "part"])


def _reaches(per_cent: int) -> Column:
    """The sets of u and v, of which ``common`` are in both, have that similarity: in whole numbers."""
    return F.col("common") * 100 >= (F.col("nu") + F.col("nv") - F.col("common")) * per_cent


def _buckets(classes: DataFrame, per_cent: int, ring: int) -> DataFrame:
    """(key, cls, size, u, parts, near): classes that share a band key with others, and the bucket's centre.

    ``near``: sketches leave it open that the class lies within the centre's ring. A class has no more
    pairs than its buckets have members in all, so a part has about ``PART_PAIRS`` at most.
    """
    facts = ("n", *SKETCH)
    banded = classes.select("cls", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "key"), "members")
    # The class that meets most others is the centre; ties are broken by id.
    weight = members.groupBy("cls").agg(F.sum("size").alias("met"))
    centres = members.join(weight, "cls").groupBy("key").agg(F.max(F.struct("met", F.pmod("cls", F.lit(1024)).alias("tie"), "cls")).alias("c"))
    centres = centres.select("key", F.col("c.cls").alias("u"), (F.floor(F.col("c.met") / PART_PAIRS) + 1).alias("parts"))
    centres = centres.join(classes.select(F.col("cls").alias("u"), *[F.col(c).alias(f"a_{c}") for c in facts]), "u")
    held = members.join(centres, "key").join(classes.select("cls", *[F.col(c).alias(f"b_{c}") for c in facts]), "cls")
    # A bucket of two has no pair but this one, so it must be a link; others are placed around the centre.
    near = F.when(F.col("size") == 2, _possible("a_", "b_", per_cent, MARGIN)).otherwise(_possible("a_", "b_", ring, WIDE_MARGIN))
    buckets = materialize(held.select("key", "cls", "size", "u", "parts", near.alias("near")), "buckets")
    drop_table(members)
    return buckets


def _unlinked(pairs: DataFrame, placed: DataFrame, per_cent: int) -> DataFrame:
    """Those of the pairs (u, v) that may be links between two components; ``placed``: classes with facts and root."""
    known = pairs.join(placed.alias("b"), F.col("v") == F.col("b.cls")).join(placed.alias("a"), F.col("u") == F.col("a.cls"))
    return known.where((F.col("a.root") != F.col("b.root")) & _possible("a.", "b.", per_cent, MARGIN)).select("u", "v")


def _facts(placed: DataFrame) -> DataFrame:
    """(v, root, n, sketch) of classes, for conditions of joins."""
    return placed.select(F.col("cls").alias("v"), "root", F.col("n").alias("nv"), F.array(*SKETCH).alias("sketch"))


def _open_pair(a: str, b: str, per_cent: int) -> Column:
    """Two rows with facts may be a link between two components: what a join tests before it gives a row."""
    low, high = F.least(f"{a}.nv", f"{b}.nv"), F.greatest(f"{a}.nv", f"{b}.nv")
    differing = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(len(SKETCH))), F.lit(0))
    return (F.col(f"{a}.root") != F.col(f"{b}.root")) & (low * 100 >= high * per_cent) & (differing <= most_differing_bits(per_cent / 100 - MARGIN))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def _by_difference(stars: DataFrame, placed: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v) around one centre that may be links, not both linked to it.

    ``stars``: (u, v, parts, nu, nv, d, common, linked), v within reach of the centre u, d their differences.
    Pairs share one of either's rarest differences. One that no more than ``HOT`` classes have is
    looked up; classes with a commoner one among their rarest, as of texts that fill one template, are
    held against each other in blocks, by their sketches and then their differences, so that only links
    are rows.
    """
    alpha = (100 - per_cent) / (100 + per_cent)
    open_ = stars.groupBy("u").agg(F.count("*").alias("n"), F.min("linked").alias("closed"), F.max("parts").alias("parts")).where("n > 1 and not closed")
    open_ = open_.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    far = stars.withColumn("part", F.pmod(F.xxhash64("v"), "parts")).join(open_, ["u", "part"], "left_semi")
    far = materialize(far.select("u", "v", "linked", "nu", "nv", "d", F.size("d").alias("size")), "differences")
    each = far.select("u", "v", F.explode("d").alias("x"))
    rarity = each.groupBy("u", "x").agg(F.count("*").alias("n")).where("n > 1")
    # What one class alone has can't be shared, but takes up its places in the prefix: it comes first.
    ranked = each.join(rarity, ["u", "x"]).groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("shared"))
    half = F.floor((F.col("size") + alpha * (F.col("nu") - F.col("nv"))) / 2) + 1
    to_linked = F.ceil(F.col("size") - alpha * F.col("nv") * (1 + 100 / per_cent) - 1e-9)
    # Two open classes must share more than half of either's differences; an open and a linked one perhaps less of the open one's.
    alone = F.col("size") - F.size("shared")
    reach = lambda least: F.greatest(F.col("size") - F.greatest(least, F.lit(1)) + 1 - alone, F.lit(0)).cast("int")
    least = F.when(F.col("linked"), half).otherwise(F.least(half, to_linked))
    # A class's rarest differences, those that pairs of two open classes need first.
    probes = far.select("u", "v", "linked", "size", "nu", "nv").join(ranked, ["u", "v"])
    probes = materialize(probes.select("u", "v", "linked", reach(half).alias("short"), F.slice("shared", F.lit(1), reach(least)).alias("rare")), "probes")
    facts = _facts(placed)

    cold = probes.select("u", "v", "linked", "short", F.posexplode(F.filter("rare", lambda r: r["n"] <= HOT)["x"]).alias("pos", "x")).join(facts, "v")
    one, other, near = cold.where("linked"), cold.where("not linked"), cold.where("not linked and pos < short")
    meet = lambda a, b, order: _ordered(a.alias("p").join(b.alias("q"), (F.col("p.u") == F.col("q.u")) & (F.col("p.x") == F.col("q.x")) & order & _open_pair("p", "q", per_cent)), "p.v", "q.v")
    pairs = meet(one, other, F.lit(True)).unionByName(meet(near, near, F.col("p.v") < F.col("q.v")))

    common = probes.where(F.exists("rare", lambda r: r["n"] > HOT)).select("u", "v")
    if common.isEmpty():
        return pairs
    blocks = common.groupBy("u").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("blocks"))
    held = far.select("u", "v", "linked", "d").join(common.join(blocks, "u"), ["u", "v"]).join(facts, "v").withColumn("own", F.pmod(F.xxhash64("v"), "blocks").cast("int"))
    held = materialize(held, "templates")
    first = held.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    second = held.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))
    # Two sets differ in exactly those shingles in which their differences from the centre differ.
    differing = F.size("p.d") + F.size("q.d") - 2 * F.size(F.array_intersect("p.d", "q.d"))
    both = F.col("p.nv") + F.col("q.nv")
    link = (both - differing) * 100 >= (both + differing) * per_cent
    block = (F.col("p.u") == F.col("q.u")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    once = ((F.col("p.i") < F.col("p.j")) | (F.col("p.v") < F.col("q.v"))) & ~(F.col("p.linked") & F.col("q.linked"))
    return pairs.unionByName(_ordered(first.alias("p").join(second.alias("q"), block & once & _open_pair("p", "q", per_cent) & link), "p.v", "q.v"))


def _by_rarity(crowd: DataFrame, sets: DataFrame, placed: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v) of ``crowd`` (key, cls, inner), not of one root, that may be links.

    Of two similar sets' rarest ``per_cent`` + 1 shingles off the whole, at least one is in both. Where no
    more than ``HOT`` classes have it, it is looked up; classes with a commoner one are held against those
    of their buckets that have one too, in blocks, by their sketches.
    """
    own = sets.join(crowd.groupBy("cls").agg(F.min("inner").alias("inner")), "cls")
    each = own.select("cls", F.explode("shingles").alias("x"))
    rarity = each.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(rarity, "x").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("shared"))
    # Shingles of one class alone are the rarest of all, and take up their places.
    places = F.col("size") - F.ceil(F.col("size") * per_cent / 100 - 1e-9) + 1 - (F.col("size") - F.size("shared"))
    rare = F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    probes = materialize(ranked.join(own.select("cls", "inner", F.col("n").alias("size")), "cls").select(F.col("cls").alias("v"), "inner", rare.alias("rare")), "probes")
    # Both within reach of their bucket's centre: looked at by their differences.
    new = ~(F.col("p.inner") & F.col("q.inner")) & _open_pair("p", "q", per_cent)
    facts = _facts(placed)
    cold = probes.select("v", "inner", F.explode(F.filter("rare", lambda r: r["df"] <= HOT)["x"]).alias("x")).join(facts, "v")
    pairs = _ordered(cold.alias("p").join(cold.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.v") < F.col("q.v")) & new), "p.v", "q.v")
    common = probes.where(F.exists("rare", lambda r: r["df"] > HOT)).select("v")
    if common.isEmpty():
        return pairs
    members = crowd.select("key", F.col("cls").alias("v"), "inner").join(common, "v")
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("blocks"), F.min("inner").alias("done")).where("not done")
    held = materialize(members.join(blocks.drop("done"), "key").join(facts, "v").withColumn("own", F.pmod(F.xxhash64("v"), "blocks").cast("int")), "crowds")
    first = held.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    second = held.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))
    block = (F.col("p.key") == F.col("q.key")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    once = (F.col("p.i") < F.col("p.j")) | (F.col("p.v") < F.col("q.v"))
    return pairs.unionByName(_ordered(first.alias("p").join(second.alias("q"), block & once & new), "p.v", "q.v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, per_cent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at
    least ``per_cent`` hundredths. ``component_id`` is the least id that links reach, ``kept`` marks
    the row with that id. A null or wordless text has an empty set and stands alone. A null id is
    never a component's least unless all its ids are null; several rows of one id that is the least
    are all kept. Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("body"))
    rows = materialize(_sketches(own, words), "sketches")
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min("body").alias("body"), *[F.first(c).alias(c) for c in ("n", *SKETCH, "bands")]), "classes")
    ring, near = max(1, 100 - 3 * (100 - per_cent)), max(1, 100 - 2 * (100 - per_cent))
    buckets = _buckets(classes, per_cent, ring)

    reached = buckets.where("cls <> u and near").groupBy("u", F.col("cls").alias("v")).agg(F.max("parts").alias("parts"))
    sets = materialize(_sets(own, classes.select("cls", "body").join(buckets.select("cls").distinct(), "cls", "left_semi"), words), "sets")
    differing = F.concat(F.array_except("su", "sv"), F.array_except("sv", "su"))
    stars = _around_centres(reached, sets).select("u", "v", "parts", "nu", "nv", differing.alias("d"))
    stars = stars.withColumn("common", ((F.col("nu") + F.col("nv") - F.size("d")) / 2).cast("long")).where(_reaches(ring))
    stars = materialize(stars.withColumn("linked", _reaches(per_cent)), "stars")
    roots = connected_components(stars.where("linked").select("u", "v"))
    placed = classes.select("cls", "n", *SKETCH).join(roots, F.col("cls") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "cls"))
    placed = materialize(placed, "placed")

    beyond = buckets.where("cls <> u and size > 2").select("key", "u", F.col("cls").alias("v")).join(stars.where(_reaches(near)).select("u", "v"), ["u", "v"], "left_anti")
    # Pairs of which both lie within the ring are the first rule's.
    inner = stars.select("u", "v", F.lit(True).alias("inner"))
    beyond = beyond.join(inner, ["u", "v"], "left").select("key", F.col("v").alias("cls"), F.coalesce("inner", F.lit(False)).alias("inner"))
    beyond = materialize(beyond.join(placed, "cls"), "beyond")
    # All of one component have no link to be found.
    left = beyond.groupBy("key").agg(F.count("*").alias("left"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    some = beyond.join(left.where(f"left <= {FEW}").select("key"), "key", "left_semi")
    crowd = materialize(beyond.join(left.where(f"left > {FEW}").select("key"), "key", "left_semi").select("key", "cls", "inner"), "crowd")
    apart = (F.col("a.cls") < F.col("b.cls")) & ~(F.col("a.inner") & F.col("b.inner")) & (F.col("a.root") != F.col("b.root")) & _possible("a.", "b.", per_cent, MARGIN)
    candidates = some.alias("a").join(some.alias("b"), (F.col("a.key") == F.col("b.key")) & apart).select(F.col("a.cls").alias("u"), F.col("b.cls").alias("v"))
    if not stars.where("not linked").isEmpty():
        candidates = candidates.unionByName(_by_difference(stars, placed, per_cent))
    if not crowd.isEmpty():
        candidates = candidates.unionByName(_by_rarity(crowd, sets, placed, per_cent))
    left = materialize(_unlinked(candidates.distinct(), placed, per_cent), "open-pairs")
    late = _with_sets(left, sets).withColumn("common", F.size(F.array_intersect("su", "sv")).cast("long"))
    late = materialize(late.where(_reaches(per_cent)).select("u", "v"), "links")
    if not late.isEmpty():
        # Components that late links join are found on the graph of components alone.
        place = placed.select("cls", "root")
        joined = late.join(place.withColumnRenamed("root", "ru"), F.col("u") == F.col("cls")).drop("cls").join(place.withColumnRenamed("root", "rv"), F.col("v") == F.col("cls"))
        above = connected_components(joined.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        placed = materialize(placed.select("cls", "root").join(above, "root", "left").select("cls", F.coalesce("top", "root").alias("root")), "placed")
    # Sketches, classes and roots are all that the result is read from.
    drop_table(buckets, sets, stars, beyond, crowd, left, late)

    rooted = classes.select("cls", "id").join(placed.select("cls", "root"), "cls")
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("least")), "root").select("cls", "least")
    found = rows.where("n > 0").join(named, "cls").select("id", "n", "least")
    result = found.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("least")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, per_cent=85)


#: Exact links of all pairs that share a shingle, and their closure.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), class AS (
  SELECT md5(array_to_string(list_sort(s), '|')) AS c, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1
), shingles AS (SELECT least, len(s) AS n, unnest(s) AS x FROM class),
links AS (
  SELECT a.least AS u, b.least AS v FROM shingles a JOIN shingles b ON a.x = b.x AND a.least < b.least AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (
  SELECT least, least FROM class UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN class ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), '|')) = class.c LEFT JOIN comp ON comp.a = class.least
"""
