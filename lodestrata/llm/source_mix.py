"""Mixing sources to target weights, in DataFrame expressions only.

Targets: each source gets its weight's share of all words, at most ``MAX_EPOCHS`` times its own;
the excess is shared again by weight until no source is above its limit. Sources are few rows
after aggregation; the sharing is solved at once by ordering them by limit over weight.

Selection (Efraimidis-Spirakis): a document with quality weight w draws u from a hash and gets the
exponential key -ln(u)/w, least first. A source first takes as many whole epochs as its target
holds; the rest goes to the documents of least keys whose running sum of sizes fits, and what then
remains is taken from the start of the next document, or by that document as a whole.

The running sum is found without sorting a source in one task: keys are 50-bit numbers, and the
cut is narrowed digit by digit over sums for each digit, so a window never holds more than one
digit's values for a source. Documents are never shuffled by source: the cuts, one row for each
source, are broadcast after their number has been checked, else joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Bits of the key decided at each step.
DIGITS = (12, 12, 12, 14)
KEY_BITS = sum(DIGITS)
#: The same for the 64 bits that order rows of one key.
TIE_DIGITS = (16, 16, 16, 16)
#: Sources up to which their cuts are broadcast, at about 100 bytes each.
BROADCAST_SOURCES = 50_000
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """0.25 to 1, highest where the mean length of a word is that of running prose."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), 1.0 / (1.0 + F.abs(mean - 6.5) / 6.5))


def with_keys(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` and the columns __src (never null), __size and __key (a long, least first)."""
    size = word_count(F.col(text_col))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    with_size = docs.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))).withColumn("__size", size)
    es = F.exp(F.log(u) / quality_weight(F.col(text_col), F.col("__size")))
    return with_size.withColumn("__key", F.least(F.floor((1.0 - es) * float(1 << KEY_BITS)), F.lit((1 << KEY_BITS) - 1)).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """__src, source_size, target for rows of (__src, source_size), one for each source."""
    # Order of code points, null (the empty key) last; Spark compares strings by UTF-8 bytes, which is the same order.
    place = F.row_number().over(W.orderBy(F.col("__src") == "", "__src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * float(max_epochs)
    ranked = sizes.withColumn("w", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    everything, order = W.partitionBy(), W.orderBy("ratio", "__src")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = ranked.withColumn("share", share).withColumn("full", F.col("share") > F.col("ratio"))
    # The first source that isn't full sets the share of all that follow.
    final = F.min(F.when(~F.col("full"), F.struct("ratio", "__src", "share"))).over(everything)["share"]
    return level.select("__src", "source_size", F.round(F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * final)), 6).alias("target"))


def _narrow(rows: DataFrame, cut: DataFrame, key: str, digits: tuple[int, ...]) -> DataFrame:
    """``cut`` with prefix the key at which a source's rows, by key, hold its ``rest`` words; rest what that key must give, n its rows."""
    carried = [c for c in cut.columns if c != "rest"]
    held = cut = materialize(cut.withColumn("prefix", F.lit(0).cast("long")), "mix-targets")
    bits = shift = sum(digits)
    for digit_bits in digits:
        cut = cut.withColumn("at", F.col("prefix"))
        near = rows.withColumn("at", F.shiftright(key, shift) if shift < bits else F.lit(0).cast("long"))
        shift -= digit_bits
        # Sources with nothing left over need no cut.
        near = near.withColumn("digit", F.shiftright(key, shift)).groupBy("__src", "at", "digit").agg(F.sum("__size").alias("words"), F.count("*").alias("n"))
        found = near.join(cut.where("rest > 0").select("__src", "at", "rest"), ["__src", "at"])
        run = found.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("__src").orderBy("digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
        # The last digit that begins with words to spare holds the cut.
        hit = run.where(F.col("before") < F.col("rest")).groupBy("__src").agg(F.max(F.struct("digit", "before", "n")).alias("hit"))
        cut = cut.drop("at", "n").join(hit, "__src", "left")
        cut = cut.select(*carried, F.when(F.col("hit").isNotNull(), F.col("rest") - F.col("hit.before")).otherwise(F.col("rest")).alias("rest"), F.coalesce("hit.digit", F.lit(-1).cast("long")).alias("prefix"), F.coalesce("hit.n", F.lit(1).cast("long")).alias("n"))
        before, cut = held, materialize(cut, "mix-cut")
        drop_table(before)
        held = cut
    return cut


def plan_mix(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source: __src, source_size, target, epochs, cut (a key), at_cut (words), tied (rows at the cut)."""
    rows = materialize(keyed.select("__src", "__size", "__key"), "mix-keys")
    sizes = rows.groupBy("__src").agg(F.sum("__size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    cut = targets.withColumn("words", words).withColumn("epochs", epochs).withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")).drop("words")
    cut = _narrow(rows, cut, "__key", DIGITS)
    drop_table(rows)
    return cut.select("__src", "source_size", "target", "epochs", F.col("prefix").alias("cut"), F.col("rest").alias("at_cut"), F.col("n").alias("tied"))


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


#: Columns that the mix adds to the documents' own; a column of theirs with such a name is left out.
ADDED = ("__size", "__source_size", "__target", "__taken")


def _chosen(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs``, in a struct, beside helper columns (__ key, size, source's plan), and the cut among rows of one key.

    Rows of one key at a source's cut are ordered by a hash of a key of their own, which is written
    out with them: (__src, __row) of those before or at the cut.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"))
    keyed = with_keys(held, "__id", "__source", "__text", seed).drop("__id", "__source", "__text")
    plan = plan_mix(keyed, weights, max_epochs)
    ours = plan.select("__src", *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "__src"])
    return keyed.join(_small(ours), "__src"), plan


def _split_ties(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` and __here (words of this row that its source's rest takes) and __last (the cut falls within the row).

    Where the cut falls on a single row, or on several of one key, rows come in the order of a hash.
    """
    at_cut = (F.col("__key") == F.col("__cut")) & (F.col("__size") > 0)
    before = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).otherwise(F.lit(0).cast("long"))
    ties = plan.where("tied > 1").select("__src", F.col("at_cut").alias("rest"))
    one = rows.withColumn("__here", F.when(at_cut, F.least(F.col("__size"), F.greatest(F.col("__at_cut"), F.lit(0)))).otherwise(before)).withColumn("__last", at_cut)
    if ties.isEmpty():
        return one
    several = at_cut & (F.col("__tied") > 1)
    # On a single long xxhash64 is one to one, so that no two rows tie again.
    tied = materialize(rows.where(several).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())), "mix-tied")
    last = _narrow(tied.select("__src", "__size", "__tie"), ties, "__tie", TIE_DIGITS).select("__src", F.col("prefix").alias("__end"), F.col("rest").alias("__left"))
    ends = tied.join(_small(last), "__src")
    ends = ends.withColumn("__here", F.when(F.col("__tie") < F.col("__end"), F.col("__size")).when(F.col("__tie") == F.col("__end"), F.least("__size", "__left")).otherwise(0).cast("long"))
    ends = ends.withColumn("__last", F.col("__tie") == F.col("__end")).drop("__tie", "__end", "__left")
    return one.where(~several).unionByName(ends)


def added_names(columns: list[str]) -> tuple[str, ...]:
    """``ADDED``, each with as many more underscores before it as it takes to be none of ``columns``."""
    return tuple(next(name for k in range(len(columns) + 1) if (name := "_" * k + c) not in columns) for c in ADDED)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` and the columns ``ADDED``: size, its source's size and target, and taken (words, repeats counted).

    A null text has no words and is never taken from; a null source is a source of its own, last in
    order. Documents of one id draw the same key: where the cut falls on several of them, a hash of
    a key that is written out with them orders them. So each source's words are taken to the word.
    An empty table gives no rows. Other columns, whatever their names, stay as they are; where ``docs``
    has a column of an added one's name, the added one is called as ``added_names`` says.
    """
    rows, plan = _chosen(docs, id_col, source_col, text_col, weights, max_epochs, seed)
    taken = (F.col("__epochs") * F.col("__size") + F.col("__here")).cast("long")
    kept = [F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]
    added = zip((F.col("__size"), F.col("__source_size"), F.col("__target"), taken), added_names(docs.columns), strict=True)
    return _split_ties(rows, plan).select(*kept, *[c.alias(name) for c, name in added])


def whole_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs``, each row as often as the mix takes it; the document at a source's cut is taken whole.

    A source so has its target at least, and less than one document more. Rows of one key, as
    without ids, are told apart as in ``mix_sources``.
    """
    rows, plan = _chosen(docs, id_col, source_col, text_col, weights, max_epochs, seed)
    copies = (F.col("__epochs") + (F.col("__here") > 0).cast("long")).cast("int")
    every = _split_ties(rows.where("__size > 0"), plan)
    return every.select("__doc", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).select("__doc.*")


def mixed_documents(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix itself: a row for each whole time a document is taken and one for a part of it.

    A part is the document's text up to the end of its last word taken. With ``whole`` there are no
    parts, see ``whole_documents``. Columns are those of ``docs``; a column n_chars, where there is
    one, follows the part's text.
    """
    if whole:
        return whole_documents(docs, **options)
    text = options.pop("text_col", "text")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(options.pop("id_col", "doc_id")).alias("doc_id"), F.col(options.pop("source_col", "source")).alias("source"), F.col(text).alias("text"))
    mixed = mix_sources(held, **options)
    full = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    part = F.col("__taken") - full * F.col("__size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.select("doc", "text", F.explode(copies).alias("words"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACE + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    new = F.when(F.col("words") > 0, cut).otherwise(F.col("text"))
    kinds = dict(docs.dtypes)
    changed = {text: new} | ({"n_chars": F.when(F.col("words") > 0, F.length(new).cast(kinds["n_chars"])).otherwise(F.col("doc.n_chars"))} if "n_chars" in kinds else {})
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", *[F.col(c).alias(c[2:]) for c in ADDED])


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size, floor((1 - exp(ln((('0x' || substr(md5(doc_id::VARCHAR || ':20'), 1, 13))::BIGINT + 0.5::DOUBLE) / 2::DOUBLE ** 52)
    / greatest(0.25::DOUBLE, 1 / (1 + abs(length(t) / greatest(size, 1)::DOUBLE - 6.5) / 6.5)))) * 2::DOUBLE ** 50) AS k FROM base
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM base GROUP BY source
), ranked AS (
  SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / w AS ratio FROM src
), shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS share
  FROM ranked WINDOW before AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, round(CASE WHEN share > ratio THEN most ELSE least(most, w * (SELECT min_by(share, ratio) FROM shares WHERE share <= ratio)) END, 6)::DOUBLE AS target FROM shares
), wanted AS (
  SELECT *, least(round(target)::BIGINT, 3 * source_size) AS words FROM targets
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM wanted
), run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, words - epochs * source_size - before)))::BIGINT AS taken
FROM run JOIN cut ON run.source IS NOT DISTINCT FROM cut.source
"""
