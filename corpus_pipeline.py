"""A training corpus from raw documents: quality, near-duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import drop_table, materialize, table
from lodestrata.llm.ga_packing import pack_documents
from lodestrata.llm.minhash_dedup import BROADCAST_IDS, near_duplicates
from lodestrata.llm.quality_cnn import THRESHOLD, held_out, score_documents, train
from lodestrata.llm.source_mix import mixed_documents


def _whole(docs: DataFrame) -> Column:
    """A document's columns in one, so that none of theirs clashes with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Null and empty texts are scored as texts without bytes and go only if that score is low; rows of
    one id are scored each by its own text, repeated rows alike. Without labels the score is 0.5 and
    all stay. Further columns of any name stay as they are. An empty table gives no rows.
    """
    net = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_documents(docs.select(_whole(docs), "text"), net, keep=True)
    return scored.where(F.col("__score") >= THRESHOLD).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the group's least id, null last.

    Rows are told apart by a key that is written out with them, never by their ids: repeated rows
    are copies of which one stays, different texts of one id or without ids are judged each for
    itself. Texts without words, null ones among them, have no copies and all stay. Further columns
    of any name stay as they are; an empty table gives no rows.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), _whole(docs)), "rows")
    keyed = rows.select("row", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("body"))
    found = materialize(near_duplicates(keyed, "row", "body").select("row", "component_id"), "components")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    stay = found.join(keyed.select("row", "id"), "row").groupBy("component_id").agg(F.min(order)["row"].alias("row"))
    gone = materialize(found.select("row").join(stay, "row", "left_anti"), "gone")
    drop_table(found)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, "row", "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, always whole.

    Texts without words, null ones among them, are never taken. A null source is one of its own.
    Rows of one id, and rows without, are ordered at their source's cut by a hash of a key that is
    written out with them. Further columns of any name stay as they are; an empty table gives none.
    """
    return mixed_documents(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    A null or empty text is its end id alone; null ids stay null; rows of one id and repeated rows
    are packed each. Further columns are left out; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: No SQL: the classifier's weights and the packing can't be expressed in it; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if held is not None:
            drop_table(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
