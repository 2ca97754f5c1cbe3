"""Fill-in-middle transformation over code point arrays.

A text is decoded once to a UTF-32 array. Units end where a character that isn't white space is
followed by one that is, and at the text's end, so comparing neighbouring classes gives all ends at
once. Two ranks, drawn from a digest of the row's id, choose where prefix and middle end; the pieces
are slices of the array, encoded again.

Forms: ``spm`` writes suffix, prefix, middle, ``psm`` prefix, suffix, middle, each behind its mark;
``plain`` leaves the text as it is. A text that is empty or holds a mark is always plain, so marks
in an output are the form's own and ``restored`` needs nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import short, table

SEED = 42
#: Hundredths of texts that are transformed, and of those that become ``spm``.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Draw:
    """Four 32-bit numbers for a row, the same in every run."""

    first: int
    second: int
    form: int
    order: int

    @classmethod
    def of(cls, key: object, seed: int = SEED) -> Draw:
        """``key``: a row's id; a null one is written as nothing."""
        digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
        return cls(*(int(digest[k : k + 8], 16) for k in range(0, 32, 8)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Where each unit ends: white space and the word after it are one, white space at the end is another."""
    if not len(points):
        return np.empty(0, np.int64)
    space = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points))


def rearranged(text: str, draw: Draw, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output); no lengths for a plain text."""
    points = code_points(text)
    ends = unit_ends(points)
    n = len(ends)
    if not text or draw.form % 100 >= rate or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    a, b = sorted((draw.first % (n + 1), draw.second % (n + 1)))
    at = np.append(0, ends)
    prefix, middle, suffix = (text_of(p) for p in (points[: at[a]], points[at[a] : at[b]], points[at[b] :]))
    if draw.order % 100 < spm:
        return n, "spm", int(at[a]), int(at[b] - at[a]), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", int(at[a]), int(at[b] - at[a]), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row for each row of ``docs``: its id, n units, form, prefix_chars, middle_chars, output.

    A null text is an empty one: no units, plain, an empty output. Rows of one id draw the same
    numbers, null ids those of an empty id; repeated rows give equal rows. Other columns, whatever
    their names, are left out. An empty table gives no rows. A text is worked on by itself, so a long
    one needs a few times its own size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in short(batches, 64):
            made = [rearranged(text or "", Draw.of(key, seed), rate, spm) for key, text in zip(batch["key"], batch["text"], strict=True)]
            out = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}).assign(id=batch["id"].to_numpy())

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    made = own.mapInPandas(run, f"id {kind}, {_SCHEMA}")
    return made.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    head, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    psm = F.concat(part(part(head, PREFIX, 2), SUFFIX, 1), middle, part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), middle, part(part(head, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), pieces AS (
  SELECT *, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
