"""Shared pieces: table access, reliable materialisation, short batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.storage import drop_table, materialize, shared_dir

__all__ = ["ascii_lower", "drop_table", "materialize", "shared_dir", "short", "table"]

#: Rows of a batch that are worked on, and given back, at a time. Spark bounds a batch itself by its bytes.
BATCH_ROWS = 512

_Batch = TypeVar("_Batch", pd.DataFrame, pd.Series)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short(batches: Iterator[_Batch], rows: int = BATCH_ROWS) -> Iterator[_Batch]:
    """The same rows in short batches, so that results are handed on before many are held."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
