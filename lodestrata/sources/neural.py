"""Vectors of a sentence-embedding model, where its package is installed; imported on demand only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.dense import rounded


def neural_vectors(texts: DataFrame, model: str, *ids: str) -> DataFrame:
    """(ids, embed_text) -> (ids, buckets, weights); each worker loads the model once."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        own = SentenceTransformer(model)
        for batch in batches:
            yield pd.Series(list(np.asarray(own.encode(batch.tolist(), normalize_embeddings=True), dtype=float)))

    made = texts.select(*ids, rounded(encode("embed_text")).alias("weights"))
    return made.select(*ids, F.transform("weights", lambda _, k: k).alias("buckets"), "weights")
