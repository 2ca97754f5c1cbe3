"""Search terms counted and hashed text by text, within tasks and by way of Arrow.

``text.tokenize`` says the same as an expression, whose lambdas are interpreted; here an identifier's terms
are looked up, as most of them have been met before, so a text costs one scan and one step for each
distinct identifier. A row stays one row: nothing is exploded, aggregated or shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.functions.hashing import DIM
from lodestrata.functions.text import IDENTIFIER, STOPWORDS, SUBWORD

_IDENTIFIER, _SUBWORD, _STOP = re.compile(IDENTIFIER), re.compile(SUBWORD), frozenset(STOPWORDS)
#: Identifiers that a task remembers, and how long they may be.
MEMO, MEMO_CHARS = 200_000, 64
#: Rows of which a task makes objects at a time.
ROWS = 512


def terms_of(ident: str) -> tuple[str, ...]:
    """An identifier's terms: itself, lowered, and those of its subwords that differ from it."""
    if ident.isalpha() and ident.islower():
        return () if ident in _STOP else (ident,)
    whole = ident.lower()
    parts = [s for s in map(str.lower, _SUBWORD.findall(ident)) if s != whole and len(s) > 1 and s not in _STOP]
    return tuple(parts) if whole in _STOP else (whole, *parts)


class Memo(dict):
    """What ``make`` makes of an identifier's terms."""

    def __init__(self, make: Callable[[tuple[str, ...]], object]) -> None:
        self.make = make

    def __missing__(self, ident: str) -> object:
        found = self.make(terms_of(ident))
        if len(ident) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[ident] = found
        return found


def _identifiers(text: str) -> Counter:
    return Counter(_IDENTIFIER.findall(text))


def _lists(sizes: list[int] | np.ndarray, flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)


def _mapped(rows: DataFrame, keys: tuple[str, ...], texts: list[str], made: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list[list]], list[pa.Array]]]) -> DataFrame:
    """``rows`` with what the function that ``make`` gives in a task makes of their texts, ``ROWS`` at a time."""
    names = [*keys, *[n for n, _ in made]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                found = of([part.column(len(keys) + i).to_pylist() for i in range(len(texts))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *found], names=names)

    own = rows.select(*keys, *texts)
    return own.mapInArrow(run, T.StructType([*own.schema.fields[: len(keys)], *[T.StructField(n, t) for n, t in made]]))


def term_rows(rows: DataFrame, *keys: str, times: dict[str, int], vocabulary: list[str] | None = None, named: bool = False) -> DataFrame:
    """(keys, texts) -> (keys, dl, terms, tfs): how many terms a row has, its distinct ones, and how often each is there.

    ``times`` says how often the terms of a column count. With a vocabulary, terms are places in it, or
    ``named`` as they are, and those that it doesn't hold are left out; they count for ``dl`` all the same.
    """
    texts, words = list(times), named or vocabulary is None
    place = None if vocabulary is None else rows.sparkSession.sparkContext.broadcast({t: t if named else i for i, t in enumerate(vocabulary)})

    def make() -> Callable[[list[list]], list[pa.Array]]:
        known = None if place is None else place.value
        memo = Memo(lambda own: (len(own), own if known is None else tuple(known[t] for t in own if t in known)))

        def count(columns: list[list]) -> list[pa.Array]:
            dls, sizes, terms, tfs = [], [], [], []
            for row in zip(*columns, strict=True):
                dl, found = 0, {}
                for text, n in zip(row, times.values(), strict=True):
                    for ident, often in _identifiers(text).items() if text else ():
                        own = memo[ident]
                        dl += n * often * own[0]
                        for t in own[1]:
                            found[t] = found.get(t, 0) + n * often
                dls.append(dl)
                sizes.append(len(found))
                terms += found
                tfs += found.values()
            return [pa.array(dls, pa.int64()), _lists(sizes, pa.array(terms, pa.string() if words else pa.int32())), _lists(sizes, pa.array(tfs, pa.int32()))]

        return count

    kind = T.StringType() if words else T.IntegerType()
    return _mapped(rows, keys, texts, [("dl", T.LongType()), ("terms", T.ArrayType(kind)), ("tfs", T.ArrayType(T.IntegerType()))], make)


def bucket_and_sign(term: str, dim: int = DIM) -> tuple[int, int]:
    digest = hashlib.md5(term.encode()).digest()
    return int.from_bytes(digest[:4], "little") % dim, -1 if digest[4] % 2 else 1


def half_up(x: np.ndarray, decimals: int | None) -> np.ndarray:
    """Halves go away from 0; what is a half in decimals may lie a little below it in binary."""
    return x if decimals is None else np.copysign(np.floor(np.abs(x) * 10.0**decimals + 0.5 + 1e-7) / 10.0**decimals, x)


def hashed_rows(rows: DataFrame, *keys: str, text: str = "text", dim: int = DIM, round_to: int | None = 6) -> DataFrame:
    """(keys, text) -> (keys, buckets, weights): signed counts, damped by a logarithm, of length one; no bucket for a text without terms."""

    def make() -> Callable[[list[list]], list[pa.Array]]:
        memo = Memo(lambda own: tuple(bucket_and_sign(t, dim) for t in own))

        def embed(columns: list[list]) -> list[pa.Array]:
            at, by = [], []
            for i, own in enumerate(columns[0]):
                for ident, often in _identifiers(own).items() if own else ():
                    for bucket, sign in memo[ident]:
                        at.append(i * dim + bucket)
                        by.append(sign * often)
            counts = np.bincount(np.array(at, np.int64), np.array(by, np.float64), len(columns[0]) * dim).reshape(-1, dim)
            damped = np.copysign(np.log1p(np.abs(counts)), counts)
            length = np.sqrt((damped * damped).sum(1, keepdims=True))
            row, bucket = np.nonzero(counts)
            sizes = np.bincount(row, minlength=len(counts))
            weights = half_up(damped[row, bucket] / length[row, 0], round_to)
            return [_lists(sizes, pa.array(bucket.astype(np.int32))), _lists(sizes, pa.array(weights))]

        return embed

    return _mapped(rows, keys, [text], [("buckets", T.ArrayType(T.IntegerType())), ("weights", T.ArrayType(T.DoubleType()))], make)
