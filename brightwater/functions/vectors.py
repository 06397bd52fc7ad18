"""Vector arithmetic as columns, and the hash embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts whose sums a worker holds at once.
SUMMED_ROWS = 2048


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is all zeros."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def _code_sums(texts: Sequence[str | None], dims: int) -> np.ndarray:
    sums = np.zeros((len(texts), dims))
    for row, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-16-le"), dtype="<u2")
        whole = len(codes) // dims * dims
        if whole:
            sums[row] += codes[:whole].reshape(-1, dims).sum(axis=0, dtype=np.int64)
        sums[row, : len(codes) - whole] += codes[whole:]
    return sums


def hash_vectors(texts: Sequence[str | None], dims: int) -> np.ndarray:
    """One unit vector per text: character code / 255 summed at position modulo ``dims``.

    Codes are UTF-16 units. They are summed as integers, so equal texts give equal vectors.
    """
    vectors = _code_sums(texts, dims) / 255.0
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(lengths == 0, 1.0, lengths)


def hash_embed(text: Column, dims: int = 768) -> Column:
    """The hash embedding of a text column, computed on Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_vectors(texts.tolist(), dims)))

    return embed(text)


def hash_sums(text: Column, dims: int = 768) -> Column:
    """The hash embedding before it is scaled to length 1: whole numbers, which are small to send and to store.

    They point the same way, so cosine similarities are those of ``hash_embed``.
    """

    @F.arrow_udf("array<int>")
    def embed(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.int32())]
        for start in range(0, len(texts), SUMMED_ROWS):
            sums = _code_sums(texts.slice(start, SUMMED_ROWS).to_pylist(), dims)
            # a number that is too large raises
            parts.append(pa.array(sums.astype(np.int64).reshape(-1)).cast(pa.int32()))
        starts = np.arange(len(texts) + 1, dtype=np.int32) * dims
        return pa.ListArray.from_arrays(pa.array(starts), pa.concat_arrays(parts))

    return embed(text)


def hash_similarity(a: Column, b: Column, dims: int = 768) -> Column:
    """Cosine of the hash embeddings of two texts, without keeping the vectors."""

    @F.pandas_udf("double")
    def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
        products = hash_vectors(left.tolist(), dims) * hash_vectors(right.tolist(), dims)
        return pd.Series(products.sum(axis=1))

    return similarity(a, b)
