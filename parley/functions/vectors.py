"""Vector columns: similarities as JVM expressions, embeddings as Arrow UDFs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def dot(a: Column, b: Column) -> Column:
    """Plain dot product in double precision over the common length."""
    a, b = _common(a, b)
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 when either side has no direction."""
    a, b = _common(a, b)
    sq_a = _fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))
    sq_b = _fold(F.transform(b, lambda x: x.cast("double") * x.cast("double")))
    norm = F.sqrt(sq_a) * F.sqrt(sq_b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def length(a: Column) -> Column:
    """Length of a vector, 1 where it has none, so that dividing by it is always possible."""
    norm = F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norm > 0, norm).otherwise(F.lit(1.0))


def unit(a: Column) -> Column:
    """The vector scaled to unit length, in double precision; all zeros stay zeros."""
    norm = F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))
    # the length is the element of an array, so that it is found once and not again for every coordinate
    return F.transform(F.array(norm), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def scaled_dot(a: Column, len_a: Column, b: Column, len_b: Column) -> Column:
    """Cosine of two vectors of equal dimension whose lengths (``length``) are known."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") / len_a) * (y.cast("double") / len_b)))


def unit_scale(similarity: Column) -> Column:
    """Cosine moved to 0..1."""
    return (similarity + 1) / 2


#: Letters and digits that a label's profile counts.
PROFILE = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_profile(text: Column) -> Column:
    """A vector of a short label, in the JVM: how often each letter and digit occurs, ignoring case.

    Labels that differ in few letters are near; a text without any of them has no direction.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in PROFILE])


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """Default text embedder: signed hashed word counts, scaled to unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            # whole counts add up exactly, in any order, so each word is hashed once per text
            for token, n in Counter(text.lower().split()).items():
                h = xxhash.xxh64_intdigest(token)
                out[i, h % dim] += n if (h >> 32) & 1 else -n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32).tolist()

    return embed


def embed(
    df: DataFrame,
    text_col: str,
    embed_fn: Callable[[list[str]], list[list[float]]],
    out_col: str = "embedding",
    prefix: str = "query: ",
) -> DataFrame:
    """Add the embedding of a text column; blank and null texts get null.

    ``embed_fn`` receives one Arrow batch of texts at a time and is shipped once
    per Python worker.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            present = texts.notna() & (texts.str.len() > 0)
            result = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if present.any():
                vectors = embed_fn([prefix + t for t in texts[present]])
                result[present] = pd.Series(list(vectors), index=texts.index[present], dtype=object)
            yield result

    return df.withColumn(out_col, run(F.col(text_col)))
