"""Vector column expressions: sign bits, distances, normalisation, text and half precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

WORD = 64


def words_for(dim: int) -> int:
    return -(-dim // WORD)


def pack_bits(vector: Column | str, dim: int) -> Column:
    """Sign bits of a vector, 64 per ``bigint``; bit i of word w is dimension 64*w + i.

    A component counts as set when it is strictly positive.
    """
    v = F.col(vector) if isinstance(vector, str) else vector

    def word(w: int) -> Column:
        part = F.reverse(F.slice(v, w * WORD + 1, WORD))
        return F.aggregate(
            part,
            F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")),
        )

    return F.array(*[word(w) for w in range(words_for(dim))])


def pack_bits_local(vector: Sequence[float]) -> list[int]:
    """``pack_bits`` for one vector held by the caller."""
    v = np.asarray(vector, dtype=np.float64) > 0
    padded = np.zeros(words_for(len(v)) * WORD, dtype=bool)
    padded[: len(v)] = v
    return [int(x) for x in np.packbits(padded, bitorder="little").view("<i8")]


def hamming(a: Column, b: Column, words: int) -> Column:
    """Differing bits between two packed vectors; one ``bit_count`` per word, no lambda."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for w in range(1, words):
        total = total + F.bit_count(a[w].bitwiseXOR(b[w]))
    return total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` in double precision; NaN when either vector is all zero."""
    cos = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.coalesce(F.lit(1.0) - cos, F.lit(float("nan")))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; an all-zero vector stays as it is."""
    # The length is repeated next to the components: inside a lambda on v alone it would be
    # computed again for each of them.
    lengths = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(
        v, lengths, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast("float")
    )


def vector_text(v: Column) -> Column:
    """``[x,y,...]`` with six decimals per component of single precision, halves to the even digit as in C's printf.

    The JVM rounds halves up. A binary fraction lies halfway between two of six decimals only if it is an odd
    number of 128ths.
    """

    def text(x: Column) -> Column:
        x = x.cast("double")
        return F.format_string("%.6f", F.when(F.abs(x * 128) % 2 == 1, F.bround(x, 6)).otherwise(x))

    return F.concat(
        F.lit("["),
        F.array_join(F.transform(v, text), ","),
        F.lit("]"),
    )


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(v: pd.Series) -> pd.Series:
    """Round every component to half precision; Spark has no 16-bit float of its own."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))
