"""Token counts: the exact number of tokens of every prefix of every text, without re-encoding.

A prefix table answers all questions about lengths: the count of the whole text is its last entry, the
longest prefix within a budget is the last place that does not exceed it, and the cost of a span that
starts the text is one lookup. Texts are independent, so there is no shuffle.

A null text counts as an empty one: no tokens, no prefixes. Repeated rows get equal answers. Extra
columns are left alone; the result column has the caller's name and replaces one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.pretokens import PrefixCounter


@lru_cache(maxsize=2)
def _counter(data: bytes) -> PrefixCounter:
    return PrefixCounter(data)


def _vocabulary(spark: SparkSession, path: str):
    """The tokenizer file, read where the job is written and sent along; such files have a few MB."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def prefix_counts(spark: SparkSession, text: Column, path: str) -> Column:
    """``array<int>``: the token count after each character of ``text``."""
    data = _vocabulary(spark, path)

    @F.pandas_udf("array<int>")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(data.value)
        for texts in batches:
            yield pd.Series([counter.counts(x or "").astype(np.int32) for x in texts])

    return table(text)


def fit(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens. Counts may fall by one merge as
    a text grows, so the last place that fits is wanted, not the first that doesn't."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    fitting = np.flatnonzero(counts <= budget)
    return int(fitting[-1]) + 1 if len(fitting) else 0


def token_counts(spark: SparkSession, text: Column, path: str, limit: int) -> Column:
    """Struct of n_bytes, n_tokens, over_limit and fit_chars: the characters of the longest prefix
    within ``limit`` tokens."""
    data = _vocabulary(spark, path)

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    def table(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(data.value)
        for texts in batches:
            rows = []
            for x in texts:
                x = x or ""
                counts = counter.counts(x)
                n = int(counts[-1]) if len(counts) else 0
                rows.append((len(x.encode("utf-8")), n, n > limit, fit(counts, limit)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return table(text)
