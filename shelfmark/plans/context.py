"""Review context, prompt and token estimate for search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import settings
from shelfmark.functions import text as T
from shelfmark.operators.ranking import top_rows
from shelfmark.session import materialize


def _order() -> list[Column]:
    return [F.col("helpful_vote").desc_nulls_first(), F.col("review_id").asc()]


def review_context(
    hits: DataFrame, reviews: DataFrame, limit: int = settings.CONTEXT_REVIEWS
) -> DataFrame:
    """The most helpful review texts over all hits of one search, in order.

    The hits of a search end in a limit, from which Spark sees that they can be broadcast.
    """
    return (
        reviews.filter(F.col("review_text").isNotNull())
        .join(hits.select("parent_asin"), "parent_asin", "left_semi")
        .select("review_id", "parent_asin", "helpful_vote", "review_text")
        .orderBy(*_order())
        .limit(limit)
    )


def review_context_batch(
    hits: DataFrame, reviews: DataFrame, limit: int = settings.CONTEXT_REVIEWS
) -> DataFrame:
    """The same for many searches: (query_id, texts). Each product keeps only the reviews that
    can still be chosen before it meets the queries that hit it. The hits are needed twice, so
    the search that made them is run once and kept."""
    hits = materialize(hits.select("query_id", "parent_asin").distinct())
    usable = reviews.filter(F.col("review_text").isNotNull()).join(
        hits.select("parent_asin").distinct(), "parent_asin", "left_semi"
    )
    per_product = top_rows(usable, ["parent_asin"], _order(), limit).drop("_pos")
    joined = hits.join(per_product, "parent_asin")
    ranked = top_rows(joined, ["query_id"], _order(), limit)
    entry = F.struct("_pos", "review_text")
    return ranked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["review_text"]).alias("texts")
    )


def collected(context: DataFrame) -> DataFrame:
    """One row with the context texts as a list, empty when there are none."""
    entry = F.struct((-F.col("helpful_vote")).alias("o"), "review_id", "review_text")
    return context.agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["review_text"]).alias("texts")
    )


def with_prompt(contexts: DataFrame) -> DataFrame:
    """Add the prompt and the input token estimate to rows that hold ``texts``."""
    return contexts.withColumn("prompt", T.prompt(F.col("texts"))).withColumn(
        "input_tokens", T.input_tokens(F.col("texts"))
    )
