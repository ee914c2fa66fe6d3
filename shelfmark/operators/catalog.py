"""Catalogue queries: listing, detail, reviews, keyword search and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import settings
from shelfmark.functions import text as T
from shelfmark.operators.ranking import exact_quantiles, top_rows
from shelfmark.operators.search import all_of, product_filters, project_fields


def contains_ignoring_case(column: str, part: str) -> Column:
    """``%`` and ``_`` of the caller act as wildcards."""
    return F.col(column).ilike(f"%{part}%")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def by_rating() -> list[Column]:
    return [F.col("average_rating").desc_nulls_last(), F.col("parent_asin").asc()]


def by_helpfulness() -> list[Column]:
    """Most helpful first, then newest; an unknown date or vote count sorts first."""
    return [
        F.col("helpful_vote").desc_nulls_first(),
        F.col("reviewed_at").desc_nulls_first(),
        F.col("review_id").asc(),
    ]


def list_products(
    products: DataFrame,
    main_category: str | None = None,
    store: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    min_rating: float | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    settings.bounded("limit", limit, 1, 200)
    settings.bounded("offset", offset, 0, float("inf"))
    settings.bounded("min_rating", min_rating, 1.0, 5.0)
    preds = [product_filters(max_price, min_rating)]
    if main_category:
        preds.append(contains_ignoring_case("main_category", main_category))
    if store:
        preds.append(contains_ignoring_case("store", store))
    if min_price is not None:
        preds.append(F.col("price") >= F.lit(min_price))
    kept = products.filter(all_of(preds)).select(*settings.LISTING_FIELDS)
    return page(kept, by_rating(), limit, offset)


def review_row() -> list[Column]:
    return [
        F.col(c).cast("string").alias(c) if c == "reviewed_at" else F.col(c)
        for c in settings.REVIEW_FIELDS
    ]


def list_reviews(
    reviews: DataFrame,
    parent_asin: str,
    verified_only: bool = False,
    min_rating: float | None = None,
    sentiment: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    settings.bounded("limit", limit, 1, 200)
    settings.bounded("offset", offset, 0, float("inf"))
    settings.bounded("min_rating", min_rating, 1.0, 5.0)
    if sentiment and sentiment not in settings.SENTIMENT_LABELS:
        raise ValueError(f"sentiment must be one of {settings.SENTIMENT_LABELS}")
    preds = [F.col("parent_asin") == parent_asin]
    if verified_only:
        preds.append(F.col("verified_purchase"))
    if min_rating is not None:
        preds.append(F.col("rating") >= F.lit(min_rating))
    if sentiment:
        preds.append(F.col("sentiment_label") == sentiment)
    # Order before the text form of the date replaces the date itself.
    return page(reviews.filter(all_of(preds)), by_helpfulness(), limit, offset).select(*review_row())


def with_top_reviews(products: DataFrame, reviews: DataFrame, review_limit: int = 5) -> DataFrame:
    """Every product with its first reviews nested as an array of structs, ``[]`` when none."""
    settings.bounded("review_limit", review_limit, 1, 50)
    ranked = top_rows(reviews, ["parent_asin"], by_helpfulness(), review_limit)
    entry = F.struct(F.col("_pos"), *review_row())
    nested = ranked.groupBy("parent_asin").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    plain = F.transform(
        "_rows", lambda r: F.struct(*[r[c].alias(c) for c in settings.REVIEW_FIELDS])
    )
    joined = products.join(nested.select("parent_asin", plain.alias("reviews")), "parent_asin", "left")
    return joined.withColumn("reviews", F.coalesce("reviews", F.array()))


def product_detail(
    products: DataFrame,
    reviews: DataFrame,
    parent_asin: str,
    include_reviews: bool = True,
    review_limit: int = 5,
) -> DataFrame:
    """One product with nested reviews; no row when the key is unknown."""
    here = F.col("parent_asin") == parent_asin
    found = products.filter(here).select(*[c for c in settings.DETAIL_FIELDS if c in products.columns])
    if not include_reviews:
        return found
    return with_top_reviews(found, reviews.filter(here), review_limit)


def keyword_search(
    products: DataFrame,
    query: str,
    *,
    stemming: bool = True,
    fields: Sequence[str] | None = None,
    max_price: float | None = None,
    min_rating: float | None = None,
    limit: int = 10,
) -> DataFrame:
    """Products whose title holds every query term. A query of stop words matches nothing.

    With stored ``title_terms``, as ingested tables have them, stems are looked up in that column, in the JVM; titles
    without it are stemmed in the search, which takes a Python worker.
    """
    settings.bounded("limit", limit, 1, 100)
    columns = project_fields(fields)
    terms = T.query_terms(query, stemming)
    kept = products.filter(product_filters(max_price, min_rating))
    if not terms:
        kept = kept.filter(F.lit(False))
    else:
        words = T.tokens(F.col("title"))
        if stemming:
            words = F.col("title_terms") if "title_terms" in products.columns else T.title_terms("title")
        kept = kept.filter(all_of([F.array_contains(words, t) for t in terms]))
    # average_rating may not be among the projected columns, so order first.
    return page(kept, by_rating(), limit).select(*columns)


def mean_decimal(column: Column, digits: int) -> Column:
    """Mean rounded half up from an exact decimal, not from a binary sum."""
    return F.round(F.avg(column.cast("decimal(20,8)")), digits)


def catalog_counts(products: DataFrame, reviews: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Row counts of the three tables and the mean product rating, one row of scalar subqueries."""
    spark = products.sparkSession
    return spark.range(1).select(
        products.agg(F.count("*")).scalar().alias("total_products"),
        reviews.agg(F.count("*")).scalar().alias("total_reviews"),
        embeddings.agg(F.count("*")).scalar().alias("total_embeddings"),
        products.agg(mean_decimal(F.col("average_rating"), 2)).scalar().alias("avg_rating"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per whole star with the mean classifier confidence (not a polarity)."""
    return (
        reviews.groupBy(F.floor("rating").alias("rating"))
        .agg(
            F.count("*").alias("review_count"),
            mean_decimal(F.col("sentiment_score"), 4).alias("avg_sentiment"),
        )
        .orderBy("rating")
    )


def price_summary(products: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and exact interpolated median of the known prices."""
    spark = products.sparkSession
    priced = products.filter(F.col("price").isNotNull())
    stats = priced.agg(
        F.struct(
            F.round(F.min("price"), 2).alias("low"),
            F.round(F.max("price"), 2).alias("high"),
            mean_decimal(F.col("price"), 2).alias("mean"),
        )
    ).scalar()
    median = exact_quantiles(priced.select("price"), "price", {"m": 0.5}).scalar()
    return spark.range(1).select(
        stats["low"].alias("min_price"),
        stats["high"].alias("max_price"),
        stats["mean"].alias("avg_price"),
        F.round(median, 2).alias("median_price"),
    )


def metrics_summary(products: DataFrame, reviews: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Counts, rating distribution and price summary nested in a single row."""
    star = F.struct("rating", "review_count", "avg_sentiment")
    stars = rating_distribution(reviews).agg(F.array_sort(F.collect_list(star))).scalar()
    price = price_summary(products)
    return catalog_counts(products, reviews, embeddings).select(
        "*",
        stars.alias("rating_distribution"),
        price.select(F.struct(*price.columns)).scalar().alias("price_summary"),
    )
