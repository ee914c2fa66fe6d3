"""A small deterministic catalogue for trying things out and for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark import settings
from shelfmark.functions.vectors import l2_normalize

# Stars of the review templates.
REVIEW_RATINGS = [5, 5, 4, 3, 5, 2, 5, 4, 1, 5]


def seed_products(spark: SparkSession, n: int = 10) -> DataFrame:
    number = F.col("id") + 1
    return spark.range(n).select(
        F.format_string("SEED_%06d", number).alias("parent_asin"),
        F.format_string("Gift card design %d", number).alias("title"),
        F.lit("Gift Cards").alias("main_category"),
        F.concat(F.lit("store "), (F.col("id") % 3).cast("string")).alias("store"),
        (F.lit(4.4) + F.col("id") % 6 / 10).cast("decimal(3,1)").alias("average_rating"),
        (F.lit(100) * number).cast("int").alias("rating_number"),
        F.format_string("$%d.00", 10 * (F.col("id") % 10 + 1)).alias("price_raw"),
        (10 * (F.col("id") % 10 + 1)).cast("decimal(10,2)").alias("price"),
    )


def seed_reviews(spark: SparkSession, n: int = 10, per_product: int = 3, seed: int = 7) -> DataFrame:
    """``per_product`` reviews for each product, drawn from the fixed ratings."""
    pick = F.floor(F.rand(seed) * len(REVIEW_RATINGS)).cast("int")
    rating = F.get(F.array(*[F.lit(float(r)) for r in REVIEW_RATINGS]), F.col("_pick"))
    return (
        spark.range(n * per_product)
        .withColumn("_pick", pick)
        .select(
            (F.col("id") + 1).alias("review_id"),
            F.format_string("SEED_%06d", F.floor(F.col("id") / per_product) + 1).alias("parent_asin"),
            F.format_string("user%d", F.col("id") % 5).alias("user_id"),
            rating.cast("decimal(2,1)").alias("rating"),
            F.format_string("Review text %d", F.col("_pick")).alias("review_text"),
            (F.col("id") % 4).cast("int").alias("helpful_vote"),
            F.when(rating >= 4, "positive").otherwise("negative").alias("sentiment_label"),
        )
    )


def seed_embeddings(
    spark: SparkSession, n: int = 10, dim: int = settings.EMBEDDING_DIM, seed: int = 11
) -> DataFrame:
    """Random unit vectors, one per product."""
    values = F.array(*[F.randn(seed + i) for i in range(dim)])
    return (
        spark.range(n)
        .select(F.format_string("SEED_%06d", F.col("id") + 1).alias("parent_asin"), values.alias("v"))
        .select("parent_asin", l2_normalize(F.col("v")).alias("embedding"))
    )
