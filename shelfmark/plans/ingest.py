"""The weekly ingest: check, clean, score, embed, load. Each step can be run on its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, Observation, SparkSession

from shelfmark import schemas, settings
from shelfmark.functions import parse
from shelfmark.functions.text import clean_list, clean_text, product_text, title_terms
from shelfmark.operators import models, tracking
from shelfmark.session import spread
from shelfmark.sources import tables
from shelfmark.sources.jsonl import BAD, check_inputs, json_list, read_jsonl, readable


def has_product_key() -> Column:
    return F.coalesce("parent_asin", F.lit("")) != ""


def has_review_fields() -> Column:
    named = (F.coalesce("parent_asin", F.lit("")) != "") & (F.coalesce("user_id", F.lit("")) != "")
    return named & F.col("rating").isNotNull()


def clean_products(raw: DataFrame) -> DataFrame:
    """Cleaned metadata of the rows that have a key; other columns of ``raw`` stay."""
    rest = [c for c in raw.columns if c not in schemas.RAW_PRODUCT_FIELDS]
    return raw.filter(has_product_key()).select(
        "parent_asin",
        *[clean_text(c).alias(c) for c in ("title", "subtitle", "author", "main_category", "store")],
        "average_rating", "rating_number", "price",
        clean_list(json_list(F.col("features"))).alias("features"),
        clean_list(json_list(F.col("description"))).alias("description"),
        json_list(F.col("categories")).alias("categories"),
        "details", "images", "videos", "bought_together",
        *rest,
    )


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Cleaned reviews with defaults, without rows that lack product, user or rating."""
    rest = [c for c in raw.columns if c not in schemas.RAW_REVIEW_FIELDS]
    return raw.filter(has_review_fields()).select(
        "parent_asin", "asin", "user_id",
        F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0)).alias("rating"),
        clean_text("title").alias("title"),
        clean_text("text").alias("text"),
        parse.whole(F.col("helpful_vote")).alias("helpful_vote"),
        parse.flag(F.col("verified_purchase")).alias("verified_purchase"),
        "timestamp",
        *rest,
    )


def product_rows(cleaned: DataFrame) -> DataFrame:
    """Cleaned metadata in the column types of the product table, with the title's search terms."""
    rest = [c for c in cleaned.columns if c not in schemas.RAW_PRODUCT_FIELDS]
    return cleaned.select(
        "parent_asin", "title", "subtitle", "author", "main_category", "store",
        F.col("average_rating").try_cast("decimal(3,1)").alias("average_rating"),
        F.col("rating_number").try_cast("int").alias("rating_number"),
        F.col("price").alias("price_raw"),
        parse.parse_price(F.col("price")).alias("price"),
        "features", "description", "categories", "details", "images", "videos", "bought_together",
        title_terms("title").alias("title_terms"),
        *rest,
    )


def review_rows(cleaned: DataFrame) -> DataFrame:
    """Cleaned reviews in the column types of the review table."""
    scored = "sentiment_label" in cleaned.columns
    label = F.lower("sentiment_label") if scored else F.lit(None).cast("string")
    score = F.round("sentiment_score", 4) if scored else F.lit(None)
    used = {*schemas.RAW_REVIEW_FIELDS, "sentiment_label", "sentiment_score"}
    return cleaned.select(
        "parent_asin", "asin", "user_id",
        F.col("rating").try_cast("decimal(2,1)").alias("rating"),
        "title",
        F.col("text").alias("review_text"),
        "helpful_vote", "verified_purchase",
        parse.epoch_ms(F.col("timestamp")).alias("timestamp_raw"),
        parse.parse_time(F.col("timestamp")).alias("reviewed_at"),
        label.alias("sentiment_label"),
        score.cast("decimal(6,4)").alias("sentiment_score"),
        *[c for c in cleaned.columns if c not in used],
    )


def valid_rating() -> Column:
    return F.coalesce(F.col("rating").between(1, 5), F.lit(False))


def skipped_counts(raw: DataFrame, keep: Column) -> DataFrame:
    """Rows read, kept and skipped by a cleaning filter, in one pass."""
    return raw.agg(
        F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped")
    )


def counted(raw: DataFrame, keep: Column, seen: Observation) -> DataFrame:
    """Watch how many lines are unreadable and how many readable ones the filter will skip."""
    bad = F.col(BAD).isNotNull()
    return raw.observe(
        seen, F.count_if(bad).alias("unreadable"), F.count_if(~bad & ~keep).alias("skipped")
    )


@dataclass
class Encoder:
    """How product text becomes vectors: a function from (df, text column) to df + ``embedding``."""

    apply: Callable[[DataFrame, str], DataFrame]
    name: str
    dim: int


def default_encoder(dim: int = settings.EMBEDDING_DIM) -> Encoder:
    return Encoder(lambda df, text: models.hashing_encoder(df, text, dim), "hashing-bag-of-words", dim)


def embed_products(cleaned: DataFrame, encoder: Encoder, run_id: str | None = None) -> DataFrame:
    text = product_text(F.col("title"), F.col("features"), F.col("parent_asin"))
    encoded = encoder.apply(cleaned.select("parent_asin", text.alias("product_text")), "product_text")
    return models.embedding_rows(encoded, "embedding", encoder.dim, encoder.name, run_id)


def ingest(
    spark: SparkSession,
    store: tables.TableStore,
    product_path: str,
    review_path: str,
    batch: str,
    encoder: Encoder | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None,
    run_id: str | None = None,
    drop_repeats: bool = False,
    spread_to: int | None = None,
) -> DataFrame:
    """Run the whole job and return the counts of loaded, skipped and set-aside rows.

    ``score`` adds sentiment columns to cleaned reviews. A batch may be repeated: products and
    embeddings merge by key and the reviews of a batch replace themselves. With ``drop_repeats``,
    reviews that an earlier batch holds are left out too; the counts are those before that. ``spread_to`` deals raw rows out to
    so many tasks, for gzip files, which one task has to read each. All counts are observed while rows are written; no
    table is read to count it.
    """
    encoder = encoder or default_encoder()
    found = {r["path"]: r["found"] for r in check_inputs(spark, [product_path, review_path]).collect()}
    product_seen, review_seen = Observation(), Observation()
    product_made, vector_made, vector_new, staged_made = (Observation() for _ in range(4))
    rows = F.count(F.lit(1)).alias("n")

    raw = read_jsonl(spark, found[product_path], schemas.RAW_PRODUCT_FIELDS)
    cleaned = clean_products(readable(counted(spread(raw, spread_to), has_product_key(), product_seen)))
    # Products and embeddings read the same cleaned rows; they are written once in between.
    store.append("clean_products", cleaned, batch)
    cleaned = store.read_batch("clean_products", None, batch)
    fresh = product_rows(cleaned)
    old = store.read("products", schemas.PRODUCTS)
    merged = tables.upsert_products(old, fresh, ["_source"]).observe(product_made, rows)
    store.replace("products", merged, ["parent_asin"])
    products = store.read("products", schemas.PRODUCTS)

    started, clock = datetime.now(timezone.utc), time.perf_counter()
    one_per_key = tables.last_by(cleaned, ["parent_asin"], ["_source"])
    vectors = tables.known_keys(embed_products(one_per_key, encoder, run_id), products).observe(vector_new, rows)
    old = store.read("embeddings", schemas.EMBEDDINGS)
    store.replace("embeddings", tables.upsert_embeddings(old, vectors).observe(vector_made, rows), ["parent_asin"])
    elapsed = time.perf_counter() - clock

    raw = read_jsonl(spark, found[review_path], schemas.RAW_REVIEW_FIELDS)
    reviews = clean_reviews(readable(counted(spread(raw, spread_to), has_review_fields(), review_seen)))
    if score is not None:
        reviews = score(reviews)
    loaded = tables.known_keys(review_rows(reviews).drop("_source"), products)
    loaded = loaded.withColumn("ingested_at", F.current_timestamp()).withColumn("batch_ok", valid_rating())
    loaded = loaded.observe(staged_made, F.count_if("batch_ok").alias("ok"), F.count_if(~F.col("batch_ok")).alias("aside"))
    store.append("staged_reviews", loaded, batch)
    staged = store.read_batch("staged_reviews", None, batch)
    earlier = store.read_appended("reviews", schemas.REVIEWS, without=batch)
    ok = staged.filter("batch_ok").drop("batch_ok")
    if drop_repeats:
        # Loaded under another batch name before, or twice in this file.
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in tables.REVIEW_KEY]
        ok = tables.drop_repeats(ok).alias("n").join(earlier.alias("o"), same, "left_anti")
    store.append("reviews", tables.with_new_ids(ok, earlier, "review_id"), batch)

    embedded = vector_new.get["n"]
    timing = spark.createDataFrame(
        [(run_id or batch, started, embedded, elapsed, encoder.dim, encoder.name)],
        "run_id string, started_at timestamp, items long, elapsed_s double, dim int, model string",
    )
    store.append("runs", tracking.embedding_runs(timing), batch)
    return spark.range(1).select(
        F.lit(product_made.get["n"]).alias("products"),
        F.lit(vector_made.get["n"]).alias("embeddings"),
        F.lit(staged_made.get["ok"]).alias("reviews_loaded"),
        F.lit(staged_made.get["aside"]).alias("reviews_set_aside"),
        *[F.lit(product_seen.get[c]).alias(f"product_{c}") for c in ("unreadable", "skipped")],
        *[F.lit(review_seen.get[c]).alias(f"review_{c}") for c in ("unreadable", "skipped")],
    )
