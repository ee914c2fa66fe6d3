"""Table schemas. Readers never infer them."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw fields are all read as text; lists and documents keep their JSON and are parsed later, so a
# field of an unexpected type spoils neither its row nor its neighbours.
RAW_PRODUCT_FIELDS = [
    "parent_asin", "title", "subtitle", "author", "main_category", "store", "average_rating",
    "rating_number", "price", "features", "description", "categories", "details", "images",
    "videos", "bought_together",
]
RAW_REVIEW_FIELDS = [
    "parent_asin", "asin", "user_id", "rating", "title", "text", "helpful_vote",
    "verified_purchase", "timestamp",
]

PRODUCTS = """
    parent_asin string, title string, subtitle string, author string, main_category string,
    store string, average_rating decimal(3,1), rating_number int, price_raw string,
    price decimal(10,2), features array<string>, description array<string>,
    categories array<string>, details string, images string, videos string,
    bought_together string, title_terms array<string>, ingested_at timestamp
"""
REVIEWS = """
    review_id bigint, parent_asin string, asin string, user_id string, rating decimal(2,1),
    title string, review_text string, helpful_vote int, verified_purchase boolean,
    timestamp_raw bigint, reviewed_at timestamp, sentiment_label string,
    sentiment_score decimal(6,4), ingested_at timestamp
"""
EMBEDDINGS = """
    parent_asin string, embedding array<float>, embedding_half array<float>,
    bits array<bigint>, model_name string, run_id string, ingested_at timestamp
"""
RUNS = """
    run_id string, name string, started_at timestamp, params map<string,string>,
    metrics map<string,double>
"""


def raw(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])
