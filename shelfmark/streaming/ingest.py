"""Incremental ingest: new files merge into the keyed tables batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, Observation, types as T

from shelfmark import schemas
from shelfmark.plans.ingest import (
    Encoder, clean_products, clean_reviews, counted, embed_products, has_product_key, has_review_fields,
    product_rows, review_rows, valid_rating,
)
from shelfmark.session import materialize
from shelfmark.sources.buckets import BucketStore
from shelfmark.sources.jsonl import BAD, readable
from shelfmark.sources.tables import TableStore, known_keys, last_by, upsert_embeddings, upsert_products

#: What a batch of reviews came to; one row a batch, replaced when the batch is repeated.
COUNTS = "batch string, unreadable long, skipped long, set_aside long, unknown long, loaded long"
_ORDER = ["_file", "_start", "_row"]


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``apply`` and stop when no input is left."""
    (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def upsert_stream(
    stream: DataFrame,
    store: BucketStore,
    name: str,
    schema: str,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
    source: str = "stream",
    keep: int = 2,
) -> None:
    """Merge every micro-batch into the buckets of ``name`` that it has keys of.

    A batch that is repeated after a failure is known by ``source`` and its number, and not merged again; one
    that failed half-way left no version. Versions beyond the last ``keep`` are cleared away.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.merge(name, schema, batch, merge, f"{source}-{number}")
        store.vacuum(name, keep)

    run_batches(stream, apply, checkpoint)


def read_lines(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """JSON lines of a folder as a stream, with unreadable ones in their column and the place of each file."""
    raw = (
        spark.readStream.schema(schemas.raw([*fields, BAD]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .json(folder)
    )
    return raw.select(
        *fields, BAD, F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def ingest_product_files(spark: SparkSession, folder: str, store: BucketStore, checkpoint: str) -> None:
    """Take the product files that arrived in ``folder`` since the last run."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert_products(old, batch, _ORDER)

    def apply(batch: DataFrame, number: int) -> None:
        rows = product_rows(clean_products(readable(batch))).withColumn("_row", F.monotonically_increasing_id())
        store.merge("products", schemas.PRODUCTS, rows, merge, f"products-{number}")
        store.vacuum("products")

    run_batches(read_lines(spark, folder, schemas.RAW_PRODUCT_FIELDS), apply, checkpoint)


def ingest_embeddings(
    spark: SparkSession, folder: str, store: BucketStore, encoder: Encoder, checkpoint: str, run_id: str | None = None
) -> None:
    """Embed the products of the files that arrived in ``folder`` since the last run, as far as they are known."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = clean_products(readable(batch)).withColumn("_row", F.monotonically_increasing_id())
        last = last_by(materialize(rows), ["parent_asin"], _ORDER)
        products = store.read("products", schemas.PRODUCTS)
        vectors = known_keys(embed_products(last, encoder, run_id), products)
        store.merge("embeddings", schemas.EMBEDDINGS, vectors, upsert_embeddings, f"embeddings-{number}")
        store.vacuum("embeddings")

    run_batches(read_lines(spark, folder, schemas.RAW_PRODUCT_FIELDS), apply, checkpoint)


def review_batch(
    raw: DataFrame, products: DataFrame, store: TableStore, batch: str, name: str = "reviews"
) -> None:
    """Clean, check and append the raw reviews of one batch; repeating a batch replaces it.

    Lines that can't be read, that lack a field, whose rating is out of range or whose product is unknown are
    counted while the rows are written, not in passes of their own. Ids are text, the batch's name and a number
    that grows along its files, so batches need not know each other's ids.
    """
    seen, told = Observation(), Observation()
    numbered = raw.withColumn("_row", F.monotonically_increasing_id())
    typed = review_rows(clean_reviews(readable(counted(numbered, has_review_fields(), seen))))
    keys = products.select("parent_asin").distinct().withColumn("_known", F.lit(True))
    known = F.col("_known").isNotNull()
    marked = typed.join(keys, "parent_asin", "left").observe(
        told,
        F.count_if(~valid_rating()).alias("set_aside"),
        F.count_if(valid_rating() & ~known).alias("unknown"),
        F.count_if(valid_rating() & known).alias("loaded"),
    )
    rows = marked.filter(valid_rating() & known).withColumns({
        "review_id": F.concat_ws("-", F.lit(batch), F.col("_row").cast("string")),
        "ingested_at": F.current_timestamp(),
    })
    columns = [f.name for f in T._parse_datatype_string(STREAMED_REVIEWS).fields]
    store.append(name, rows.select(*columns), batch)
    row = (
        batch, *(seen.get[c] for c in ("unreadable", "skipped")),
        *(told.get[c] for c in ("set_aside", "unknown", "loaded")),
    )
    store.append(f"{name}_counts", raw.sparkSession.createDataFrame([row], COUNTS), batch)


#: Reviews as the stream stores them: ids are text.
STREAMED_REVIEWS = schemas.REVIEWS.replace("review_id bigint", "review_id string")


def append_reviews(
    stream: DataFrame, products: Callable[[], DataFrame], store: TableStore, checkpoint: str, name: str = "reviews"
) -> None:
    """Append every micro-batch of raw reviews as a batch of its own; ``products`` is asked once a batch.

    The batch's number is its name: Spark hands a batch that failed out again under the same number, and it
    replaces what the first attempt left.
    """
    run_batches(
        stream, lambda batch, number: review_batch(batch, products(), store, f"{number:09d}", name), checkpoint
    )


def ingest_review_files(
    spark: SparkSession, folder: str, tables: TableStore, keyed: BucketStore, checkpoint: str
) -> None:
    """Take the review files that arrived in ``folder`` since the last run."""
    raw = read_lines(spark, folder, schemas.RAW_REVIEW_FIELDS)
    append_reviews(raw, lambda: keyed.read("products", schemas.PRODUCTS), tables, checkpoint)
