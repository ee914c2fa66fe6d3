"""Product-retrieval views over the TPC-H-like test tables.

They give the operators the table shapes they expect: products, reviews, embeddings and
request telemetry. Each view reads only the columns and joins that the caller asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.session import spread

TEST_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of one narrow file with few row groups, dealt out to all cores for costly row work."""
    return spread(table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def asin(number: Column) -> Column:
    return F.concat(F.lit("P"), number.cast("string"))


def product_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review count and one-decimal mean rating per product, in exact integer arithmetic."""
    halves = F.lit(2) + F.col("l_quantity").cast("int") % 9
    counted = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(halves).alias("halves"), F.count("*").alias("n"))
    )
    tenths = F.expr("(10 * halves + n) div (2 * n)")
    return counted.select(
        "l_partkey",
        F.col("n").cast("int").alias("rating_number"),
        (tenths / F.lit(10.0)).cast("decimal(3,1)").alias("average_rating"),
    )


def products(spark: SparkSession, sf_dir: str, ratings: bool = True) -> DataFrame:
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice").cast("decimal(10,2)"))
    columns = [
        asin(F.col("p_partkey")).alias("parent_asin"),
        F.col("p_name").alias("title"),
        F.lit(None).cast("string").alias("subtitle"),
        F.lit(None).cast("string").alias("author"),
        F.col("p_type").alias("main_category"),
        F.col("p_brand").alias("store"),
        F.concat(F.lit("$"), F.col("p_retailprice").cast("string")).alias("price_raw"),
        price.alias("price"),
        F.array(F.col("p_type"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("features"),
    ]
    if not ratings:
        return part.select(*columns)
    rated = part.join(product_ratings(spark, sf_dir), part.p_partkey == F.col("l_partkey"), "left")
    return rated.select(
        *columns, "average_rating", F.coalesce("rating_number", F.lit(0)).alias("rating_number")
    )


def reviews(
    spark: SparkSession, sf_dir: str, *, user: bool = False, text: bool = False
) -> DataFrame:
    """One review per line item. ``user`` joins orders, ``text`` joins documents."""
    items = table(spark, sf_dir, "lineitem")
    rating = F.lit(1) + (F.col("l_quantity").cast("int") % 9) / F.lit(2.0)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    out = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("review_id"),
        asin(F.col("l_partkey")).alias("parent_asin"),
        rating.alias("rating"),
        F.lit(None).cast("string").alias("title"),
        F.round(F.col("l_discount") * 100).cast("int").alias("helpful_vote"),
        (F.col("l_returnflag") != "R").alias("verified_purchase"),
        F.when(F.col("l_quantity") != 50, F.col("l_shipdate").cast("timestamp")).alias("reviewed_at"),
        F.when(rating >= 3, "positive").otherwise("negative").alias("sentiment_label"),
        F.round(F.lit(0.5) + F.col("l_tax") * 5, 4).alias("sentiment_score"),
        F.col("l_orderkey").alias("_order"),
        F.col("l_linenumber").alias("_line"),
    )
    if user:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("_order"), F.col("o_custkey").alias("user_id")
        )
        out = out.join(orders, "_order", "left")
    if text:
        out = with_review_text(spark, sf_dir, out)
    return out.drop("_order", "_line")


def with_review_text(spark: SparkSession, sf_dir: str, reviews_df: DataFrame) -> DataFrame:
    """Attach a document as the review text; line 7 of an order has none."""
    docs = table(spark, sf_dir, "documents")
    n_docs = docs.agg(F.count("*")).scalar()
    slot = F.when(F.col("_line") != 7, F.col("_order") % n_docs)
    return (
        reviews_df.withColumn("_doc", slot)
        .join(docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("review_text")), "_doc", "left")
        .drop("_doc")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        asin(F.col("vec_id")).alias("parent_asin"), "embedding", F.col("label").alias("category"), "vec_id"
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: latency in seconds, status from the event type, tokens from the payload."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("search_type"),
        (F.col("value") / 100).alias("seconds"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.get_json_object("props", "$.k").cast("int").alias("tokens"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_of(dealt(spark, sf_dir, "events"))


def observations_of(events: DataFrame) -> DataFrame:
    """Metric observations as each request would have recorded them: several per event."""
    e = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    kind, v, k = F.col("kind"), F.col("v"), F.col("k")
    half = k < 50
    model = F.when(half, "model-a").otherwise("model-b")
    top_k = F.when(half, "5").otherwise("10")
    http = {
        "method": F.lit("GET"),
        "endpoint": F.concat(F.lit("/"), kind),
        "status_code": F.when(kind == "error", "500").otherwise("200"),
    }
    summarised = kind.isin("purchase", "signup")
    failed = kind == "error"

    def seen(metric: str, labels: dict[str, Column], value: Column, when: Column | None = None) -> Column:
        pairs = [x for name, c in labels.items() for x in (F.lit(name), c)]
        keyed = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        row = F.struct(F.lit(metric).alias("metric"), keyed.alias("labels"), value.cast("double").alias("value"))
        return row if when is None else F.when(when, row)

    one = F.lit(1.0)
    rows = [
        seen(
            "search_execution_seconds",
            {
                "has_vector": F.when(kind == "click", "False").otherwise("True"),
                "category_filter": F.when(half, "False").otherwise("True"),
            },
            v / 25,
        ),
        seen("search_requests_total", {"search_type": kind}, one),
        seen("hnsw_stage1_scan_seconds", {"top_k": top_k}, v / 200),
        seen("hnsw_stage2_rerank_seconds", {"top_k": top_k}, v / 100),
        seen("db_query_seconds", {"query_type": F.when(half, "vector_search").otherwise("reviews")}, v / 50),
        seen("http_requests_total", http, one),
        seen("http_request_duration_seconds", http, v / 100),
        seen("llm_generation_seconds", {"model_name": model}, v / 2, summarised),
        seen("llm_time_to_first_token_seconds", {"model_name": model}, v / 15, summarised),
        seen("llm_tokens_total", {"model_name": model, "token_type": F.lit("input")}, k * 1000, summarised),
        seen("llm_tokens_total", {"model_name": model, "token_type": F.lit("output")}, k * 10, summarised),
        seen("llm_faithfulness_score", {"model_name": model}, k / 100.0, summarised),
        seen("llm_answer_relevance_score", {"model_name": model}, (100 - k) / 100.0, summarised),
        seen("llm_errors_total", {"model_name": model, "error_type": F.lit("Timeout")}, one, failed),
        seen("search_errors_total", {"search_type": kind, "error_type": F.lit("Timeout")}, one, failed),
        seen("hnsw_recall_rate", {"k": top_k}, (100 - k / 2.0) / 100.0, kind == "signup"),
        seen("embedding_drift_score", {"category": top_k}, k / 400.0, kind == "purchase"),
        seen("pg_buffer_hit_ratio", {}, (100 - k / 5.0) / 100.0, kind == "view"),
    ]
    each = F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull()))
    return e.withColumn("o", each).select("ts", "o.*")
