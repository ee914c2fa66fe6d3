"""Every operator as a query over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, SparkSession

from shelfmark.functions import parse, text as T, vectors as V
from shelfmark.operators import (
    alerts, batch_search as batch, catalog, dashboards, drift, ivf, metrics, models, ranking,
    rolling, series, tracking,
)
from shelfmark.operators.search import semantic_search
from shelfmark.plans import context, ingest
from shelfmark.session import materialize, scratch_path
from shelfmark.sources import buckets, jsonl, tables, views
from shelfmark.streaming import alerts as stream_alerts_mod, ingest as stream_ingest, walk, windows
from shelfmark import schemas

DIM = views.TEST_DIM
QUERY_VECTOR = 7
LATENCY_BOUNDS = metrics.METRICS["search_execution_seconds"].bounds

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare across engines."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- vector search -------------------------------------------------------------------------


def _search(spark: SparkSession, d: str, **kw) -> DataFrame:
    e = views.embeddings(spark, d)
    asked = e.filter(F.col("vec_id") == QUERY_VECTOR).select("embedding")
    found = semantic_search(e, views.products(spark, d), asked, dim=DIM, **kw)
    return rounded(doubles(found), "_distance")


@query
def semantic_search_top(spark, d):
    return _search(spark, d)


@query
def semantic_search_postfilter(spark, d):
    return _search(
        spark, d, top_k=20, max_price=1500.0, min_rating=2.5, only_in_stock=True,
        fields=["title", "price_raw", "rating_number", "title"],
    )


@query
def semantic_search_prefilter(spark, d):
    return _search(spark, d, top_k=10, max_price=1500.0, min_rating=2.5, filter_mode="pre")


@query
def semantic_search_stored(spark, d):
    """The search over stored vectors: bits for stage 1, the candidates' buckets for stage 2."""
    store = buckets.BucketStore(spark, scratch_path(spark, "vectors"), buckets=32)
    e = views.embeddings(spark, d)
    store.merge("vectors", buckets.VECTORS, buckets.vector_rows(e, DIM), tables.upsert)
    asked = e.filter(F.col("vec_id") == QUERY_VECTOR).select("embedding")
    found = semantic_search(store.read("vectors", buckets.VECTORS), views.products(spark, d), asked, dim=DIM, top_k=20)
    return rounded(doubles(found), "_distance")


def _centers(spark, d) -> DataFrame:
    return materialize(batch.category_centers(views.embeddings(spark, d)))


@query
def semantic_search_batch(spark, d):
    e = views.embeddings(spark, d)
    found = batch.semantic_search_batch(e, _centers(spark, d), dim=DIM)
    return rounded(found, "_distance").withColumnRenamed("_distance", "distance").withColumnRenamed(
        "_rank", "place"
    )


@query
def semantic_search_batch_filtered(spark, d):
    """Every category's centre searched among products that pass the filters, in blocks of four queries."""
    found = batch.semantic_search_batch(
        views.embeddings(spark, d), _centers(spark, d), views.products(spark, d), dim=DIM, top_k=10,
        fields=["title", "store", "price", "rating_number"], max_price=1500.0, min_rating=2.5,
        only_in_stock=True, filter_mode="pre", block_queries=4,
    )
    found = found.withColumnRenamed("_distance", "distance").withColumnRenamed("_rank", "place")
    return rounded(doubles(found), "distance")


@query
def recall_at_k(spark, d):
    e, asked = views.embeddings(spark, d), _centers(spark, d)
    exact = batch.exact_search_batch(e, asked, top_k=10)
    found = batch.semantic_search_batch(e, asked, dim=DIM, top_k=10, oversample=2)
    return rounded(batch.recall_at_k(exact, found), "recall")


def _label_lists(spark, d) -> DataFrame:
    return _centers(spark, d).select(F.col("query_id").alias("list_id"), F.col("vector").alias("centroid"))


@query
def ivf_assign(spark, d):
    return ivf.assign_lists(views.embeddings(spark, d), _label_lists(spark, d)).select(
        "parent_asin", "category", "list_id"
    )


def _ivf(spark, d, lists: DataFrame, probes: int) -> DataFrame:
    e = views.embeddings(spark, d)
    path = scratch_path(spark, "ivf")
    ivf.write_lists(ivf.assign_lists(e.select("parent_asin", "embedding"), lists), path)
    asked = e.filter(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()[0]
    return rounded(
        ivf.ivf_search(spark, path, lists, asked, probes=probes, top_k=10), "_distance"
    ).withColumnRenamed("_distance", "distance")


@query
def ivf_search(spark, d):
    return _ivf(spark, d, _label_lists(spark, d), probes=3)


@query
def ivf_search_batch(spark, d):
    """Every vector of category 5 asked of its three nearest lists, in blocks of 40 probes."""
    e, lists = views.embeddings(spark, d), _label_lists(spark, d)
    path = scratch_path(spark, "ivf")
    ivf.write_lists(ivf.assign_lists(e.select("parent_asin", "embedding"), lists), path, 100)
    asked = e.filter("category = 5").select(F.col("parent_asin").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.ivf_search_batch(spark, path, lists, asked, probes=3, top_k=10, block_probes=40)
    return rounded(found, "_distance").withColumnRenamed("_distance", "distance").withColumnRenamed("_rank", "place")


@query
def ivf_kmeans_search(spark, d):
    """Fitted lists, all of them probed: the exact answer whatever the fit."""
    lists = ivf.fit_centroids(views.embeddings(spark, d), lists=8, max_iter=5)
    return _ivf(spark, d, lists, probes=8).drop("list_id")


@query
def embedding_drift(spark, d):
    """Each category against the whole catalogue."""
    e = views.embeddings(spark, d)
    return rounded(drift.embedding_drift(e, e.select("embedding")), "js_divergence")


@query
def vector_stats(spark, d):
    e = views.embeddings(spark, d)
    packed = e.withColumn("bits", V.pack_bits("embedding", DIM)).withColumn(
        "unit", V.l2_normalize(F.transform("embedding", lambda x: x * 3))
    )
    zero = F.array(F.lit(0).cast("bigint"))
    return packed.select(
        "vec_id",
        V.hamming(F.col("bits"), zero, 1).cast("bigint").alias("set_bits"),
        F.col("bits")[0].alias("word"),
        F.round(V.norm(F.col("unit")), 5).alias("unit_norm"),
        F.round(V.dot(F.col("embedding"), F.col("embedding")), 5).alias("self_dot"),
    )


@query
def half_precision(spark, d):
    halves = views.embeddings(spark, d).select("vec_id", V.to_half("embedding").alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return halves.select(
        "vec_id", F.round(total, 6).alias("half_sum"), F.get("h", F.lit(3)).cast("double").alias("fourth")
    )


@query
def vector_text_roundtrip(spark, d):
    written = views.embeddings(spark, d).select("vec_id", V.vector_text(F.col("embedding")).alias("text"))
    back = V.parse_vector(F.col("text"))
    return written.select(
        "vec_id", "text", F.size(back).cast("bigint").alias("dims"),
        F.round(F.get(back, F.lit(5)).cast("double"), 6).alias("sixth"),
    )


# --- catalogue -----------------------------------------------------------------------------


@query
def keyword_search(spark, d):
    return doubles(catalog.keyword_search(views.products(spark, d), "The blue BOLT", stemming=False, limit=50))


@query
def keyword_search_stemmed(spark, d):
    found = catalog.keyword_search(
        views.products(spark, d), "these Plates", max_price=1800.0, min_rating=2.0, limit=50
    )
    return doubles(found)


@query
def keyword_search_stored(spark, d):
    """Stored search terms: two terms, one with a filter, and a query of stop words only."""
    store = buckets.BucketStore(spark, scratch_path(spark, "titles"), buckets=8)
    p = views.products(spark, d).select("parent_asin", F.concat("title", F.lit("s")).alias("title"), "store", "main_category", "price", "average_rating")
    schema = "parent_asin string, title string, store string, main_category string, price decimal(10,2), average_rating decimal(3,1), title_terms array<string>"
    store.merge("products", schema, p.withColumn("title_terms", T.title_terms("title")), tables.upsert)
    stored = store.read("products", schema)
    asked = {"two": ("The Cold plate", None), "one": ("anvil", 1500.0), "none": ("the and of", None)}
    found = [
        catalog.keyword_search(stored, text, max_price=price, limit=100).withColumn("asked", F.lit(name))
        for name, (text, price) in asked.items()
    ]
    return doubles(found[0].union(found[1]).union(found[2]))


@query
def list_products(spark, d):
    return doubles(
        catalog.list_products(
            views.products(spark, d), main_category="sma", store="brand#1", min_price=905.0,
            max_price=2500.0, min_rating=1.5, limit=50, offset=5,
        )
    )


def _flat_reviews(products: DataFrame) -> DataFrame:
    fields = ["review_id", "rating", "helpful_vote", "verified_purchase", "reviewed_at", "sentiment_label"]
    return products.select(
        "parent_asin", "title", F.posexplode_outer("reviews").alias("place", "r")
    ).select(
        "parent_asin", "title", F.col("place").cast("bigint").alias("place"),
        *[F.col(f"r.{f}").alias(f) for f in fields],
    )


@query
def product_detail(spark, d):
    p, r = views.products(spark, d), views.reviews(spark, d, user=True, text=True)
    found = catalog.product_detail(p, r, "P7", review_limit=5)
    texts = F.transform("reviews", lambda x: F.coalesce(F.length(x["review_text"]), F.lit(0)))
    chars = F.aggregate(texts, F.lit(0), lambda acc, x: acc + x).cast("bigint")
    return _flat_reviews(found).join(found.select("parent_asin", chars.alias("text_chars")), "parent_asin")


@query
def products_with_reviews(spark, d):
    p = views.products(spark, d, ratings=False)
    r = views.reviews(spark, d).withColumn("user_id", F.lit(0)).withColumn("review_text", F.lit(""))
    return _flat_reviews(catalog.with_top_reviews(p, r, 3))


@query
def list_reviews(spark, d):
    r = views.reviews(spark, d, user=True).withColumn("review_text", F.lit(None).cast("string"))
    found = catalog.list_reviews(
        r, "P7", verified_only=True, min_rating=2.0, sentiment="positive", limit=50, offset=1
    )
    return doubles(found).drop("title", "review_text")


@query
def catalog_counts(spark, d):
    return doubles(
        catalog.catalog_counts(views.products(spark, d), views.reviews(spark, d), views.embeddings(spark, d))
    )


@query
def rating_distribution(spark, d):
    return doubles(catalog.rating_distribution(views.reviews(spark, d)))


@query
def price_summary(spark, d):
    return doubles(catalog.price_summary(views.products(spark, d, ratings=False)))


@query
def metrics_summary(spark, d):
    row = catalog.metrics_summary(
        views.products(spark, d), views.reviews(spark, d), views.embeddings(spark, d)
    )
    flat = row.select(
        "total_products", "total_reviews", "total_embeddings", "avg_rating",
        "price_summary.median_price", F.explode("rating_distribution").alias("s"),
    )
    return doubles(flat.select("*", "s.rating", "s.review_count", "s.avg_sentiment").drop("s"))


@query
def exact_price_quantiles(spark, d):
    items = views.table(spark, d, "lineitem").select("l_extendedprice")
    found = ranking.exact_quantiles(items, "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return rounded(found, "p25", "p50", "p99", digits=4)


@query
def review_navigation(spark, d):
    """Products with their embedding (1:1) and the size of their review list (1:N)."""
    p = views.products(spark, d, ratings=False).select("parent_asin")
    e = views.embeddings(spark, d).select("parent_asin", "category")
    n = views.reviews(spark, d).groupBy("parent_asin").agg(F.count("*").alias("reviews"))
    return p.join(e, "parent_asin", "left").join(n, "parent_asin", "left").select(
        "parent_asin", "category", F.coalesce("reviews", F.lit(0)).alias("reviews")
    )


# --- review context ------------------------------------------------------------------------


def _hits(spark, d) -> DataFrame:
    e = views.embeddings(spark, d)
    asked = e.filter(F.col("vec_id") == QUERY_VECTOR).select("embedding")
    return semantic_search(e, views.products(spark, d, ratings=False).withColumn(
        "average_rating", F.lit(None).cast("double")), asked, dim=DIM)


def _context(spark, d) -> DataFrame:
    return context.review_context(_hits(spark, d), views.reviews(spark, d, text=True))


@query
def review_context(spark, d):
    return _context(spark, d)


@query
def prompt_text(spark, d):
    made = context.with_prompt(context.collected(_context(spark, d)))
    return made.select("prompt", "input_tokens", F.size("texts").cast("bigint").alias("n_texts"))


@query
def review_context_batch(spark, d):
    e = views.embeddings(spark, d)
    found = batch.semantic_search_batch(e, _centers(spark, d), dim=DIM)
    made = context.with_prompt(context.review_context_batch(found, views.reviews(spark, d, text=True)))
    return made.select(
        "query_id", F.size("texts").cast("bigint").alias("n_texts"), "input_tokens",
        F.md5("prompt").alias("prompt_md5"),
    )


@query
def token_usage(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        T.input_tokens(F.array("text")).alias("input_tokens"),
        T.output_tokens(F.col("text")).cast("bigint").alias("output_tokens"),
    )


@query
def summary_after_marker(spark, d):
    """Generator output cut after its last marker, on marked document texts."""
    docs = views.table(spark, d, "documents")
    made = F.concat(F.lit("Reviews: Summary: x"), "text", F.lit(" Summary:  "), "text", F.lit(" "))
    return docs.select(
        "doc_id",
        F.md5(T.summary_of(made)).alias("summary_md5"),
        F.md5(T.summary_of(F.col("text"))).alias("unmarked_md5"),
    )


# --- cleaning and parsing ------------------------------------------------------------------


@query
def clean_pages(spark, d):
    return views.dealt(spark, d, "pages").select("page_id", T.clean_text("html").alias("text"))


@query
def product_text(spark, d):
    p = views.products(spark, d, ratings=False)
    blank = F.when(F.col("main_category") == "PROMO", F.lit(None).cast("string")).otherwise(F.col("title"))
    no_features = F.when(F.col("main_category").isin("PROMO", "LARGE"), F.array().cast("array<string>")).otherwise(
        F.col("features")
    )
    return p.select("parent_asin", T.product_text(blank, no_features, F.col("parent_asin"), 16).alias("text"))


def raw_price() -> Column:
    amount = F.col("l_extendedprice").cast("decimal(12,2)")
    text = amount.cast("string")
    grouped = F.concat(
        F.floor(amount / 1000).cast("string"), F.lit(","),
        F.lpad((amount % 1000).cast("decimal(12,2)").cast("string"), 6, "0"),
    )
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, F.concat(F.lit("$"), grouped))
        .when(n == 2, F.concat(F.lit("from $"), text))
        .when(n == 3, F.concat(F.lit("$"), text, F.lit(" - $99999")))
        .when(n == 4, F.lit("free"))
        .when(n == 5, F.lit(""))
        .when(n == 6, F.lit("None"))
        .otherwise(F.concat(F.lit("-"), text))
    )


def item_id() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


@query
def parse_price(spark, d):
    items = views.dealt(spark, d, "lineitem")
    return items.select(
        item_id().alias("item"), raw_price().alias("raw"),
        parse.parse_price(raw_price()).cast("double").alias("price"),
    )


def raw_time() -> Column:
    ts = F.col("l_shipdate").cast("timestamp")
    n = F.col("l_linenumber")
    return (
        F.when(n <= 2, F.unix_millis(ts).cast("string"))
        .when(n == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(n == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(n == 5, F.date_format(ts, "yyyy-MM-dd"))
        .when(n == 6, F.lit("yesterday"))
    )


@query
def parse_time(spark, d):
    items = views.dealt(spark, d, "lineitem")
    return items.select(
        item_id().alias("item"),
        parse.parse_time(raw_time()).alias("reviewed_at"),
        parse.epoch_ms(raw_time()).alias("timestamp_raw"),
    )


# --- ingest --------------------------------------------------------------------------------


def product_lines(spark, d) -> DataFrame:
    """Raw product metadata as JSON lines made from the part table."""
    p = views.table(spark, d, "part")
    key = F.when(F.col("p_type") != "PROMO", views.asin(F.col("p_partkey"))).otherwise(F.lit(""))
    doc = F.struct(
        key.alias("parent_asin"),
        F.concat(F.lit("<b>"), "p_name", F.lit("</b> &amp;&nbsp; more")).alias("title"),
        F.col("p_brand").alias("store"),
        F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".50")).alias("price"),
        (F.col("p_size") / 10).cast("decimal(3,1)").alias("average_rating"),
        F.array(F.concat(F.lit(" <i>"), "p_type"), F.lit("<br>"), F.lit("&lt;b&gt;")).alias("features"),
    )
    return p.select(F.col("p_partkey").alias("line_no"), F.to_json(doc).alias("line"))


@query
def ingest_products(spark, d):
    raw = jsonl.readable(jsonl.parse_lines(product_lines(spark, d), schemas.RAW_PRODUCT_FIELDS))
    rows = ingest.product_rows(ingest.clean_products(raw))
    return doubles(
        rows.select(
            "line_no", "parent_asin", "title", "store", "average_rating", "price_raw", "price",
            F.array_join("features", "|").alias("features"),
            F.size("categories").cast("bigint").alias("n_categories"),
        )
    )


@query
def skipped_products(spark, d):
    raw = jsonl.parse_lines(product_lines(spark, d), schemas.RAW_PRODUCT_FIELDS)
    return ingest.skipped_counts(raw, ingest.has_product_key())


@query
def jsonl_scan(spark, d):
    """Good lines from part, broken and blank ones from documents."""
    docs = views.table(spark, d, "documents").select(
        F.col("doc_id").alias("line_no"), F.explode(F.array(F.col("text"), F.lit("  "))).alias("line")
    )
    rows = jsonl.parse_lines(product_lines(spark, d).unionByName(docs), schemas.RAW_PRODUCT_FIELDS)
    bad = F.col(jsonl.BAD).isNotNull()
    return rows.agg(
        F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"),
        F.sum(F.length(jsonl.BAD)).alias("bad_chars"),
    )


@query
def ingest_reviews(spark, d):
    """Raw review lines made from line items, parsed, cleaned, typed and checked."""
    lines = _review_lines(views.dealt(spark, d, "lineitem"))
    raw = jsonl.readable(jsonl.parse_lines(lines, schemas.RAW_REVIEW_FIELDS))
    rows = ingest.review_rows(ingest.clean_reviews(raw))
    return doubles(rows.select(
        "item", "parent_asin", "user_id", "rating", "review_text", "helpful_vote", "verified_purchase",
        "timestamp_raw", "reviewed_at", ingest.valid_rating().alias("valid"),
    ))


def _review_lines(items: DataFrame) -> DataFrame:
    doc = F.struct(
        views.asin(F.col("l_partkey")).alias("parent_asin"),
        F.when(F.col("l_linenumber") != 6, F.concat(F.lit("U"), F.col("l_suppkey").cast("string"))).alias("user_id"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity") % 7).alias("rating"),
        F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("helpful_vote"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R").alias("verified_purchase"),
        F.concat(F.lit("good\t<p>"), "l_returnflag", F.lit("&quot; ")).alias("text"),
        raw_time().alias("timestamp"),
    )
    return items.select(item_id().alias("item"), F.to_json(doc).alias("line"))


@query
def valid_reviews(spark, d):
    """Reviews per whole star, split by the 1 to 5 rule."""
    items = views.table(spark, d, "lineitem").select((F.col("l_quantity") % 7).alias("rating"))
    ok = ingest.valid_rating()
    return items.groupBy("rating", ok.alias("valid")).agg(F.count("*").alias("n"))


@query
def load_semi_join(spark, d):
    """Reviews of products that have an embedding."""
    kept = tables.known_keys(views.reviews(spark, d), views.embeddings(spark, d))
    return kept.select("review_id", "parent_asin", "rating")


def _product_batch(spark, d) -> DataFrame:
    return product_batch_of(views.table(spark, d, "lineitem"))


def product_batch_of(items: DataFrame) -> DataFrame:
    """A load batch in which most keys repeat and some are new to the catalogue."""
    return items.select(
        views.asin(F.col("l_partkey") + F.col("l_suppkey")).alias("parent_asin"),
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("title"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("store"),
        F.col("l_returnflag").alias("main_category"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_orderkey").alias("_a"), F.col("l_linenumber").alias("_b"), item_id().alias("_c"),
    )


@query
def upsert_products(spark, d):
    old = views.products(spark, d, ratings=False).select(
        "parent_asin", "title", "store", "main_category", F.col("price").cast("double").alias("price")
    )
    return tables.upsert_products(old, _product_batch(spark, d), ["_a", "_b", "_c"])


def _vector_batch(spark, d, run: str, factor: float) -> DataFrame:
    return views.embeddings(spark, d).select(
        "parent_asin", F.transform("embedding", lambda x: (x * factor).cast("float")).alias("embedding"),
        F.lit(None).cast("array<float>").alias("embedding_half"), V.pack_bits("embedding", DIM).alias("bits"),
        F.lit("m").alias("model_name"), F.lit(run).alias("run_id"),
    )


@query
def upsert_embeddings(spark, d):
    """All vectors, then a second run over those of reviewed products and of products not seen before."""
    store = buckets.BucketStore(spark, scratch_path(spark, "store"), buckets=16)
    first, again = _vector_batch(spark, d, "r1", 1.0), _vector_batch(spark, d, "r2", 2.0)
    store.merge("embeddings", schemas.EMBEDDINGS, first, tables.upsert_embeddings, "r1")
    fresh = views.embeddings(spark, d).filter("category = 3").select(F.concat(F.lit("N"), "parent_asin").alias("parent_asin"), F.col("parent_asin").alias("_of"))
    unseen = again.withColumnRenamed("parent_asin", "_of").join(fresh, "_of").drop("_of")
    second = tables.known_keys(again, views.reviews(spark, d)).unionByName(unseen)
    for _ in range(2):  # the same run twice is one run
        store.merge("embeddings", schemas.EMBEDDINGS, second, tables.upsert_embeddings, "r2")
    store.vacuum("embeddings", keep=1)
    return store.read("embeddings", schemas.EMBEDDINGS).select(
        "parent_asin", "run_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"),
        F.bit_count(F.col("bits")[0]).cast("bigint").alias("set_bits"),
    )


@query
def insert_if_absent(spark, d):
    old = views.products(spark, d, ratings=False).select(
        "parent_asin", "title", "store", "main_category", F.col("price").cast("double").alias("price")
    )
    return tables.insert_if_absent(old, _product_batch(spark, d), sequence=["_a", "_b", "_c"])


@query
def cascade_delete(spark, d):
    """Products of one type go, and their reviews with them."""
    p = views.products(spark, d, ratings=False)
    gone = p.filter(F.col("main_category") == "PROMO")
    left_p, left_r = tables.delete_cascade(gone, p, views.reviews(spark, d))
    n = left_r.groupBy("parent_asin").agg(F.count("*").alias("reviews"))
    return left_p.select("parent_asin").join(n, "parent_asin", "left")


@query
def missing_products(spark, d):
    """Products without an embedding (expected minus found)."""
    return tables.missing_keys(views.products(spark, d, ratings=False), views.embeddings(spark, d), "parent_asin")


@query
def surrogate_keys(spark, d):
    existing = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"))
    numbered = tables.with_new_ids(views.reviews(spark, d).drop("review_id"), existing, "review_id")
    top = existing.agg(F.max("review_id")).scalar()
    return numbered.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.count_distinct("review_id")).alias("repeats"),
        F.count_if(F.col("review_id") <= top).alias("clashes"),
    )


@query
def table_versions(spark, d):
    """Two versions of a stored table; readers see the second."""
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    schema = "parent_asin string, title string, store string, main_category string, price double"
    old = views.products(spark, d, ratings=False).select(
        "parent_asin", "title", "store", "main_category", F.col("price").cast("double").alias("price")
    )
    store.replace("products", tables.upsert_products(store.read("products", schema), old), ["parent_asin"])
    merged = tables.upsert_products(store.read("products", schema), _product_batch(spark, d), ["_a", "_b", "_c"])
    store.replace("products", merged, ["parent_asin"])
    return store.read("products", schema)


@query
def ingest_pipeline(spark, d):
    """The whole ingest from JSON files, run twice under one batch name: three tables, the run's row and the counts."""
    files = scratch_path(spark, "incoming")
    for name, lines in (("meta", product_lines(spark, d)), ("reviews", _review_lines(views.table(spark, d, "lineitem")))):
        lines.select("line").write.text(f"{files}/{name}.jsonl")
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        counts = ingest.ingest(
            spark, store, f"{files}/meta.jsonl", f"{files}/reviews.jsonl", "w1", ingest.default_encoder(64),
            score=lambda r: r.withColumn("sentiment_label", F.upper(F.lit("Positive"))).withColumn(
                "sentiment_score", F.col("rating") / 7
            ),
            run_id="run-1",
        )
    text = lambda *columns: F.concat_ws("|", *columns).alias("value")
    products = store.read("products", schemas.PRODUCTS)
    vectors = store.read("embeddings", schemas.EMBEDDINGS)
    reviews = store.read_appended("reviews", schemas.REVIEWS)
    told = reviews.groupBy("parent_asin").agg(
        F.count("*").alias("n"), F.sum("helpful_vote").alias("votes"), F.sum("sentiment_score").alias("score"),
        F.count_distinct("review_id").alias("ids"), F.count_if(F.col("sentiment_label") == "positive").alias("positive"),
    )
    run = store.read_appended("runs", schemas.RUNS)
    parts = [
        products.select(F.lit("product").alias("kind"), F.col("parent_asin").alias("key"), text("title", "store", "price_raw", "price", F.array_join(F.array_sort("title_terms"), " "))),
        vectors.select(F.lit("embedding"), "parent_asin", text(F.size("embedding").cast("string"), F.size("bits").cast("string"), "run_id")),
        told.select(F.lit("reviews"), "parent_asin", text(*[F.col(c).cast("string") for c in ("n", "ids", "votes", "positive", "score")])),
        run.select(F.lit("run"), "run_id", text(F.col("metrics")["total_embed"].cast("long").cast("string"), F.col("metrics")["embedding_dim"].cast("long").cast("string"))),
        counts.select(F.lit("counts"), F.lit("w1"), text(*[F.col(c).cast("string") for c in counts.columns])),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


# --- models --------------------------------------------------------------------------------


@query
def embed_text(spark, d):
    p = views.products(spark, d, ratings=False)
    encoder = ingest.default_encoder(128)
    return ingest.embed_products(p, encoder, "run-1").select(
        "parent_asin", "embedding", "bits", "model_name", "run_id"
    )


@query
def sentiment(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    labels = views.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    model = models.train_sentiment(docs.join(labels, "doc_id"))
    return models.score_sentiment(docs, model).select("doc_id", "sentiment_label", "sentiment_score")


@query
def sentiment_facts(spark, d):
    """What must hold of the classifier's output, and that it tells the labelled texts apart."""
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    labels = views.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = models.score_sentiment(docs, models.train_sentiment(docs.join(labels, "doc_id")))
    score, named = F.col("sentiment_score"), F.col("sentiment_label")
    right = (named == "positive").cast("int") == F.col("label")
    told = scored.join(labels, "doc_id").agg((F.avg(right.cast("int")) >= 0.9).alias("r")).scalar()
    return scored.select(
        "doc_id", named.isin("positive", "negative").alias("known_label"),
        (score.between(0.5, 1.0) & (score == F.round(score, 4))).alias("sound_score"), told.alias("tells_apart"),
    )


@query
def text_search(spark, d):
    """Every benchmark passage searched for among all documents, from text to ranked hits."""
    docs = views.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("parent_asin"), "text"
    )
    asked = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    corpus = models.hashing_encoder(docs, "text", 256).select(
        "parent_asin", "embedding", V.pack_bits("embedding", 256).alias("bits")
    )
    vectors = models.hashing_encoder(asked, "text", 256).select("query_id", F.col("embedding").alias("vector"))
    return rounded(batch.semantic_search_batch(corpus, vectors, dim=256, top_k=3), "_distance")


# --- telemetry -----------------------------------------------------------------------------


def _timed(spark, d) -> DataFrame:
    """Latencies in whole tenths of a millisecond, so that means are exact in any engine."""
    e = views.table(spark, d, "events")
    tenths = F.round(F.col("value") * 100).cast("bigint").alias("tenths")
    return e.select(F.col("event_type").alias("search_type"), "ts", "event_id", tenths)


@query
def rolling_latency(spark, d):
    found = rolling.rolling_stats(_timed(spark, d), ["search_type"], ["ts", "event_id"], "tenths")
    return found.drop("ts", "tenths")


@query
def latency_summary(spark, d):
    return rolling.latency_summary(_timed(spark, d), ["search_type"], ["ts", "event_id"], "tenths")


@query
def latency_histogram(spark, d):
    hist = metrics.histogram(views.search_events(spark, d), ["search_type"], "seconds", LATENCY_BOUNDS)
    return rounded(metrics.histogram_rows(hist, ["search_type"], LATENCY_BOUNDS), "sum", digits=4)


@query
def histogram_quantiles(spark, d):
    hist = metrics.histogram(views.search_events(spark, d), ["search_type"], "seconds", LATENCY_BOUNDS)
    wanted = {"p10": 0.10, "p50": 0.50, "p95": 0.95, "p99": 0.99}
    return rounded(metrics.histogram_quantiles(hist, ["search_type"], LATENCY_BOUNDS, wanted), *wanted, digits=9)


@query
def request_rate(spark, d):
    return rounded(
        metrics.windowed_rate(views.search_events(spark, d), ["search_type"], "1 hour", "15 minutes"),
        "per_second", digits=9,
    )


@query
def tokens_last_hour(spark, d):
    o = series.evaluate(
        views.observations(spark, d),
        [dashboards._tokens("input", "tokens_in_last_hour", 3600, 3600.0, ())],
    )
    return rounded(o, "value", digits=9)


@query
def error_share(spark, d):
    e = views.search_events(spark, d)
    return e.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(
        F.round(metrics.share(F.col("status") >= 500), 6).alias("error_share"),
        F.round(1 - metrics.share(F.col("status") >= 500), 6).alias("success_share"),
    )


@query
def counter_increase(spark, d):
    """Payload values read as samples of a counter that restarts."""
    e = views.search_events(spark, d).withColumn("tokens", F.col("tokens").cast("double"))
    return metrics.counter_increase(e, ["search_type"], ["ts", "event_id"], "tokens", "6 hours")


@query
def alerts_fired(spark, d):
    return rounded(alerts.alerts_fired(views.observations(spark, d)), "value", digits=9)


@query
def no_traffic(spark, d):
    o = views.observations(spark, d)
    asked = o.agg(F.max(F.unix_seconds("ts")) + 7200).scalar()  # two hours after the last request
    runs = alerts.silent_runs(o, alerts.HTTP_SILENCE, asked)
    return runs.select("started", "ended")


@query
def dashboard_panels(spark, d):
    return rounded(dashboards.panel_series(views.observations(spark, d)), "value", digits=9)


@query
def cumulative_tokens(spark, d):
    return dashboards.cumulative_tokens(views.observations(spark, d))


@query
def gauge_bands(spark, d):
    o = views.observations(spark, d)
    recall = dashboards.current_gauges(o, "hnsw_recall_rate", ["k"]).withColumn("gauge", F.lit("recall"))
    moved = dashboards.current_gauges(o, "embedding_drift_score", ["category"]).withColumn("gauge", F.lit("drift"))
    colour = F.when(F.col("gauge") == "recall", dashboards.band(F.col("value"), "recall")).otherwise(
        dashboards.band(F.col("value"), "drift")
    )
    return rounded(recall.unionByName(moved).withColumn("colour", colour), "value")


# --- run records ---------------------------------------------------------------------------


@query
def search_runs(spark, d):
    e = views.search_events(spark, d)
    ms = F.col("seconds") * 1000
    asked = e.select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"),
        F.col("search_type").alias("query"), F.lit(5).alias("top_k"), (F.col("tokens") % 6).alias("results"),
        (ms * 0.1).alias("embedding_ms"), (ms * 0.25).alias("stage1_ms"), (ms * 0.5).alias("stage2_ms"),
        F.when(F.col("tokens") > 50, ms).alias("generation_ms"),
    )
    runs = tracking.search_runs(asked)
    return runs.select(
        "run_id", F.col("params")["query_length_chars"].alias("query_chars"),
        F.round(F.col("metrics")["total_latency_ms"], 4).alias("total_ms"),
        F.col("metrics")["results_returned"].alias("results"),
        F.size("params").cast("bigint").alias("n_params"),
    )


@query
def embedding_run_metrics(spark, d):
    timed = views.search_events(spark, d).select(
        F.col("search_type").alias("run_id"), F.col("tokens").alias("items"),
        F.col("seconds").alias("elapsed_s"), F.lit(384).alias("dim"),
    )
    return rounded(tracking.embedding_run_metrics(timed), "total_embeddings_time_ms", digits=1)


@query
def prompt_variants(spark, d):
    c = views.table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.lit(None).cast("timestamp").alias("started_at"),
        F.col("role").alias("variant_name"), F.col("text").alias("prompt_template"),
        F.length("text").alias("input_token_count"), F.col("turn").alias("output_token_count"),
        F.when(F.col("turn") > 0, F.col("turn") / 10.0).alias("faithfulness"),
        F.lit(None).cast("double").alias("answer_relevance"),
    )
    found = tracking.compare_variants(tracking.prompt_variant_runs(c))
    return rounded(found, "input_tokens", "output_tokens", "faithfulness")


# --- streams -------------------------------------------------------------------------------


def _event_stream(spark, d) -> DataFrame:
    schema = views.table(spark, d, "events").schema
    return windows.read_stream(spark, d, schema, glob="events.parquet")


def _streamed(spark, stream: DataFrame) -> DataFrame:
    path = scratch_path(spark, "stream")
    cores = spark.sparkContext.defaultParallelism
    windows.run_available(stream, path, scratch_path(spark, "offsets"), partitions=cores)
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_request_rate(spark, d):
    events = _event_stream(spark, d).withColumnRenamed("event_type", "search_type")
    made = windows.rates(events, ["search_type"], "1 hour", "15 minutes")
    return rounded(_streamed(spark, made), "per_second", digits=9)


@query
def stream_histogram(spark, d):
    events = _event_stream(spark, d).withColumn("seconds", F.col("value") / 100)
    made = windows.histograms(events, ["event_type"], "seconds", LATENCY_BOUNDS, "1 day")
    found = metrics.histogram_rows(_streamed(spark, made), ["window_start", "event_type"], LATENCY_BOUNDS)
    return rounded(found, "sum", digits=4)


STREAM_RULES = [r for r in alerts.RULES if (r.series.lookback, r.series.interval) == (300, 30)]


@query
def stream_alerts(spark, d):
    stream_alerts_mod.use_rocksdb(spark)
    seen = views.observations_of(_event_stream(spark, d))
    return rounded(_streamed(spark, stream_alerts_mod.alert_stream(seen, STREAM_RULES)), "value", digits=9)


@query
def stream_no_traffic(spark, d):
    stream_alerts_mod.use_rocksdb(spark)
    rule = next(r for r in alerts.RULES if r.series.kind == "silence")
    seen = views.observations_of(_event_stream(spark, d))
    return _streamed(spark, stream_alerts_mod.silence_stream(seen, rule)).drop("labels")


@query
def stream_alerts_all(spark, d):
    """All 17 rules on one stream: a row when a rule fires, and one when its condition has ended."""
    stream_alerts_mod.use_rocksdb(spark)
    seen = views.observations_of(_event_stream(spark, d))
    return rounded(_streamed(spark, walk.alert_changes(seen, alerts.RULES)), "value", digits=9)


@query
def stream_upsert(spark, d):
    """The load batch as a file stream merged into a stored catalogue, and handed out once more."""
    store = buckets.BucketStore(spark, scratch_path(spark, "store"), buckets=16)
    schema = "parent_asin string, title string, store string, main_category string, price double"
    old = views.products(spark, d, ratings=False).select(
        "parent_asin", "title", "store", "main_category", F.col("price").cast("double").alias("price")
    )
    store.merge("products", schema, old, tables.upsert_products)
    items = views.table(spark, d, "lineitem").schema
    for _ in range(2):  # a lost checkpoint: the stream starts again from its first file
        lines = windows.read_stream(spark, d, items, glob="lineitem.parquet")
        stream_ingest.upsert_stream(
            product_batch_of(lines), store, "products", schema,
            lambda held, fresh: tables.upsert_products(held, fresh, ["_a", "_b", "_c"]),
            scratch_path(spark, "offsets"),
        )
    return store.read("products", schema).drop("bucket")


def _streamed_reviews(spark, d) -> tables.TableStore:
    """Review lines, every fourth item's broken, as a stream; its only batch is handed out twice."""
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    items = views.table(spark, d, "lineitem").schema
    known = views.products(spark, d, ratings=False).filter("main_category <> 'PROMO'")
    for _ in range(2):
        lines = windows.read_stream(spark, d, items, glob="lineitem.parquet")
        made = _review_lines(lines).withColumn(
            "line", F.when(F.split("item", "-")[1] == "4", F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
        )
        raw = jsonl.parse_lines(made.drop("item"), schemas.RAW_REVIEW_FIELDS)
        stream_ingest.append_reviews(raw, lambda: known, store, scratch_path(spark, "offsets"))
    return store


@query
def stream_append_reviews(spark, d):
    kept = _streamed_reviews(spark, d).read_appended("reviews", stream_ingest.STREAMED_REVIEWS)
    found = kept.select(
        "parent_asin", "user_id", "rating", "review_text", "helpful_vote", "verified_purchase", "timestamp_raw", "reviewed_at"
    )
    return doubles(found.groupBy(*found.columns).agg(F.count("*").alias("n")))


@query
def stream_review_counts(spark, d):
    """What became of the lines of each batch, and whether the ids of the kept ones are distinct."""
    store = _streamed_reviews(spark, d)
    reviews = store.read_appended("reviews", stream_ingest.STREAMED_REVIEWS)
    ids = reviews.agg((F.count("*") == F.count_distinct("review_id")).alias("distinct_ids")).scalar()
    return store.read_appended("reviews_counts", stream_ingest.COUNTS).withColumn("distinct_ids", ids)
