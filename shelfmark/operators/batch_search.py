"""Many queries at once: blocks of queries against unshuffled corpus parts, partial top-k merged in two levels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfmark import settings
from shelfmark.functions import vectors as V
from shelfmark.operators.ranking import ROW_BITS, top_rows
from shelfmark.operators.search import product_filters, project_fields
from shelfmark.session import materialize, scratch_path

BLOCK_QUERIES = 4096  # queries sent to every task at a time; 384-dim bits of these take 200 kB
QUERY_BLOCK = 256  # queries compared with a batch of rows at a time


def _best(keys: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest scores, ties by key: never more than the true n survive."""
    if len(scores) > n:
        edge = np.partition(scores, n - 1)[n - 1]
        kept = np.flatnonzero(scores <= edge)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((keys[kept].astype(str), scores[kept]))][:n]


class _TopK:
    """Running per-query best rows of one task; memory is queries x n whatever the input."""

    def __init__(self, query_ids: np.ndarray, query_rows: np.ndarray, n: int, score):
        self.ids, self.rows, self.n, self.score = query_ids, query_rows, n, score
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(query_ids)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(self.ids), QUERY_BLOCK):
            block = self.score(self.rows[start : start + QUERY_BLOCK], rows)
            for i, scores in enumerate(block, start):
                held = self.best[i]
                k, s = keys, scores
                if held is not None:
                    k, s = np.concatenate([held[0], keys]), np.concatenate([held[1], scores])
                pick = _best(k, s, self.n)
                self.best[i] = (k[pick], s[pick])

    def frames(self) -> Iterator[pd.DataFrame]:
        """What was found, or no frame at all: pandas makes a column of numbers from an empty list, which
        Arrow doesn't take for text."""
        filled = [(q, *b) for q, b in zip(self.ids, self.best) if b is not None]
        if filled:
            yield pd.DataFrame(
                {
                    "query_id": np.repeat([q for q, _, _ in filled], [len(k) for _, k, _ in filled]),
                    "parent_asin": np.concatenate([k for _, k, _ in filled]),
                    "_score": np.concatenate([s for _, _, s in filled]),
                }
            )


def _hamming_block(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros((len(queries), len(rows)), dtype=np.float64)
    for w in range(queries.shape[1]):
        total += np.bitwise_count(queries[:, w, None] ^ rows[None, :, w])
    return total


def _cosine_block(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(1.0 - (queries @ rows.T) / lengths, nan=np.inf)


MEASURES = {"hamming": (np.uint64, _hamming_block), "cosine": (np.float64, _cosine_block)}


def _matrix(column: pd.Series, dtype) -> np.ndarray:
    if dtype is np.uint64:
        return np.stack([np.asarray(x, np.int64).view(np.uint64) for x in column])
    return np.stack([np.asarray(x, dtype) for x in column])


def _numbered_blocks(queries: DataFrame, block_queries: int) -> tuple[DataFrame, int]:
    """``queries`` stored with a partition column ``_block``, and the number of blocks: as few as hold
    ``block_queries`` rows each, however the rows are spread over partitions.

    The rows are checkpointed first, so their places stay: the rows of the partitions before and the place inside.
    The folders are named ``block``, as names that begin with an underscore are hidden ones to many readers.
    """
    spark = queries.sparkSession
    position = F.monotonically_increasing_id()
    rows = materialize(queries.withColumn("_at", position)).withColumn("_part", F.shiftright("_at", ROW_BITS))
    total = rows.count()
    # A row per partition, a number each.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = rows.join(F.broadcast(starts), "_part").withColumn("block", F.floor(place / F.lit(block_queries)).cast("int"))
    path = scratch_path(spark, "queries")
    numbered.select(*queries.columns, "block").write.partitionBy("block").parquet(path)
    schema = T.StructType([*queries.schema.fields, T.StructField("block", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).withColumnRenamed("block", "_block"), -(-total // block_queries)


def nearest_per_query(
    corpus: DataFrame, queries: DataFrame, n: int, measure: str, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """Exact ``n`` nearest corpus rows of every query: (query_id, parent_asin, _score).

    ``corpus`` is (parent_asin, point), ``queries`` is (query_id, point); a point holds sign
    words for ``hamming`` and components for ``cosine``. Any number of queries works the same way:
    they are cut into blocks, and each block is sent to all tasks, which stream their part of
    the corpus past it and keep n rows per query. The corpus is read once a block and never
    shuffled, no pairs leave a task, and driver and tasks hold one block at a time. What the tasks found
    is merged in two levels, so the number of tasks doesn't land on one row group per query. Runs the jobs of all
    blocks at once, each writing its result.
    """
    dtype, score = MEASURES[measure]
    spark = queries.sparkSession
    id_type = queries.schema["query_id"].dataType
    schema = f"query_id {id_type.simpleString()}, parent_asin string, _score double"
    queries = queries.select("query_id", "point").filter(F.col("point").isNotNull())
    corpus = corpus.select("parent_asin", "point").filter(F.col("point").isNotNull())
    numbered, blocks = _numbered_blocks(queries, block_queries)
    if not blocks:
        return spark.createDataFrame([], schema)
    path = scratch_path(spark, "nearest")
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1)
    order = [F.col("_score").asc(), F.col("parent_asin").asc()]
    for block in range(blocks):
        asked = numbered.filter(F.col("_block") == block).select("query_id", "point").toPandas()  # one block
        ids = asked["query_id"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, _matrix(asked["point"], dtype)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            top = _TopK(*shared.value, n, score)
            for batch in batches:
                if len(batch):
                    top.add(batch["parent_asin"].to_numpy(), _matrix(batch["point"], dtype))
            yield from top.frames()

        # Few tasks, each with many splits, give few partial results.
        found = corpus.coalesce(tasks).mapInPandas(scan, schema)
        groups = max(int(tasks**0.5), 1)
        some = found.withColumn("_group", F.spark_partition_id() % groups)
        some = top_rows(some, ["query_id", "_group"], order, n).drop("_pos", "_group")
        best = top_rows(some, ["query_id"], order, n).drop("_pos")
        best.write.parquet(f"{path}/block={block}")
        shared.destroy()
    return spark.read.schema(f"{schema}, block int").parquet(path).drop("block")


def semantic_search_batch(
    embeddings: DataFrame,
    queries: DataFrame,
    products: DataFrame | None = None,
    *,
    dim: int = settings.EMBEDDING_DIM,
    top_k: int = settings.DEFAULT_TOP_K,
    oversample: int = settings.OVERSAMPLE,
    fields: Sequence[str] | None = None,
    max_price: float | None = None,
    min_rating: float | None = None,
    only_in_stock: bool = False,
    filter_mode: str = "post",
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Two-stage search for a table of queries (query_id, vector).

    Returns (query_id, parent_asin, _distance, _rank). With ``products`` it is the search of
    ``semantic_search`` for each query: the projected product columns in place of the key alone, and the
    filters after the ``top_k`` cut (``"post"``, ranks keep their gaps) or before the search
    (``"pre"``). Stage 2 joins only the candidates, at most ``top_k * oversample`` per query, to the
    vectors on their key.
    """
    settings.bounded("top_k", top_k, 1, settings.MAX_TOP_K)
    settings.bounded("oversample", oversample, 1, settings.MAX_OVERSAMPLE)
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode must be 'post' or 'pre'")
    keep = product_filters(max_price, min_rating, only_in_stock)
    columns = project_fields(fields)
    corpus = embeddings
    if products is not None and filter_mode == "pre":
        corpus = corpus.join(products.filter(keep).select("parent_asin"), "parent_asin", "left_semi")
    corpus = corpus.filter(F.col("embedding").isNotNull())
    # Read three times below; a query table is often the result of a job of its own.
    queries = materialize(queries.select("query_id", "vector").filter(F.col("vector").isNotNull()))
    bits = F.col("bits") if "bits" in embeddings.columns else V.pack_bits("embedding", dim)
    candidates = nearest_per_query(
        corpus.select("parent_asin", bits.alias("point")),
        queries.select("query_id", V.pack_bits("vector", dim).alias("point")),
        top_k * oversample,
        "hamming",
        block_queries,
    )
    scored = (
        candidates.select("query_id", "parent_asin")
        .join(embeddings.select("parent_asin", "embedding"), "parent_asin")
        .join(queries.select("query_id", "vector"), "query_id")
        .select(
            "query_id",
            "parent_asin",
            V.cosine_distance(F.col("embedding"), F.col("vector")).alias("_distance"),
        )
    )
    best = top_rows(scored, ["query_id"], [F.col("_distance").asc(), F.col("parent_asin").asc()], top_k)
    best = best.withColumnRenamed("_pos", "_rank")
    if products is None:
        return best
    return best.join(products.filter(keep), "parent_asin").select("query_id", *columns, "_distance", "_rank")


def exact_search_batch(
    embeddings: DataFrame, queries: DataFrame, *, top_k: int = settings.DEFAULT_TOP_K,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """True nearest neighbours by cosine distance: (query_id, parent_asin)."""
    settings.bounded("top_k", top_k, 1, settings.MAX_TOP_K)
    return nearest_per_query(
        embeddings.select("parent_asin", F.col("embedding").alias("point")),
        queries.select("query_id", F.col("vector").alias("point")),
        top_k,
        "cosine",
        block_queries,
    ).select("query_id", "parent_asin")


def recall_at_k(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the true neighbours that the search returned, per query."""
    hits = found.select("query_id", "parent_asin").withColumn("_hit", F.lit(1))
    return (
        exact.select("query_id", "parent_asin")
        .join(hits, ["query_id", "parent_asin"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
    )


def category_centers(embeddings: DataFrame, category: str = "category") -> DataFrame:
    """Mean vector per category: (query_id, vector). Combines before the shuffle."""
    return (
        embeddings.select(category, F.posexplode("embedding").alias("_dim", "_x"))
        .groupBy(category, "_dim")
        .agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
        .groupBy(F.col(category).alias("query_id"))
        .agg(F.array_sort(F.collect_list(F.struct("_dim", "_mean"))).alias("_means"))
        .select("query_id", F.transform("_means", lambda m: m["_mean"]).alias("vector"))
    )
