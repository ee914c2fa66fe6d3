"""Partitioned approximate search: vectors stored by nearest centroid, few lists read."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shelfmark import settings
from shelfmark.functions import vectors as V
from shelfmark.operators.batch_search import QUERY_BLOCK, _best, _cosine_block
from shelfmark.operators.ranking import top_rows
from shelfmark.session import materialize, scratch_path

MAX_LISTS = 4096  # centroids held by every task: 12 MB at 384 dimensions
ROWS_PER_PART = 250_000  # rows of a list that one file holds
BLOCK_PROBES = 4096  # pairs of a query and a list that a task compares at a time, as far as QUERY_BLOCK allows
CELL_PROBES = 8192  # pairs of a query and a list that one task gets
CELL_ROWS = 16_384  # rows of a list that one task gets; with QUERY_BLOCK probes, scores of 33 MB
MAX_CELL_TASKS = 4096


def fit_centroids(
    embeddings: DataFrame, lists: int = settings.IVF_LISTS, seed: int = 42, max_iter: int = 20
) -> DataFrame:
    """Cosine k-means over the vectors: (list_id, centroid)."""
    settings.bounded("lists", lists, 2, MAX_LISTS)
    # Rows without a direction have no cosine and shape no list.
    directed = F.exists(F.coalesce("embedding", F.array()), lambda x: x != 0)
    points = embeddings.filter(directed).select(array_to_vector(F.col("embedding")).alias("features"))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", maxIter=max_iter).fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return embeddings.sparkSession.createDataFrame(rows, "list_id int, centroid array<double>")


def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.select("list_id", "centroid").orderBy("list_id").limit(MAX_LISTS + 1).collect()
    if not 0 < len(rows) <= MAX_LISTS:
        raise ValueError(f"between 1 and {MAX_LISTS} centroids are supported")
    matrix = np.array([r["centroid"] for r in rows], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.array([r["list_id"] for r in rows]), matrix / np.where(lengths > 0, lengths, 1.0)


def assign_lists(embeddings: DataFrame, centroids: DataFrame) -> DataFrame:
    """Add ``list_id``, the centroid at the smallest cosine distance, lowest id on ties.

    One matrix product per Arrow batch; no vector meets a centroid as a joined row. A row without
    a vector gets no list.
    """
    ids, matrix = _centroid_matrix(centroids)

    @F.pandas_udf(T.IntegerType())
    def nearest(vectors: pd.Series) -> pd.Series:
        lists = pd.Series([None] * len(vectors), index=vectors.index, dtype="Int32")
        known = vectors[vectors.notna()]
        if len(known):
            points = np.stack([np.asarray(v, np.float64) for v in known])
            lists[known.index] = ids[np.argmax(points @ matrix.T, axis=1)]
        return lists

    return embeddings.withColumn("list_id", nearest("embedding"))


def write_lists(assigned: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> None:
    """Store the vectors by list and part. A list has as many parts as its size asks for, so a list that
    holds much of the data is written and read by many tasks; rows are sorted by key for row-group
    skipping. Rows without a list are left out."""
    kept = assigned.filter("list_id IS NOT NULL")
    # At most MAX_LISTS rows, a number each.
    sizes = kept.groupBy("list_id").agg(F.ceil(F.count("*") / F.lit(rows_per_part)).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("parent_asin"), F.col("_parts")).cast("int")
    (
        kept.join(F.broadcast(sizes), "list_id")
        .withColumn("part", part)
        .drop("_parts")
        .repartition("list_id", "part")
        .sortWithinPartitions("list_id", "part", "parent_asin")
        .write.mode("errorifexists")
        .partitionBy("list_id", "part")
        .parquet(path)
    )


def ivf_search(
    spark: SparkSession,
    path: str,
    centroids: DataFrame,
    query: Sequence[float],
    *,
    probes: int = settings.IVF_PROBES,
    top_k: int = settings.DEFAULT_TOP_K,
) -> DataFrame:
    """Exact cosine top-k inside the ``probes`` nearest lists; the others are never opened."""
    settings.bounded("top_k", top_k, 1, settings.MAX_TOP_K)
    ids, matrix = _centroid_matrix(centroids)
    nearest = np.argsort(-(matrix @ np.asarray(query, np.float64)), kind="stable")[:probes]
    asked = F.lit([float(x) for x in query])
    return (
        spark.read.parquet(path)
        .filter(F.col("list_id").isin([int(i) for i in ids[nearest]]))
        .select("parent_asin", V.cosine_distance(F.col("embedding"), asked).alias("_distance"), "list_id")
        .orderBy("_distance", "parent_asin")
        .limit(top_k)
    )


def probed_lists(queries: DataFrame, centroids: DataFrame, probes: int) -> DataFrame:
    """(query_id, vector, list_id): each query with its ``probes`` nearest lists, lower ids first on ties."""
    ids, matrix = _centroid_matrix(centroids)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        points = np.stack([np.asarray(v, np.float64) for v in vectors])
        order = np.argsort(-(points @ matrix.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(ids[order].astype(np.int32)))

    asked = queries.filter(F.col("vector").isNotNull())
    return asked.select("query_id", "vector", F.explode(nearest("vector")).alias("list_id"))


def _probe_blocks(counts: list[tuple[int, int]], block_probes: int) -> list[list[tuple[int, int, int]]]:
    """Blocks of (list, chunk, chunks of the list): lists with few probes together, one with many in chunks."""
    blocks, held = [], 0
    for list_id, n in counts:
        chunks = -(-n // block_probes)
        for chunk in range(chunks):
            size = -(-n // chunks)
            if not blocks or held + size > block_probes:
                blocks.append([])
                held = 0
            blocks[-1].append((list_id, chunk, chunks))
            held += size
    return blocks


def ivf_search_batch(
    spark: SparkSession,
    path: str,
    centroids: DataFrame,
    queries: DataFrame,
    *,
    probes: int = settings.IVF_PROBES,
    top_k: int = settings.DEFAULT_TOP_K,
    block_probes: int = BLOCK_PROBES,
) -> DataFrame:
    """``ivf_search`` for a table of queries (query_id, vector): (query_id, parent_asin, _distance, list_id, _rank).

    Probes meet the rows of their list in cells of about ``CELL_ROWS`` rows and ``CELL_PROBES`` probes, one job for all of
    them. Lists that nobody asks for are not read; a row is sent once for every ``CELL_PROBES`` probes of its list, and a
    cell compares ``block_probes`` of them at a time and gives ``top_k`` rows per probe.
    """
    settings.bounded("top_k", top_k, 1, settings.MAX_TOP_K)
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, parent_asin string, _score double, list_id int"
    asked = materialize(probed_lists(queries, centroids, probes))
    # At most MAX_LISTS rows, a number each.
    counts = [tuple(r) for r in asked.groupBy("list_id").agg(F.count("*").alias("n")).orderBy("list_id").collect()]
    if not counts:
        return spark.createDataFrame([], f"query_id {id_type}, parent_asin string, _distance double, list_id int, _rank int")
    chunks = {i: n for block in _probe_blocks(counts, CELL_PROBES) for i, _, n in block}
    stored = spark.read.parquet(path).select("parent_asin", "embedding", "list_id").filter(F.col("list_id").isin(list(chunks)))
    sizes = {r["list_id"]: r["count"] for r in stored.groupBy("list_id").count().collect()}
    shape = [(i, -(-n // CELL_ROWS), chunks[i]) for i, n in sizes.items()]
    cells = sum(groups * n for _, groups, n in shape)
    shaped = F.broadcast(spark.createDataFrame(shape, "list_id int, _groups int, _chunks int"))
    group, chunk = F.pmod(F.xxhash64("parent_asin"), "_groups"), F.pmod(F.xxhash64("query_id"), "_chunks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["list_id", "_group", "_chunk"]
    # A number of tasks that follows the work, which the adaptive merge of small partitions doesn't see.
    tasks = min(max(2 * spark.sparkContext.defaultParallelism, cells), MAX_CELL_TASKS)
    rows = stored.join(shaped, "list_id").select("parent_asin", "embedding", "list_id", group.cast("int").alias("_group"), every("_chunks").alias("_chunk"))
    sent = asked.join(shaped, "list_id").select("query_id", "vector", "list_id", chunk.cast("int").alias("_chunk"), every("_groups").alias("_group"))

    def compare(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if held.empty or wanted.empty:
            return pd.DataFrame()  # no columns: Arrow doesn't take an empty one of numbers for text
        keys, points = held["parent_asin"].to_numpy(), _points(held["embedding"])
        ids, found = wanted["query_id"].to_numpy(), []
        step = min(block_probes, QUERY_BLOCK)
        for start in range(0, len(ids), step):
            for scores in _cosine_block(_points(wanted["vector"].iloc[start : start + step]), points):
                best = _best(keys, scores, top_k)
                found.append((keys[best], scores[best]))
        return pd.DataFrame(
            {
                "query_id": np.repeat(ids, [len(k) for k, _ in found]),
                "parent_asin": np.concatenate([k for k, _ in found]),
                "_score": np.concatenate([s for _, s in found]),
            }
        ).assign(list_id=held["list_id"].iloc[0])

    met = rows.repartition(tasks, *key).groupBy(*key).cogroup(sent.repartition(tasks, *key).groupBy(*key))
    found = scratch_path(spark, "probed")
    order = [F.col("_score").asc(), F.col("parent_asin").asc()]
    top_rows(met.applyInPandas(compare, schema), ["query_id"], order, top_k).write.parquet(found)
    best = spark.read.schema(f"{schema}, _pos int").parquet(found)
    distance = F.when(F.col("_score") != float("inf"), F.col("_score")).otherwise(F.lit(float("nan")))
    return best.select("query_id", "parent_asin", distance.alias("_distance"), "list_id", F.col("_pos").alias("_rank"))


def _points(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])
