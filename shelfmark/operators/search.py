"""Two-stage vector search: Hamming preselection on sign bits, then exact cosine rerank."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import settings
from shelfmark.functions import vectors as V


def project_fields(requested: Sequence[str] | None) -> list[str]:
    """Validated projection: the key leads when absent, repeats collapse, order is kept."""
    if not requested:
        return list(settings.DEFAULT_FIELDS)
    unknown = [f for f in requested if f not in settings.PRODUCT_FIELDS]
    if unknown:
        raise ValueError(f"no such product columns: {unknown}; there are {sorted(settings.PRODUCT_FIELDS)}")
    fields = list(dict.fromkeys(requested))
    return fields if "parent_asin" in fields else ["parent_asin", *fields]


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def product_filters(
    max_price: float | None = None,
    min_rating: float | None = None,
    only_in_stock: bool = False,
) -> Column:
    preds = []
    if max_price is not None:
        preds.append(F.col("price") <= F.lit(max_price))
    if min_rating is not None:
        preds.append(F.col("average_rating") >= F.lit(min_rating))
    if only_in_stock:
        preds.append(F.col("rating_number") > 0)
    return all_of(preds)


def query_point(query: DataFrame | Sequence[float], dim: int) -> Column:
    """The query as one scalar struct (vector, bits).

    A one-row DataFrame becomes a scalar subquery, so nothing is joined to the corpus and
    nothing comes to the driver; more than one row fails at run time.
    """
    if isinstance(query, DataFrame):
        vector = F.col(query.columns[0])
        return query.select(
            F.struct(vector.alias("vector"), V.pack_bits(vector, dim).alias("bits")).alias("q")
        ).scalar()
    if len(query) != dim:
        raise ValueError(f"query has {len(query)} dimensions, expected {dim}")
    return F.struct(
        F.lit([float(x) for x in query]).alias("vector"),
        F.array(*[F.lit(w).cast("bigint") for w in V.pack_bits_local(query)]).alias("bits"),
    )


def nearest_by_bits(
    embeddings: DataFrame, q: Column, candidates: int, dim: int
) -> DataFrame:
    """Stage 1: the ``candidates`` closest rows by Hamming distance, key breaking ties.

    With a stored ``bits`` column only key and bits are scanned (1/32 of the vectors). Without
    it the vectors have to be read anyway, so they travel along and stage 2 needs no second scan.
    Everything sits below one sort and limit, which Spark plans as a per-task top-k.
    """
    words = V.words_for(dim)
    stored = "bits" in embeddings.columns
    bits = F.col("bits") if stored else V.pack_bits("embedding", dim)
    columns = [F.col("parent_asin")]
    if "bucket" in embeddings.columns:
        columns.append(F.col("bucket"))  # a partition column: known without reading
    if not stored:
        columns += [F.col("embedding"), q["vector"].alias("_query")]
    return (
        embeddings.select(*columns, V.hamming(bits, q["bits"], words).alias("_hamming"))
        .orderBy(F.col("_hamming").asc_nulls_last(), "parent_asin")
        .limit(candidates)
    )


def rerank(
    candidates: DataFrame, embeddings: DataFrame, q: Column, top_k: int, lookup: str = "join"
) -> DataFrame:
    """Stage 2: exact cosine distance over the candidates, best ``top_k``.

    ``lookup="join"`` keeps one lazy plan and reads key and vector of the whole table;
    ``"keys"`` runs stage 1 first and pushes its few keys into the vector scan, where files
    sorted by key skip nearly every row group. From a table that is partitioned by ``bucket`` both read the
    buckets of the candidates only: the join as its partitions are pruned at run time.
    """
    if "embedding" not in candidates.columns:
        bucketed = ["bucket"] if "bucket" in candidates.columns else []
        vectors = embeddings.select("parent_asin", *bucketed, "embedding")
        # At most top_k * oversample rows, 5,000 within the argument bounds, in both forms.
        if lookup == "keys":
            chosen = candidates.select("parent_asin", *bucketed).collect()
            vectors = vectors.filter(F.col("parent_asin").isin([r["parent_asin"] for r in chosen]))
            if bucketed:
                vectors = vectors.filter(F.col("bucket").isin(sorted({r["bucket"] for r in chosen})))
        else:
            # A condition that all candidates meet, without which Spark sees no reason to prune by them.
            few = candidates.filter(F.coalesce("_hamming", F.lit(0)) >= 0)
            vectors = F.broadcast(few).join(vectors, ["parent_asin", *bucketed])
        # A subquery may not stand inside a lambda, so the query becomes a column first.
        candidates = vectors.withColumn("_query", q["vector"])
    return (
        candidates.select(
            "parent_asin", V.cosine_distance(F.col("embedding"), F.col("_query")).alias("_distance")
        )
        .orderBy(F.col("_distance").asc_nulls_last(), "parent_asin")
        .limit(top_k)
    )


def semantic_search(
    embeddings: DataFrame,
    products: DataFrame,
    query: DataFrame | Sequence[float],
    *,
    dim: int = settings.EMBEDDING_DIM,
    top_k: int = settings.DEFAULT_TOP_K,
    oversample: int = settings.OVERSAMPLE,
    fields: Sequence[str] | None = None,
    max_price: float | None = None,
    min_rating: float | None = None,
    only_in_stock: bool = False,
    filter_mode: str = "post",
    lookup: str = "join",
) -> DataFrame:
    """Products nearest to ``query``, with their cosine distance in ``_distance``.

    ``filter_mode="post"`` applies the product filters after the ``top_k`` cut, so fewer rows
    may return; ``"pre"`` searches only among products that pass them.
    """
    settings.bounded("top_k", top_k, 1, settings.MAX_TOP_K)
    settings.bounded("oversample", oversample, 1, settings.MAX_OVERSAMPLE)
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode must be 'post' or 'pre'")
    if lookup not in ("join", "keys"):
        raise ValueError("lookup must be 'join' or 'keys'")
    columns = project_fields(fields)
    keep = product_filters(max_price, min_rating, only_in_stock)
    q = query_point(query, dim)

    corpus = embeddings
    if filter_mode == "pre":
        corpus = corpus.join(products.filter(keep).select("parent_asin"), "parent_asin", "left_semi")
    candidates = nearest_by_bits(corpus, q, top_k * oversample, dim)
    best = rerank(candidates, embeddings, q, top_k, lookup)
    hits = products.join(F.broadcast(best), "parent_asin")  # best holds at most top_k rows
    # The limit drops nothing; it keeps the final order a top-k instead of a range shuffle.
    return (
        hits.filter(keep).select(*columns, "_distance").orderBy("_distance", "parent_asin").limit(top_k)
    )
