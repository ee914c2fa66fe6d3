"""Run records: parameters and metrics of embedding runs, searches and prompt variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import settings

STAGES = ("embedding", "stage1", "stage2", "generation")


def _strings(pairs: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def _numbers(pairs: dict[str, Column]) -> Column:
    built = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("double"))])
    return F.map_filter(built, lambda _, v: v.isNotNull())


def total_latency() -> Column:
    total = F.lit(0.0)
    for stage in STAGES:
        total = total + F.coalesce(F.col(f"{stage}_ms"), F.lit(0.0))
    return total


def search_runs(requests: DataFrame) -> DataFrame:
    """A run row per search request.

    ``requests`` holds run_id, started_at, query, top_k, results and one ``*_ms`` column per
    stage; a stage that did not run counts as 0.
    """
    # Names of a search run's parameters, and its quantisation.
    params = {
        "query_length_chars": F.length("query"),
        "top_k": F.col("top_k"),
        "oversample_factor": F.lit(settings.OVERSAMPLE),
        "quantisation": F.lit("binary_quantize+halfvec"),
    }
    metrics = {f"{s}_ms": F.coalesce(F.col(f"{s}_ms"), F.lit(0.0)) for s in STAGES}
    metrics |= {"total_latency_ms": total_latency(), "results_returned": F.col("results")}
    return requests.select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("search-request").alias("name"),
        "started_at", _strings(params).alias("params"), _numbers(metrics).alias("metrics"),
    )


def embedding_run_metrics(batches: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Totals per embedding run from its timed batches (run_id, items, elapsed_s, dim)."""
    items = F.coalesce(F.sum("items"), F.lit(0))
    seconds = F.coalesce(F.sum("elapsed_s"), F.lit(0.0))
    return batches.groupBy(*by).agg(
        items.alias("total_embed"),
        F.round(seconds * 1000, 2).alias("total_embeddings_time_ms"),
        F.round(seconds / F.greatest(items, F.lit(1)) * 1000, 4).alias("avg_embedding_time_ms"),
        F.max("dim").alias("embedding_dim"),
    )


def embedding_runs(timings: DataFrame) -> DataFrame:
    """A run row per embedding run (run_id, started_at, items, elapsed_s, dim, model)."""
    totals = embedding_run_metrics(timings, ("run_id", "started_at", "model"))
    names = ("total_embed", "total_embeddings_time_ms", "avg_embedding_time_ms", "embedding_dim")
    return totals.select(
        F.col("run_id").cast("string").alias("run_id"), F.lit("embedding").alias("name"), "started_at",
        _strings({"model_name": F.col("model")}).alias("params"),
        _numbers({n: F.col(n) for n in names}).alias("metrics"),
    )


def prompt_variant_runs(variants: DataFrame) -> DataFrame:
    """A run row per logged prompt variant; absent quality scores are left out."""
    return variants.select(
        F.col("run_id").cast("string").alias("run_id"),
        F.concat(F.lit("prompt-"), F.col("variant_name")).alias("name"),
        "started_at",
        _strings(
            {"variant_name": F.col("variant_name"), "prompt_char_length": F.length("prompt_template")}
        ).alias("params"),
        _numbers(
            {
                c: F.col(c)
                for c in ("input_token_count", "output_token_count", "faithfulness", "answer_relevance")
            }
        ).alias("metrics"),
    )


def compare_variants(runs: DataFrame) -> DataFrame:
    """Mean scores and token counts per prompt variant."""
    m = F.col("metrics")
    return (
        runs.filter(F.col("name").startswith("prompt-"))
        .groupBy(F.col("params")["variant_name"].alias("variant_name"))
        .agg(
            F.count("*").alias("runs"),
            F.avg(m["input_token_count"]).alias("input_tokens"),
            F.avg(m["output_token_count"]).alias("output_tokens"),
            F.avg(m["faithfulness"]).alias("faithfulness"),
            F.avg(m["answer_relevance"]).alias("answer_relevance"),
        )
    )
