"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import (
    bpe, centroids, fill_in_middle, fingerprints, license_scans, mixing, ngram_join, quality_classifier, quality_rules,
    secret_scans, token_counts, topk_join, warc,
)

#: Tokens that a training sequence holds.
SEQUENCE = 1024


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = token_counts.token_counts(spark, F.col("text"), _tokenizer("byte_bpe_50k.json"), SEQUENCE)
    return docs.select("doc_id", counted.alias("t")).select("doc_id", "t.*")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), into="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.measure(docs).select(
        "doc_id",
        *(
            f"quality.{x}"
            for x in (
                "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
                "n_lines n_lines_kept kept_words"
            ).split()
        ),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.draws(docs).select(
        "doc_id", "source", F.col("draws_tokens").alias("n_tokens"), F.col("draws_block").alias("block"), "draws",
        F.col("draws_epoch").alias("epoch"), F.col("draws_start").alias("start"),
    )


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    field = secret_scans.fit(docs)
    found = docs.select("doc_id", secret_scans.find_secrets(F.col("text"), field).alias("found"))

    def told(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in secret_scans.KINDS),
        F.sha2(told(F.filter("found", lambda s: s["kind"] != "crf")).cast("binary"), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.filter("kind = 'record'").select(
        F.col("fields")["warc-page-key"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("fields")["warc-refers-to-page-key"].cast("long").alias("refers_to"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return quality_classifier.classify(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out
    )


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, dim=64, scale=256)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fingerprints.neighbours(_table(spark, sf_dir, "documents"))
    return near.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next",
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42)
    again = fill_in_middle.restored(F.col("fim.output"), F.col("fim.form"))
    return made.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )


REGISTRY = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_byte_bpe, op3_quality_rules, op4_license_scans, op5_mixing, op6_exact_topk,
        op7_ngram_jaccard_join, op8_secret_scans, op9_warc, op10_quality_classifier,
        op11_centroid_clustering, op12_fingerprints, op13_fill_in_middle,
    )
}
