"""From raw documents to token ids: clean, drop near duplicates, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one
reads it. All but the last return the columns of ``docs``. What happens to odd rows (nulls, empty and very
long texts, repeated rows, empty tables) is stated in the operator that a stage calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, mixing, ngram_join, quality_rules, secret_scans
from shelfmark.session import materialize, scratch_path

#: None: the join, the random field and the encoder can't be written in SQL; they are tested by brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them documents that lose too much."""
    return quality_rules.clean_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked as near duplicates, the one with the smallest doc_id stays.

    Rows with one doc_id and different texts are different documents: each is kept or goes with its own
    component. Of those in one component that share the smallest doc_id the set with the smallest hash stays,
    of rows with equal sets and doc_id one; rows without a doc_id stay.
    """
    near = ngram_join.linked_sets(docs)
    path = scratch_path(spark, "near")
    near.filter("doc_id is not null").write.parquet(path)
    near = spark.read.parquet(path)
    first = near.filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("node").alias("node"))
    rows = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    reused = materialize(rows.filter("n > 1").select("doc_id"))
    kept = docs.join(first.select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)
    if reused.take(1):  # sets are read again for these rows only
        again = ngram_join.with_nodes(kept.join(reused, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), F.col("text")))
        chosen = again.select("row", "node", F.col("row.doc_id").alias("doc_id")).join(
            first.select("doc_id", "node"), ["doc_id", "node"], "left_semi"
        )
        kept = kept.join(reused, "doc_id", "left_anti").unionByName(
            chosen.dropDuplicates(["doc_id", "node"]).select("row.*")
        )
    return kept.unionByName(docs.filter("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secret_scans.redact(docs, secret_scans.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of small sources are repeated until the sources have their target weights; none is dropped."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: the ids of each row, and the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, into="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text")
    )


STAGES = [
    ("quality rules", clean),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
