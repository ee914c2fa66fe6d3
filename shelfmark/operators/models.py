"""Model steps: batched encoders and classifiers as pluggable functions, with JVM defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark import settings
from shelfmark.functions import vectors as V
from shelfmark.functions.text import tokens
from shelfmark.session import scratch_path


def encode_with(
    df: DataFrame,
    text: str,
    make_predict_fn: Callable,
    output: str = "embedding",
    batch_size: int = settings.ENCODE_BATCH,
) -> DataFrame:
    """Attach vectors from a user's model. ``make_predict_fn`` loads it once per Python worker
    and returns a function from a batch of texts to a (batch, dim) array."""
    encode = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return df.withColumn(output, encode(F.col(text)))


def hashing_encoder(
    df: DataFrame, text: str, dim: int = settings.EMBEDDING_DIM, output: str = "embedding"
) -> DataFrame:
    """Default encoder: signed hashed bag of words of unit length, computed in the JVM.

    Words fall into 2 * dim buckets by the first 32 bits of their md5, so vectors can be made again outside Spark; a
    component is bucket i less bucket dim + i, so it can have either sign and the sign bits carry information.
    """
    buckets = 2 * dim
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets
    placed = df.withColumn("_words", F.transform(tokens(F.col(text)), lambda w: number(w).cast("string")))
    counts = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(buckets)], inputCol="_words", outputCol="_counts"
    )
    counted = counts.transform(placed)
    halves = vector_to_array("_counts", "float32")
    signed = F.zip_with(
        F.slice("_halves", 1, dim), F.slice("_halves", dim + 1, dim), lambda a, b: a - b
    )
    return (
        counted.withColumn("_halves", halves)
        .withColumn("_signed", signed)
        .withColumn(output, V.l2_normalize(F.col("_signed")))
        .drop("_words", "_counts", "_halves", "_signed")
    )


def embedding_rows(
    products: DataFrame, encoded: str, dim: int, model_name: str, run_id: str | None
) -> DataFrame:
    """Stored embedding columns of encoded products; rows without a key are skipped."""
    vector = F.transform(encoded, lambda x: F.round(x.cast("double"), 6).cast("float"))
    return (
        products.filter(F.coalesce("parent_asin", F.lit("")) != "")
        .withColumn("_vector", vector)
        .select(
            "parent_asin",
            F.col("_vector").alias("embedding"),
            V.to_half("_vector").alias("embedding_half"),
            V.pack_bits("_vector", dim).alias("bits"),
            F.lit(model_name).alias("model_name"),
            F.lit(run_id).cast("string").alias("run_id"),
        )
    )


def train_sentiment(labelled: DataFrame, text: str = "text", label: str = "label"):
    """Default classifier, fitted on (text, 0/1 label): hashed tf-idf and logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=1 << 14),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=20, regParam=0.01),
    ]
    fitted = Pipeline(stages=stages).fit(labelled.filter(F.col(text).isNotNull()))
    # Stored and loaded again, the model is free of its training summary, which holds the
    # session and cannot be sent to executors once the session has observed a query.
    path = scratch_path(labelled.sparkSession, "sentiment")
    fitted.save(path)
    return PipelineModel.load(path)


def score_sentiment(df: DataFrame, model, text: str = "text") -> DataFrame:
    """Add ``sentiment_label`` and ``sentiment_score``, the confidence in the label to four
    decimals; null text gives nulls."""
    filled = df.withColumn("_given", F.col(text)).withColumn(text, F.coalesce(text, F.lit("")))
    odds = vector_to_array("probability")
    scored = model.transform(filled)
    known = F.col("_given").isNotNull()
    return (
        scored.withColumn(
            "sentiment_label",
            F.when(known, F.when(F.col("prediction") >= 1, "positive").otherwise("negative")),
        )
        .withColumn("sentiment_score", F.when(known, F.round(F.array_max(odds), 4)))
        .withColumn(text, F.col("_given"))
        .drop("_given", "_words", "_tf", "_features", "rawPrediction", "probability", "prediction")
    )


def score_with(
    df: DataFrame,
    text: str,
    make_predict_fn: Callable,
    batch_size: int = settings.SENTIMENT_BATCH,
) -> DataFrame:
    """Label and score from a user's model: it maps a batch of texts to a (batch, 2) array of
    probabilities for (negative, positive)."""
    predict = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    known = F.col(text).isNotNull()
    scored = df.withColumn("_p", predict(F.coalesce(text, F.lit(""))))
    positive = F.get("_p", F.lit(1)) >= F.get("_p", F.lit(0))
    return (
        scored.withColumn("sentiment_label", F.when(known, F.when(positive, "positive").otherwise("negative")))
        .withColumn("sentiment_score", F.when(known, F.round(F.array_max("_p").cast("double"), 4)))
        .drop("_p")
    )


def generate_with(df: DataFrame, prompt: str, make_predict_fn: Callable, batch_size: int = 8) -> DataFrame:
    """Add ``summary`` from a user's text generator, cut after its last summary marker."""
    from shelfmark.functions.text import NO_REVIEWS, summary_of

    generate = predict_batch_udf(make_predict_fn, return_type=T.StringType(), batch_size=batch_size)
    asked = F.col(prompt) != NO_REVIEWS
    return df.withColumn("_out", generate(F.col(prompt))).withColumn(
        "summary", F.when(asked, summary_of(F.col("_out"))).otherwise(F.col(prompt))
    ).drop("_out")
