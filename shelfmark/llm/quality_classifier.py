"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

1. Each text becomes a row of statistics (lengths, kinds of characters, repetition, line ends); the rows
   are written once, so the costly pass over the texts happens once.
2. The statistics are scaled by the means and deviations of the labelled rows and mapped to cosines of random
   projections, whose inner products approximate a Gaussian kernel.
3. Every task sums its rows into the normal equations; the sums of all tasks, a fixed number of values
   whatever the number of rows, are solved on the driver. All labelled rows count, none is sampled.
4. Scores of the labelled rows, counted in bins of fixed width, are fitted by a rising step function (pool
   adjacent violators), which turns scores into shares of good texts. A thousandth of the raw score is mixed
   in, so texts of one step keep their order.

Only the text is an input of a score. A null text counts as an empty one, and empty texts are scored too. Labels
of one document that differ are averaged; null labels don't count. Without labels all scores are 0.5, with
labels of one kind all scores are that label. Rows that repeat get equal scores. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import scratch_path

N_FOURIER = 192
#: Width of the kernel in scaled statistics.
KERNEL_WIDTH = 4.0
RIDGE = 1e-3
BIN = 1e-3
SEED = 7

_CLOSED = re.compile(r"[.!?:;…][\"'’”»)\]]*\s*$")
_MARKED = re.compile(rb"[#*$%&|<>!?]{2,}")
NAMES = (
    "log_chars log_words word_length word_spread distinct_words distinct_pairs top_word symbols bars "
    "upper digits punctuation exclamations marked log_lines line_words closed_lines repeated_lines "
    "beyond_ascii spaces entropy"
).split()


def statistics(text: str) -> list[float]:
    """The statistics of one text; zeros where there is nothing to count."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    share = lambda chars: float(counts[list(chars)].sum()) / n
    words = data.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    p = counts[counts > 0] / n
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        min(float(lengths.mean()), 40.0),
        min(float(lengths.std()), 40.0),
        len(tally) / m,
        len(set(zip(words, words[1:]))) / max(len(words) - 1, 1),
        max(tally.values(), default=0) / m,
        share(b"#*$%&<>"),
        share(b"|"),
        share(range(65, 91)),
        share(range(48, 58)),
        share(b".,;:'\"()-"),
        share(b"!?"),
        min(len(_MARKED.findall(data)) / m, 1.0),
        math.log1p(len(lines)),
        math.log1p(len(words) / k),
        sum(1 for x in lines if _CLOSED.search(x[-24:])) / k,
        1 - len(set(lines)) / k,
        float(counts[128:].sum()) / n,
        share(b" "),
        float(-(p * np.log(p)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of each row, written to the shared scratch folder and read from there."""

    @F.pandas_udf("array<double>")
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(x or "") for x in texts])

    path = scratch_path(docs.sparkSession, "statistics")
    docs.select("doc_id", stats(F.col("text").cast("string")).alias("stats")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class Model:
    """Scaling, projections, weights and calibration steps; nothing in it grows with the input."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.mean) / self.deviation)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = np.clip(self.raw(stats), 0.0, 1.0)
        return 0.999 * np.interp(raw, self.steps_at, self.steps) + 0.001 * raw


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant; the same projections everywhere, by a fixed seed."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0.0, 1.0 / KERNEL_WIDTH, (x.shape[1], N_FOURIER))
    b = rng.uniform(0.0, 2 * np.pi, N_FOURIER)
    z = math.sqrt(2.0 / N_FOURIER) * np.cos(np.clip(x, -8, 8) @ w + b)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _normal_equations(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows: each task sums its own, then equal cells are added up."""
    size = N_FOURIER + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if len(batch):
                z = fourier((_matrix(batch["stats"]) - mean) / deviation)
                total[:, :size] += z.T @ z
                total[:, size] += z.T @ batch["y"].to_numpy(np.float64)
        yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "cells": list(total)})

    cells = rows.select("stats", "y").mapInPandas(sums, "i int, cells array<double>")
    added = cells.select("i", F.posexplode("cells").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = added.toPandas()
    out = np.zeros((size, size + 1))
    out[found["i"], found["j"]] = found["v"]
    return out[:, :size], out[:, size]


def rising_steps(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest rising step function (pool adjacent violators): ends of the steps and their values."""
    blocks: list[list[float]] = []
    for x, y, n in zip(at, mean, weight):
        blocks.append([x, x, y, n])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            first, last, y2, n2 = blocks.pop()
            left = blocks[-1]
            left[1] = last
            left[2] = (left[2] * left[3] + y2 * n2) / (left[3] + n2)
            left[3] += n2
    ends = [(e, b[2]) for b in blocks for e in ((b[0], b[1]) if b[1] > b[0] else (b[0],))]
    return np.array([x for x, _ in ends]), np.array([y for _, y in ends])


def fit(rows: DataFrame) -> Model:
    """A model from rows of ``stats`` and ``y`` (0 to 1). Runs three small jobs."""
    n_stats = len(NAMES)
    values = [F.col("stats")[i] for i in range(n_stats)]
    told = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high"),
        F.array(*(F.avg(v) for v in values)).alias("mean"),
        F.array(*(F.coalesce(F.stddev_pop(v), F.lit(0.0)) for v in values)).alias("deviation"),
    ).collect()[0]
    if not told["n"] or told["low"] == told["high"]:
        constant = 0.5 if not told["n"] else float(told["low"])
        flat = np.zeros(N_FOURIER + 1)
        flat[-1] = constant
        return Model(np.zeros(n_stats), np.ones(n_stats), flat, np.array([0.0]), np.array([constant]))
    mean, deviation = np.array(told["mean"]), np.array(told["deviation"])
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    left, right = _normal_equations(rows, mean, deviation)
    penalty = RIDGE * told["n"] * np.eye(N_FOURIER + 1) / N_FOURIER
    penalty[-1, -1] = 0.0
    weights = np.linalg.solve(left + penalty, right)
    model = Model(mean, deviation, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bins = np.rint(np.clip(model.raw(_matrix(batch["stats"])), 0, 1) / BIN).astype(np.int32)
                yield pd.DataFrame({"bin": bins, "y": batch["y"]})

    binned = rows.select("stats", "y").mapInPandas(raw, "bin int, y double")
    table = binned.groupBy("bin").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    table = table.sort_values("bin")
    model.steps_at, model.steps = rising_steps(
        table["bin"].to_numpy() * BIN, table["y"].to_numpy(), table["n"].to_numpy(np.float64)
    )
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for rows of ``doc_id, stats``."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series(model.score(_matrix(column)) if len(column) else [], dtype="float64")

    return stats.select("doc_id", scored("stats").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, held_out=None, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    ``held_out`` is a condition on doc_id; rows that meet it are scored but never learnt from.
    """
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    stats = with_statistics(docs)
    known = (
        labels.filter(F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
    )
    model = fit(stats.filter(~held).join(known, "doc_id"))
    return score(stats, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
