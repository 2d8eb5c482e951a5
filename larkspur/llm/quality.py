"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes a few statistics (shares of kinds of characters, repetition of words and lines, lengths). Random Fourier
features approximate a Gaussian kernel over the standardised statistics. Each partition adds up its part of the normal
equations; these are summed over the cluster in integers (features are rounded to 2^-GRAIN), so that the order of
summation cannot matter. Ridge scores of a part of the labelled rows that the regression has not seen are
calibrated by the pool-adjacent-violators algorithm over a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from larkspur.llm.arrowtext import joined, parts, texts
from larkspur.llm.common import crc_mod, cut, modest, shipped

FEATURES = 192
BANDWIDTH = 2.5
RIDGE = 1e-3
GRAIN = 12
BINS = 400
SEED = 23
#: Of the labelled rows that may be learned from, those with this remainder of crc32 by 7 calibrate, the others are fitted.
CALIBRATE = 3
#: Kinds of bytes: 0 control, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 ! and ?, 7 . , ; : ' " - ( ), 8 other ASCII, 9 beyond ASCII, 10 beyond ASCII within a character.
KIND = np.array([1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in (9, 32) else 5 if b in (10, 13) else 6 if b in b"!?" else 7 if b in b".,;:'\"-()" else 0 if b < 32 or b == 127 else 8 if b < 128 else 10 if b < 192 else 9 for b in range(256)], np.int64)
KINDS = 11


def statistics(items: list[bytes]) -> np.ndarray:
    """A row of statistics for each text."""
    buf, starts, ends = joined(items)
    doc = np.repeat(np.arange(len(items)), ends - starts)
    kinds = np.bincount(doc * KINDS + KIND[buf], minlength=len(items) * KINDS).reshape(-1, KINDS).astype(np.float64)
    chars = np.maximum(1, kinds.sum(1) - kinds[:, 10])
    own = np.empty((len(items), 6))
    for i, text in enumerate(items):
        words, lines = text.split(), text.split(b"\n")
        n = max(1, len(words))
        kinds_of = set(words)
        own[i] = len(words), len(kinds_of) / n if words else 1.0, len(set(lines)) / len(lines), sum(map(len, words)) / n, sum(map(len, kinds_of)) / max(1, len(kinds_of)), len(lines)
    shares = kinds[:, [0, 1, 2, 3, 4, 6, 7, 8, 9]] / chars[:, None]
    logs = np.log1p(np.stack([chars, own[:, 0], own[:, 5]], 1))
    # a long text repeats more of its words: compare with the square root of their number
    rich = own[:, 1] * np.sqrt(np.maximum(1, own[:, 0])) / (1 + np.sqrt(np.maximum(1, own[:, 0])))
    return np.concatenate([np.sqrt(shares), logs, own[:, 1:3], np.log1p(own[:, 3:5]), rich[:, None]], 1)


N_STATISTICS = 9 + 3 + 2 + 2 + 1


def measured(df: DataFrame, text_col: str, keep: tuple) -> DataFrame:
    """The columns keep and stats, the statistics of the text; a null text counts as empty."""
    modest(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("stats", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "__text"):
            got = statistics(texts(batch.column("__text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(batch.num_columns - 1)], lists], names=schema.names)

    return rows.mapInArrow(run, schema)


class Classifier:
    """mean and spread of the statistics, the ridge weights over the random features, and the calibration curve."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.turn = rng.standard_normal((len(mean), features)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.curve = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant, in units of 2^-GRAIN."""
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        return np.rint(np.concatenate([np.cos(z @ self.turn + self.phase), np.ones((len(z), 1))], 1) * (1 << GRAIN)).astype(np.int64)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores, rounded: a text's last bits depend on the other rows of its batch."""
        return np.round(self.features(stats) @ self.weights / (1 << GRAIN), 9)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.curve)


def stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf.stats.to_numpy()) if len(pdf) else np.zeros((0, N_STATISTICS))


def pool(low_to_high: np.ndarray, ones: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of ones / count over increasing positions: the mean position and the value of each pooled block."""
    blocks: list[list[float]] = []
    for at, y, n in zip(low_to_high, ones, count, strict=True):
        blocks.append([at * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame, calibrates: Column) -> Classifier:
    """A classifier of stats by quality (0 or 1). Without rows it scores every text 0.5."""
    spark = labelled.sparkSession
    whole = lambda c: F.round(c * (1 << 20)).cast("decimal(38,0)")
    x = F.col("stats")
    got = labelled.select([whole(x[i]).alias(f"s{i}") for i in range(N_STATISTICS)] + [whole(x[i] * x[i]).alias(f"q{i}") for i in range(N_STATISTICS)]).agg(F.count("*").alias("n"), *[F.sum(f"{a}{i}").alias(f"{a}{i}") for a in "sq" for i in range(N_STATISTICS)]).first()
    n = got["n"]
    if not n:
        return Classifier(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    mean = np.array([float(got[f"s{i}"]) / (1 << 20) / n for i in range(N_STATISTICS)])
    square = np.array([float(got[f"q{i}"]) / (1 << 20) / n for i in range(N_STATISTICS)])
    model = Classifier(mean, np.sqrt(np.maximum(square - mean**2, 1e-6)))
    sent = shipped(spark, model)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = len(sent().phase) + 2
        total = np.zeros((width, width), np.int64)
        for pdf in batches:
            if len(pdf):
                rows = np.concatenate([sent().features(stacked(pdf)), pdf.quality.to_numpy(np.int64)[:, None] << GRAIN], 1)
                total += rows.T @ rows
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    sums = labelled.where(~calibrates).select("stats", "quality").mapInPandas(partial, "i int, j int, v long").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).toPandas()  # (features + 2)^2 / 2 rows
    width = len(model.phase) + 2
    full = np.zeros((width, width))
    full[sums.i, sums.j] = full[sums.j, sums.i] = sums.v / 4.0**GRAIN
    count = full[-2, -2]
    if count:
        model.weights = np.linalg.solve(full[:-1, :-1] + RIDGE * count * np.eye(width - 1), full[:-1, -1])
    sent = shipped(spark, model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = np.clip(np.floor((sent().raw(stacked(pdf)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int64)
            yield pd.DataFrame({"bin": bins, "quality": pdf.quality.to_numpy(np.int64)}).groupby("bin").quality.agg(["sum", "count"]).reset_index().rename(columns={"sum": "ones", "count": "n"})

    curve = labelled.where(calibrates).select("stats", "quality").mapInPandas(scored, "bin long, ones long, n long").groupBy("bin").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).orderBy("bin").toPandas()  # BINS rows at most
    if len(curve):
        model.knots, model.curve = pool((curve.bin.to_numpy() + 0.5) / BINS * 2 - 0.5, curve.ones.to_numpy(float), curve.n.to_numpy(float))
    else:
        model.knots, model.curve = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_quality(df: DataFrame, labels: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1) and predicted (score >= threshold) of every row of df.

    Learns from the labels (doc_id, quality) of rows for which learn, a condition on the id column, holds; rows with a null id or label
    teach nothing, and of several labels of an id the largest counts. Null and empty texts are scored like any other, by their statistics. Without
    labels every score is 0.5. Of repeated rows each is scored, and each teaches; texts of any length are measured whole. Other columns of df, whatever
    their names, are not read. An empty df gives an empty result.
    """
    stats = cut(measured(df, text_col, (id_col,)), "quality-stats")
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("quality"))
    labelled = cut(stats.where(learn).join(known, F.col(id_col) == F.col("__id")).select("stats", "quality", (crc_mod(id_col, 7) == CALIBRATE).alias("calibrates")), "quality-labelled")
    model = fit(labelled, F.col("calibrates"))
    sent = shipped(df.sparkSession, model)
    schema = stats.drop("stats").schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)
                score = np.clip(sent().score(x), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return stats.mapInArrow(run, schema)
