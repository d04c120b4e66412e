"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Texts become vectors of statistics, standardised by the training rows' means and deviations. Cosines of random
projections approximate a Gaussian kernel over them. Each partition sums its rows' outer products and targets,
the sums are added in a tree, and one solve of fixed size gives the scores. Scores of training rows that the fit
left out are binned, and pool-adjacent-violators over the bins' sums makes them probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut
from quadrille.llm.textstats import FEATURES, statistics

FREQUENCIES = 192
RIDGE = 1e-3
GAMMA = 0.05
BINS = 1024
#: Bins need this many rows' worth of prior at the overall rate.
PRIOR = 0.5
_P = len(FEATURES)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; between the knots they rise with the raw score, so order is kept."""
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.998 * level + 0.002 * (1 / (1 + np.exp(-4 * (raw - 0.5)))), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Features whose inner products approximate exp(-GAMMA |a - b|²), a constant and the vector itself."""
    rng = np.random.Generator(np.random.PCG64(4021))
    w = rng.standard_normal((_P, FREQUENCIES)) * np.sqrt(2 * GAMMA)
    b = rng.uniform(0, 2 * np.pi, FREQUENCIES)
    z = np.clip(z, -8, 8)
    return np.concatenate([np.sqrt(2 / FREQUENCIES) * np.cos(z @ w + b), np.ones((len(z), 1)), 0.1 * z], axis=1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, _P)


def _added(parts: DataFrame, fan_in: int = 16) -> np.ndarray | None:
    """The sum of the binary arrays in ``parts`` (part, sums), added ``fan_in`` at a time until one is left."""

    def add(found: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in found["sums"].to_pylist()], axis=0)
        return pa.table({"part": found["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = cut(parts)
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("bigint")).groupBy("part").applyInArrow(add, "part bigint, sums binary")
        n = -(-n // fan_in)
        if n <= 1:
            break
    row = parts.first()
    return None if row is None else np.frombuffer(bytes(row["sums"]), np.float64)


def _normal(mean: np.ndarray, scale: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = FREQUENCIES + 1 + _P
        total = np.zeros((width + 1, width))
        for batch in batches:
            z = fourier((_vectors(batch) - mean) / scale)
            total[:-1] += z.T @ z
            total[-1] += batch.column(1).to_numpy(zero_copy_only=False).astype(float) @ z
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    return sums


def _pooled(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means of sums y over counts n."""
    held: list[list[float]] = []
    for a, b in zip(y, n, strict=True):
        held.append([a, b, 1])
        while len(held) > 1 and held[-2][0] * held[-1][1] >= held[-1][0] * held[-2][1]:
            a2, b2, k2 = held.pop()
            held[-1] = [held[-1][0] + a2, held[-1][1] + b2, held[-1][2] + k2]
    return np.repeat([a / b for a, b, _ in held], [int(k) for _, _, k in held])


def learn_quality(rows: DataFrame, fit: Column, calibrate: Column) -> QualityModel:
    """A model from rows (features, label), fitted on those of ``fit`` and calibrated on those of ``calibrate``.

    The driver gets one matrix of fixed size and at most BINS sums. Without both labels the score is constant.
    """
    at = [F.col("features")[i] for i in range(_P)]
    train = rows.where(fit).select("features", F.col("label").cast("int").alias("label"))
    seen = train.agg(F.count("*"), F.sum("label"), *(F.avg(x) for x in at), *(F.stddev_pop(x) for x in at)).first()
    n, ones = seen[0], seen[1] or 0
    rate = (ones + 1) / (n + 2)
    if ones in (0, n):
        return QualityModel(np.zeros(_P), np.ones(_P), None, np.zeros(1), np.array([rate]))
    mean, scale = np.array(seen[2 : 2 + _P], float), np.maximum(np.array(seen[2 + _P :], float), 0.01)
    total = _added(train.mapInArrow(_normal(mean, scale), "part bigint, sums binary")).reshape(-1, FREQUENCIES + 1 + _P)
    weights = np.linalg.solve(total[:-1] + RIDGE * n * np.eye(total.shape[1]) / total.shape[1], total[-1])
    model = QualityModel(mean, scale, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BINS))
        for batch in batches:
            at = np.clip(((model.raw(_vectors(batch)) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            sums[0] += np.bincount(at, minlength=BINS)
            sums[1] += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False).astype(float), minlength=BINS)
        full = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[0][full]), pa.array(sums[1][full])], ["bin", "n", "y"])

    held = rows.where(calibrate).select("features", F.col("label").cast("int").alias("label"))
    bins = held.mapInArrow(binned, "bin bigint, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if not bins:
        return QualityModel(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    count = np.array([r.n for r in bins])
    level = _pooled(np.array([r.y for r in bins]) + PRIOR * rate / len(bins), count + PRIOR / len(bins))
    return QualityModel(mean, scale, weights, (np.array([r.bin for r in bins]) + 0.5) / BINS * 2 - 0.5, level)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of rows whose crc32(id) mod 5 is 0 are not learned from; of the others, those of remainder 4
    calibrate and the rest fit. Labels other than 0 and 1, null included, are left out; a document labelled
    twice counts twice. Null text is empty, texts of any length count whole. A null id is never held out and has
    no label. Further columns are ignored, whatever their names. Empty tables give an empty result.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    stats = cut(statistics(docs, id_col, text_col).select("doc_id", "features"))
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = cut(stats.join(marks.where(fold != 0), "doc_id").withColumn("fold", fold))
    model = docs.sparkSession.sparkContext.broadcast(learn_quality(rows, F.col("fold") < 4, F.col("fold") == 4))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.value.score(_vectors(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    out = stats.select("features", "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return out.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
