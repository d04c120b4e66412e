"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Texts become vectors of transformed statistics (logs and square roots of shares). For each language and source
the covariance of the most concentrated ``SHARE`` of its rows is found by concentration steps from three starts
(medians and quarters; the correlations of squashed scores; plain moments), of which the one that ends with the
least determinant holds. Rows far from it by Mahalanobis distance are rejected.

A concentration step needs the rows of least distance: each pass sums counts, vectors and outer products by
group, start and distance bin where the rows are, and only these sums (``BINS`` a start and group at most) are put in
order and accumulated until the share is reached, the last bin in part. So no group is gathered, whatever its
size. The estimate is regularised: it is raised to be consistent for normal data, a floor variance is added, so
shares that are nearly always zero do not make the determinant vanish, and it is shrunk towards that of the
language, and that towards the one of all rows, by ``PRIOR_ROWS`` rows' worth. So a group of any size has an
estimate of its own, and small ones lean on their language.

Models of up to ``MODEL_LIMIT`` groups ride along with a pass as a broadcast; more groups take more passes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut, cut_small, lean
from quadrille.llm.textstats import FEATURES, statistics

SHARE = 0.75
STEPS = 4
BINS = 128
STARTS = 3
#: Least standard deviation of each feature.
FLOOR = np.array((0.6, 0.5, 0.03, 0.06, 0.05, 0.04, 0.12, 0.12, 0.03, 0.03, 0.6, 0.06))
#: The range of each feature that the first medians and quarters are read from, in so many slots.
RANGE = np.array((16.0, 60.0, *(1.0,) * 8, 16.0, 1.0))
SLOTS = 512
#: Rows' worth of the wider group's estimate in each group's own.
PRIOR_ROWS = 200
#: Groups whose models (4 kB a start) are broadcast at once.
MODEL_LIMIT = 4096

_P = len(FEATURES)
_UP = np.triu_indices(_P)
_WIDTH = 1 + _P + len(_UP[0])
_MODEL = "grp string, n double, mean array<double>, cov array<double>"


def chi_square(x: float, dof: int) -> float:
    """The chi-square distribution function for an even number of degrees."""
    term = total = 1.0
    for j in range(1, dof // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dof) < p else (low, middle)
    return low


#: What makes the covariance of the most concentrated share consistent for normal data.
CONSISTENCY = SHARE / chi_square(chi_square_quantile(SHARE, _P), _P + 2)
#: Rejected from this squared distance on, which one of 1e12 rows of a normal distribution would reach.
CUTOFF = chi_square_quantile(1 - 1e-12, _P)


def _group(lang: Column, source: Column) -> Column:
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c))
    return F.concat_ws("\n", part(lang), part(source))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whitener(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """A root of the inverse covariance, and the log of the determinant."""
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, 1e-12)
    return (vectors / np.sqrt(values)).T, float(np.log(values).sum())


def squared_distance(x: np.ndarray, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of rows to their models, given by row."""
    return (np.einsum("nij,nj->ni", root, x - mean) ** 2).sum(axis=1)


def _bin(d: np.ndarray) -> np.ndarray:
    return np.clip(np.round(8 * np.log2(1 + d)), 0, BINS - 1).astype(np.int64)


def _levels(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and codes of the rows' groups: language and source, language, all; columns 0 and 1 hold the first two."""
    for mark, column in (("s\n", 0), ("l\n", 1)):
        codes = batch.column(column).dictionary_encode()
        yield [mark + x for x in codes.dictionary.to_pylist()], codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    yield ["a"], np.zeros(batch.num_rows, np.int64)


def _turn(name: str, turns: int) -> int:
    return zlib.crc32(name.encode()) % turns


class _Sums:
    """Arrays summed by (group, start, bin), sent on as Arrow batches when there are many."""

    def __init__(self, width: int, most: int = 1 << 15):
        self.width, self.most, self.held = width, most, {}

    def add(self, names: list[str], start: int, code: np.ndarray, bins: np.ndarray, rows: np.ndarray) -> None:
        if not len(code):
            return
        step = int(bins.max()) + 1
        key = code * step + bins
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        for k, v in zip(key[order][heads].tolist(), np.add.reduceat(rows[order], heads), strict=True):
            at = names[k // step], start, k % step
            self.held[at] = self.held[at] + v if at in self.held else v

    def sent(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held and (last or len(self.held) > self.most):
            grp, start, bins = zip(*self.held, strict=True)
            flat = np.stack(list(self.held.values()))
            at = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * self.width)
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(start, pa.int32()), pa.array(bins, pa.int32()), pa.ListArray.from_arrays(at, pa.array(flat.reshape(-1)))], ["grp", "start", "bin", "sums"])
            self.held.clear()


_SUMS = "grp string, start int, bin int, sums array<double>"


def _passed(rows: DataFrame, width: int, visit) -> DataFrame:
    """Sums by (group, start, bin) over all rows; visit(sums, names, code, x) adds those of one batch and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(width)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), _P)
                for names, code in _levels(batch):
                    visit(sums, names, code, x)
                yield from sums.sent()
        yield from sums.sent(last=True)

    # Summed once more by (group, start, bin), so that a group's task gets a bounded number of rows.
    added = F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")
    return rows.mapInArrow(lean(run), _SUMS).groupBy("grp", "start", "bin").agg(added)


def _moments(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(x), 1)), x, x[:, _UP[0]] * x[:, _UP[1]]], axis=1)


def _covariance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from summed moments."""
    mean = sums[1 : 1 + _P] / sums[0]
    cov = np.zeros((_P, _P))
    cov[_UP] = sums[1 + _P :] / sums[0] - mean[_UP[0]] * mean[_UP[1]]
    return mean, cov + np.triu(cov, 1).T


def _row(grp: str, n: float, means: np.ndarray, covs: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"grp": [grp], "n": [n], "mean": [means.reshape(-1)], "cov": [covs.reshape(-1)]})


def _quarters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians, and robust deviations as a diagonal, from a group's counts by feature and slot."""
    middle, scale = np.zeros(_P), np.zeros(_P)
    feature, slot, n = pdf["bin"].to_numpy() // SLOTS, pdf["bin"].to_numpy() % SLOTS, np.stack(pdf["sums"].to_numpy())[:, 0]
    for f in range(_P):
        mine = np.flatnonzero(feature == f)
        mine = mine[np.argsort(slot[mine])]
        total = np.cumsum(n[mine])
        a, b, c = ((slot[mine][np.searchsorted(total, q * total[-1])] + 0.5) / SLOTS * RANGE[f] for q in (0.25, 0.5, 0.75))
        middle[f], scale[f] = b, max((c - a) / 1.349, FLOOR[f])
    return _row(pdf["grp"].iloc[0], n.sum() / _P, middle, np.diag(scale**2))


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The three starts of a group: the row of start 0 has its medians and scale, 1 squashed scores, 2 plain moments."""
    by = {int(s): np.asarray(v) for s, v in zip(pdf["start"], pdf["sums"], strict=True)}
    floor = np.diag(FLOOR**2)
    middle, scale = by[0][:_P] / by[2][0], by[0][_P : 2 * _P] / by[2][0]
    squashed = _covariance(by[1])[1] * np.outer(scale, scale) + floor
    mean, cov = _covariance(by[2])
    return _row(pdf["grp"].iloc[0], by[2][0], np.stack([middle, middle, mean]), np.stack([np.diag(scale**2), squashed, cov + floor]))


def _concentrated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each start's mean and covariance of the least distant share, from a group's sums by start and bin."""
    means, covs, n = np.zeros((STARTS, _P)), np.zeros((STARTS, _P, _P)), 0.0
    for start, some in pdf.groupby("start"):
        some = some.sort_values("bin")
        sums = np.stack(some["sums"].to_numpy())
        n = sums[:, 0].sum()
        before = np.cumsum(sums[:, 0]) - sums[:, 0]
        weight = np.clip((SHARE * n - before) / sums[:, 0], 0, 1)
        means[start], cov = _covariance(weight @ sums)
        covs[start] = cov * CONSISTENCY + np.diag(FLOOR**2)
    return _row(pdf["grp"].iloc[0], n, means, covs)


def _least(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each row's starts the one of least determinant."""
    out = []
    for grp, n, mean, cov in zip(pdf["grp"], pdf["n"], pdf["mean"], pdf["cov"], strict=True):
        covs = np.asarray(cov).reshape(STARTS, _P, _P)
        best = min(range(STARTS), key=lambda s: whitener(covs[s])[1])
        out.append(_row(grp, n, np.asarray(mean).reshape(STARTS, _P)[best], covs[best]))
    return pd.concat(out)


def _held(model: DataFrame, starts: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Means and whiteners of at most MODEL_LIMIT groups, on the driver."""
    found = {}
    for r in model.collect():
        covs = np.array(r["cov"]).reshape(starts, _P, _P)
        found[r["grp"]] = np.array(r["mean"]).reshape(starts, _P), np.stack([whitener(c)[0] for c in covs])
    return found


def _with_models(names: list[str], code: np.ndarray, models: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a model, their codes into the models found, and these as arrays of means and whiteners."""
    have = [i for i, x in enumerate(names) if x in models]
    place = np.full(len(names) + 1, -1)
    place[have] = np.arange(len(have))
    rows = np.flatnonzero(place[code] >= 0)
    if not have:
        return rows, code[:0], np.zeros((0, 1, _P)), np.zeros((0, 1, _P, _P))
    return rows, place[code[rows]], np.stack([models[names[i]][0] for i in have]), np.stack([models[names[i]][1] for i in have])


def _estimates(rows: DataFrame, turn: int, turns: int, steps: int) -> DataFrame:
    """Estimates (grp, n, mean, cov) of the groups, at all levels, whose turn it is; rows are (grp, wide, features)."""
    spark = rows.sparkSession

    def slots(sums: _Sums, names: list[str], code: np.ndarray, x: np.ndarray) -> None:
        mine = np.array([_turn(n, turns) == turn for n in names])[code]
        at = np.clip(x[mine] / RANGE * SLOTS, 0, SLOTS - 1).astype(np.int64) + np.arange(_P) * SLOTS
        sums.add(names, 0, np.repeat(code[mine], _P), at.reshape(-1), np.ones((at.size, 1)))

    first = cut_small(_passed(rows, 1, slots).groupBy("grp").applyInPandas(_quarters, _MODEL))
    quarters = spark.sparkContext.broadcast({r["grp"]: (np.array(r["mean"])[None], np.sqrt(np.diag(np.array(r["cov"]).reshape(_P, _P)))[None]) for r in first.collect()})

    def starts(sums: _Sums, names: list[str], code: np.ndarray, x: np.ndarray) -> None:
        at, own, middle, scale = _with_models(names, code, quarters.value)
        if not len(at):
            return
        some, zero = [n for n in names if n in quarters.value], np.zeros(len(at), np.int64)
        middle, scale = middle[own, 0], scale[own, 0]
        same = np.zeros((len(at), _WIDTH))
        same[:, : 2 * _P] = np.concatenate([middle, scale], axis=1)
        for start, values in enumerate((same, _moments(np.tanh((x[at] - middle) / scale)), _moments(x[at]))):
            sums.add(some, start, own, zero, values)

    model = cut_small(_passed(rows, _WIDTH, starts).groupBy("grp").applyInPandas(_starts, _MODEL))
    quarters.unpersist()
    for _ in range(steps):
        held = spark.sparkContext.broadcast(_held(model, STARTS))

        def concentrate(sums: _Sums, names: list[str], code: np.ndarray, x: np.ndarray, held=held) -> None:
            at, own, mean, root = _with_models(names, code, held.value)
            if not len(at):
                return
            some, moments = [n for n in names if n in held.value], _moments(x[at])
            for start in range(STARTS):
                sums.add(some, start, own, _bin(squared_distance(x[at], mean[own, start], root[own, start])), moments)

        model = cut_small(_passed(rows, _WIDTH, concentrate).groupBy("grp").applyInPandas(_concentrated, _MODEL))
        held.unpersist()
    return model.mapInPandas(lambda frames: (_least(f) for f in frames if len(f)), _MODEL)


def _shrunk(pdf: pd.DataFrame, whole: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    """Each group's estimate drawn towards its language's, drawn towards that of all."""
    out = []
    for r in pdf.itertuples():
        mean, cov = whole
        for n, m, c in ((r.n_l, r.mean_l, r.cov_l), (r.n_s, r.mean_s, r.cov_s)):
            w = n / (n + PRIOR_ROWS)
            mean, cov = w * np.asarray(m) + (1 - w) * mean, w * np.asarray(c) + (1 - w) * cov
        out.append(_row(r.grp, r.n_s, mean, cov))
    return pd.concat(out)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, steps: int = STEPS, model_limit: int = MODEL_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or more than half of them in repeated three-word windows. Others are kept
    unless their squared distance reaches ``cutoff``. Null text counts as empty; a null language or source is a
    value of its own. Estimates leave out base failures; where a group has nothing else, its distances are null.
    Repeated rows count each time; texts of any length count whole; further columns are ignored, whatever their
    names. Empty tables give an empty result.
    """
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    carried = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _group(lang, source).alias("grp"), _group(lang, F.lit(None).cast("string")).alias("wide"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = cut(statistics(carried, "id", "text", "grp", "wide").withColumn("base_failed", failed))
    rows = stats.where(~F.col("base_failed")).select("grp", "wide", "features")
    groups = cut(rows.select("grp", "wide").distinct())
    turns = -(-(groups.count() + groups.select("wide").distinct().count() + 1) // model_limit)
    found = _estimates(rows, 0, turns, steps)
    for turn in range(1, turns):
        found = found.unionByName(_estimates(rows, turn, turns, steps))
    found = cut(found)

    def level(mark: str, by: str) -> DataFrame:
        own = found.where(F.substring("grp", 1, 1) == mark)
        return own.select(F.substring("grp", 3, 1 << 30).alias(by), *(F.col(c).alias(f"{c}_{mark}") for c in ("n", "mean", "cov")))

    joined = groups.join(level("s", "grp"), "grp").join(level("l", "wide"), "wide")
    one = found.where("grp = 'a'").first()
    whole = (np.array(one["mean"]), np.array(one["cov"])) if one else (np.zeros(_P), np.zeros(_P * _P))
    models = cut_small(joined.mapInPandas(lambda frames: (_shrunk(f, whole) for f in frames if len(f)), _MODEL))

    plain = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    part = F.pmod(F.crc32(F.col("grp").cast("binary")), F.lit(turns))
    out = [_measured(stats.where(part == t) if turns > 1 else stats, plain, _held(models.where(part == t), 1)) for t in range(turns)]
    measured = out[0]
    for x in out[1:]:
        measured = measured.unionByName(x)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("distance") < cutoff)).select(*plain, "kept", "distance")


def _measured(stats: DataFrame, plain: list[str], models: dict) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            x, d = _matrix(batch.column(1), _P), np.full(batch.num_rows, np.nan)
            at, own, mean, root = _with_models(codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.value)
            if len(at):
                d[at] = squared_distance(x[at], mean[own, 0], root[own, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(d, mask=np.isnan(d))], [*plain, "distance"])

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    return stats.select("grp", "features", *plain).mapInArrow(lean(measure), ", ".join(f"{c} {kinds[c]}" for c in plain) + ", distance double")
