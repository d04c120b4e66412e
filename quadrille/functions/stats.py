"""Aggregates, descriptive and bivariate statistics. Range arguments are numeric Columns with NULL for what does not count."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, aggregate, fold, known, scalar

_L = F.lit


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _sum(*xs: Column) -> Column:
    return _total([F.coalesce(F.sum(x), _L(0.0)) for x in xs])


def _count(*xs: Column) -> Column:
    return _total([F.count(x) for x in xs]).cast("double")


def _least(*xs: Column) -> Column:
    return F.coalesce(F.least(*(F.min(x) for x in xs)) if len(xs) > 1 else F.min(xs[0]), _L(0.0))


def _most(*xs: Column) -> Column:
    return F.coalesce(F.greatest(*(F.max(x) for x in xs)) if len(xs) > 1 else F.max(xs[0]), _L(0.0))


aggregate("SUM")(_sum)
aggregate("COUNT")(_count)
aggregate("AVERAGE", "AVERAGEA", err="#DIV/0!")(lambda *xs: F.try_divide(_sum(*xs), _count(*xs)))
aggregate("MIN", "MINA")(_least)
aggregate("MAX", "MAXA")(_most)


def _one(f):
    """A function of one range, or of several pooled by their moments where that is possible."""

    def build(*xs: Column) -> Column:
        if len(xs) > 1:
            raise TypeError("pool several ranges with VSTACK first")
        return f(xs[0])

    return build


def _variance(sample: bool, root: bool):
    def build(*xs: Column) -> Column:
        if len(xs) == 1:
            f = {(True, False): F.var_samp, (False, False): F.var_pop, (True, True): F.stddev_samp, (False, True): F.stddev_pop}[sample, root]
            return f(xs[0])
        n = _count(*xs)
        mean = F.try_divide(_sum(*xs), n)
        # Pooled from each range's own deviations, which keeps precision.
        squares = _total([F.coalesce(F.var_pop(x) * F.count(x) + F.count(x) * F.pow(F.avg(x) - mean, 2), _L(0.0)) for x in xs])
        out = F.try_divide(squares, n - 1 if sample else n)
        return F.sqrt(out) if root else out

    return build


aggregate("VAR.S", "VAR", "VARA", err="#DIV/0!")(_variance(True, False))
aggregate("VAR.P", "VARP", "VARPA", err="#DIV/0!")(_variance(False, False))
aggregate("STDEV.S", "STDEV", "STDEVA", err="#DIV/0!")(_variance(True, True))
aggregate("STDEV.P", "STDEVP", "STDEVPA", err="#DIV/0!")(_variance(False, True))
aggregate("DEVSQ")(_one(lambda x: F.regr_sxx(x, x)))
aggregate("GEOMEAN")(_one(lambda x: F.when(F.min(x) > 0, F.exp(F.avg(F.ln(F.when(x > 0, x)))))))
aggregate("HARMEAN")(_one(lambda x: F.when(F.min(x) > 0, F.count(x) / F.sum(F.try_divide(_L(1.0), x)))))
aggregate("MEDIAN")(_one(F.median))


@aggregate("SKEW", err="#DIV/0!")
def skew(x: Column) -> Column:
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


@aggregate("SKEW.P", err="#DIV/0!")
def skew_p(x: Column) -> Column:
    return F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 0), F.skewness(x))


@aggregate("KURT", err="#DIV/0!")
def kurt(x: Column) -> Column:
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_pop(x) > 0), ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def ordered(x: Column) -> Column:
    """A group's numbers, sorted; for functions of order that no built-in aggregate gives."""
    return F.array_sort(F.collect_list(x))


@aggregate("AVEDEV")
def avedev(x: Column) -> Column:
    values = F.collect_list(x)
    n = F.size(values)
    mean = F.aggregate(values, _L(0.0), lambda a, v: a + v) / n
    # An expression within a lambda is computed for each element; a field of a bound row is not.
    bound = F.array(F.struct(values.alias("values"), mean.alias("mean")))
    total = F.transform(bound, lambda s: F.aggregate(s["values"], _L(0.0), lambda a, v: a + F.abs(v - s["mean"])))[0]
    return F.when(n > 0, total / n)


def _percentile_exc(x: Column, k: Column) -> Column:
    v = ordered(x)
    at = k * (F.size(v) + 1)
    low = F.floor(at).cast("int")
    a, b = F.get(v, low - 1), F.get(v, low)
    return F.when((at >= 1) & (at <= F.size(v)), F.when(at == low, a).otherwise(a + (at - low) * (b - a)))


def _percentile_inc(x: Column, k: Column) -> Column:
    return F.percentile(x, k)


def _quartile_exc(x: Column, q: Column) -> Column:
    return F.when(F.floor(q).between(1, 3), _percentile_exc(x, F.floor(q) / 4))


aggregate("PERCENTILE.INC", "PERCENTILE", sig="rn")(_percentile_inc)
aggregate("PERCENTILE.EXC", sig="rn")(_percentile_exc)
aggregate("QUARTILE.INC", "QUARTILE", sig="rn")(lambda x, q: F.percentile(x, F.floor(q) / 4))
aggregate("QUARTILE.EXC", sig="rn")(_quartile_exc)
aggregate("LARGE", sig="rn")(lambda x, k: F.get(F.sort_array(F.collect_list(x), asc=False), F.ceil(k).cast("int") - 1))
aggregate("SMALL", sig="rn")(lambda x, k: F.get(ordered(x), F.ceil(k).cast("int") - 1))


@aggregate("TRIMMEAN", sig="rn")
def trimmean(x: Column, share: Column) -> Column:
    v = ordered(x)
    off = F.floor(F.size(v) * share / 2).cast("int")
    some = F.slice(v, off + 1, F.size(v) - 2 * off)
    return F.when((share >= 0) & (share < 1) & (F.size(v) > 0), F.aggregate(some, _L(0.0), lambda a, b: a + b) / F.size(some))


@aggregate("MODE.SNGL", "MODE", sig="o", err="#N/A")
def mode(values: Column) -> Column:
    """The most frequent number of an array, of ties the one first met."""
    return F.get(modes(values), _L(0))


@aggregate("MODE.MULT", sig="o", err="#N/A", returns="array")
def modes(values: Column) -> Column:
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), v.alias("v")))
    most = F.array_max(F.transform(counted, lambda c: c["n"]))
    return F.when(most > 1, F.transform(F.filter(counted, lambda c: c["n"] == most), lambda c: c["v"]))


def _rank(mean: bool):
    def build(v: Column, x: Column, ascending: Column = 0.0) -> Column:
        before = F.sum(F.when(F.when(ascending != 0, x < v).otherwise(x > v), 1).otherwise(0))
        same = F.count_if(x == v)
        return F.when(same > 0, before + 1 + ((same - 1) / 2 if mean else 0)).cast("double")

    return build


aggregate("RANK.EQ", "RANK", sig="nr|n", err="#N/A")(_rank(False))
aggregate("RANK.AVG", sig="nr|n", err="#N/A")(_rank(True))


def _percentrank(inclusive: bool):
    def build(x: Column, v: Column, digits: Column = 3.0) -> Column:
        n = F.count(x)
        low, high = F.max(F.when(x <= v, x)), F.min(F.when(x >= v, x))
        under = F.count_if(x < v)
        at_low = n - F.count_if(x >= v) - 1
        place = F.when(low == v, under.cast("double")).otherwise(at_low + F.try_divide(v - low, high - low))
        share = F.when(n == 1, _L(1.0)).otherwise(F.try_divide(place, n - 1)) if inclusive else (place + 1) / (n + 1)
        f = F.pow(_L(10.0), digits)
        return F.when(low.isNotNull() & high.isNotNull(), F.floor(F.rint(share * f * 1e9) / 1e9) / f)

    return build


aggregate("PERCENTRANK.INC", "PERCENTRANK", sig="rn|n", err="#N/A")(_percentrank(True))
aggregate("PERCENTRANK.EXC", sig="rn|n", err="#N/A")(_percentrank(False))
aggregate("PROB", sig="rrn|n")(lambda x, p, lo, hi=None: F.when(F.abs(F.sum(p) - 1) < 1e-9, F.coalesce(F.sum(F.when((x == lo) if hi is None else x.between(lo, hi), p)), _L(0.0))))


@aggregate("FREQUENCY", sig="ra", returns="array")
def frequency(x: Column, bins: Column) -> Column:
    """Counts up to each bound of a literal array, then above the last."""
    limits = F.array_sort(bins)
    if known(bins) is not None:
        # As many counts as the literal has bounds, and one more.
        last = known(bins)
        inside = [(F.lit(True) if i == 0 else x > F.get(limits, _L(i - 1))) & (F.lit(True) if i == last else x <= F.get(limits, _L(i))) & x.isNotNull() for i in range(last + 1)]
        return F.array(*(F.count_if(b).cast("double") for b in inside))
    n = F.size(limits)
    values = F.collect_list(x)
    return F.transform(F.sequence(_L(0), n), lambda i: F.size(F.filter(values, lambda v: (F.coalesce(v > F.get(limits, i - 1), _L(True))) & (F.coalesce(v <= F.get(limits, i), _L(True))))).cast("double"))


scalar("STANDARDIZE", sig="nnn")(lambda x, m, s: F.when(s > 0, (x - m) / s))

# -- two ranges: only rows where both are numbers count ------------------------------------------


def _paired(f):
    def build(x: Column, y: Column, *rest: Column) -> Column:
        both = x.isNotNull() & y.isNotNull()
        return f(F.when(both, x), F.when(both, y), *rest)

    return build


def _two(*names: str, **more):
    def wrap(f):
        aggregate(*names, **({"sig": "rr", "err": "#DIV/0!"} | more))(_paired(f))
        return f

    return wrap


_two("CORREL", "PEARSON")(lambda x, y: F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)))
_two("COVARIANCE.P", "COVAR")(F.covar_pop)
_two("COVARIANCE.S")(F.covar_samp)
_two("SLOPE")(F.regr_slope)
_two("INTERCEPT")(F.regr_intercept)
_two("RSQ")(F.regr_r2)
_two("STEYX")(lambda y, x: F.when(F.count(x) > 2, F.sqrt((F.regr_syy(y, x) - F.try_divide(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x))) / (F.count(x) - 2))))
aggregate("FORECAST", "FORECAST.LINEAR", sig="nrr", err="#DIV/0!")(lambda v, y, x: _paired(lambda a, b: F.regr_intercept(a, b) + F.regr_slope(a, b) * v)(y, x))
aggregate("LINEST", sig="rr", returns="array", err="#VALUE!")(_paired(lambda y, x: F.array(F.regr_slope(y, x), F.regr_intercept(y, x))))
aggregate("LOGEST", sig="rr", returns="array", err="#NUM!")(_paired(lambda y, x: F.array(F.exp(F.regr_slope(F.ln(y), x)), F.exp(F.regr_intercept(F.ln(y), x)))))
aggregate("TREND", sig="rrn", err="#VALUE!")(lambda y, x, v: _paired(lambda a, b: F.regr_intercept(a, b) + F.regr_slope(a, b) * v)(y, x))
aggregate("GROWTH", sig="rrn", err="#NUM!")(lambda y, x, v: _paired(lambda a, b: F.exp(F.regr_intercept(F.ln(a), b) + F.regr_slope(F.ln(a), b) * v))(y, x))

# -- exponential smoothing -----------------------------------------------------------------------


def _series(values: list[float], timeline: list[float], fill: float) -> tuple[list[float], list[float], float]:
    pairs: dict[float, float] = {}
    for t, v in sorted(zip(timeline, values, strict=True), key=lambda x: x[0]):
        pairs[t] = (pairs[t] + v) / 2 if t in pairs else v
    times = list(pairs)
    if len(times) < 2:
        raise FormulaError("#NUM!")
    step = min(b - a for a, b in zip(times, times[1:], strict=False))
    n = round((times[-1] - times[0]) / step) + 1
    if any(abs((t - times[0]) / step - round((t - times[0]) / step)) > 1e-6 for t in times) or n - len(times) > 0.3 * n:
        raise FormulaError("#NUM!")
    at = {round((t - times[0]) / step): v for t, v in pairs.items()}
    out = []
    for i in range(n):
        if i in at:
            out.append(at[i])
        else:
            nearer = next(at[j] for j in range(i + 1, n) if j in at)
            out.append((out[-1] + nearer) / 2 if fill else 0.0)
    return [times[0] + i * step for i in range(n)], out, step


def _season(y: list[float]) -> int:
    """The lag from 2 to half the length with the highest autocorrelation of differences, if that is 0.3 or more; else 0."""
    d = [b - a for a, b in zip(y, y[1:], strict=False)]
    mean = sum(d) / len(d)
    power = sum((x - mean) ** 2 for x in d)
    best, season = 0.3, 0
    for lag in range(2, len(y) // 2 + 1):
        r = sum((d[i] - mean) * (d[i - lag] - mean) for i in range(lag, len(d))) / power if power else 0.0
        if r > best or (r == best and not season):
            best, season = r, lag
    return season


class _Smoother:
    """Additive error, trend and season; smoothing weights by descent over finer and finer grids."""

    def __init__(self, y: list[float], m: int):
        self.y, self.m = y, m if m > 1 else 0
        n = len(y)
        season = [0.0] * max(self.m, 1)
        if self.m:
            half = self.m // 2
            found: list[list[float]] = [[] for _ in range(self.m)]
            for i in range(half, n - half):
                if self.m % 2:
                    centre = sum(y[i - half : i + half + 1]) / self.m
                else:
                    centre = (y[i - half] / 2 + sum(y[i - half + 1 : i + half]) + y[i + half] / 2) / self.m
                found[i % self.m].append(y[i] - centre)
            season = [sum(x) / len(x) if x else 0.0 for x in found]
            mean = sum(season) / self.m
            season = [s - mean for s in season]
        k = min(n, max(self.m, 2))
        flat = [y[i] - season[i % len(season)] for i in range(k)]
        mx, my = (k - 1) / 2, sum(flat) / k
        slope = sum((i - mx) * (v - my) for i, v in enumerate(flat)) / sum((i - mx) ** 2 for i in range(k))
        self.start = my - slope * mx - slope, slope, season
        self.weights = self._fit()
        self.errors, self.state = self._run(*self.weights)

    def _run(self, alpha: float, beta: float, gamma: float):
        level, trend, season = self.start
        season, errors = list(season), []
        for i, v in enumerate(self.y):
            s = season[i % len(season)]
            errors.append(v - (level + trend + s))
            new = alpha * (v - s) + (1 - alpha) * (level + trend)
            if self.m:
                season[i % self.m] = gamma * (v - level - trend) + (1 - gamma) * s
            trend = beta * (new - level) + (1 - beta) * trend
            level = new
        return errors, (level, trend, season)

    def _fit(self) -> tuple[float, float, float]:
        loss = lambda w: sum(e * e for e in self._run(*w)[0])
        best = [0.5, 0.1, 0.1]
        least = loss(best)
        for step in (0.1, 0.01, 0.001):
            for _ in range(4):
                before = least
                for j in range(3 if self.m else 2):
                    span = 5 if step < 0.1 else 10
                    grid = sorted({round(min(max((best[j] if step < 0.1 else 0.5) + k * step, 0.001), 0.9), 3) for k in range(-span, span + 1)}, reverse=j == 0)
                    for v in grid:
                        trial = [*best]
                        trial[j] = v
                        now = loss(trial)
                        if now < least:
                            best, least = trial, now
                if least == before:
                    break
        return tuple(best)

    def ahead(self, h: float) -> float:
        level, trend, season = self.state
        at = (len(self.y) - 1 + round(h)) % len(season)
        return level + h * trend + season[at]


def _fitted(values: list[float], timeline: list[float], season: float, fill: float) -> tuple[_Smoother, list[float], float]:
    times, y, step = _series(values, timeline, fill)
    return _Smoother(y, _season(y) if season == 1 else int(season)), times, step


@fold("FORECAST.ETS", sig="nrr|nnn")
def forecast_ets(target: float, values: list, timeline: list, season: float = 1, fill: float = 1, how: float = 1) -> float:
    model, times, step = _fitted(values, timeline, season, fill)
    h = (target - times[-1]) / step
    if h <= 0:
        raise FormulaError("#NUM!")
    return model.ahead(h)


@fold("FORECAST.ETS.CONFINT", sig="nrr|nnnn")
def forecast_ets_confint(target: float, values: list, timeline: list, level: float = 0.95, season: float = 1, fill: float = 1, how: float = 1) -> float:
    from quadrille.functions.distributions import norm_s_inv

    model, times, step = _fitted(values, timeline, season, fill)
    h = (target - times[-1]) / step
    if h <= 0 or not 0 < level < 1:
        raise FormulaError("#NUM!")
    sd = math.sqrt(sum(e * e for e in model.errors) / len(model.errors))
    return float(norm_s_inv((1 + level) / 2)) * sd * math.sqrt(1 + (h - 1) * model.weights[0] ** 2)


@fold("FORECAST.ETS.SEASONALITY", sig="rr|nn")
def forecast_ets_seasonality(values: list, timeline: list, fill: float = 1, how: float = 1) -> float:
    return float(_season(_series(values, timeline, fill)[1]))


@fold("FORECAST.ETS.STAT", sig="rrn|nnn")
def forecast_ets_stat(values: list, timeline: list, kind: float, season: float = 1, fill: float = 1, how: float = 1) -> float:
    model, _, step = _fitted(values, timeline, season, fill)
    y, e = model.y, model.errors
    mae = sum(map(abs, e)) / len(e)
    naive = sum(abs(b - a) for a, b in zip(y, y[1:], strict=False)) / (len(y) - 1)
    smape = sum(2 * abs(x) / (abs(v) + abs(v - x)) if abs(v) + abs(v - x) else 0.0 for x, v in zip(e, y, strict=True)) / len(e)
    found = [*model.weights, mae / naive if naive else 0.0, smape, mae, math.sqrt(sum(x * x for x in e) / len(e)), step]
    if not 1 <= kind <= 8:
        raise FormulaError("#NUM!")
    return found[int(kind) - 1]
