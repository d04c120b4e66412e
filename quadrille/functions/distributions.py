"""Probability distributions and tests, from incomplete gamma and beta functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, aggregate, kernel, scalar, vector

_TINY, _EPS, _NEAR = 1e-300, 1e-16, 1e-15


def _where(*conditions) -> np.ndarray:
    """1 where all conditions hold, else NaN: a factor that makes #NUM! of the rest."""
    return np.where(np.logical_and.reduce(np.broadcast_arrays(*conditions)), 1.0, np.nan)


# -- gamma function, incomplete functions ----------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series from 10 on, below by the recurrence."""
    y, product = np.array(x, dtype="float64"), 1.0
    for _ in range(10):
        low = y < 10
        product, y = np.where(low, product * y, product), np.where(low, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / y
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)
    return np.where((np.asarray(x) == 1) | (np.asarray(x) == 2), 0.0, out)


def gamma_pq(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Regularised lower and upper incomplete gamma functions, the smaller one computed and not subtracted; NaN unless a > 0."""
    a, x = (np.array(v, dtype="float64") for v in np.broadcast_arrays(a, x))
    a = np.where(a > 0, a, np.nan)
    front = np.exp(a * np.log(x) - x - lgamma(a))
    p, q = np.zeros_like(x), np.ones_like(x)
    low, high = (x > 0) & (x < a + 1), (x > 0) & (x >= a + 1) & np.isfinite(x)
    u, v = a[low], x[low]
    term = 1 / u
    total, n = term.copy(), u.copy()
    while (np.abs(term) > np.abs(total) * _EPS).any():  # NaN ends at once
        n += 1
        term *= v / n
        total += term
    p[low] = total * front[low]
    q[low] = 1 - p[low]
    u, v = a[high], x[high]
    b, c = v + 1 - u, np.full_like(v, 1 / _TINY)
    d = 1 / b
    h = d.copy()
    for i in range(1, 100000):
        an = -i * (i - u)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) > _TINY, d, _TINY)
        c = b + an / c
        c = np.where(np.abs(c) > _TINY, c, _TINY)
        h = h * c * d
        if not (np.abs(c * d - 1) > _NEAR).any():
            break
    q[high] = h * front[high]
    p[high] = 1 - q[high]
    p[x == np.inf], q[x == np.inf] = 1.0, 0.0
    bad = np.isnan(a) | np.isnan(x)
    p[bad] = q[bad] = np.nan
    return p, q


def beta_i(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function; NaN inside unless a and b are positive."""
    a, b, x = (np.array(v, dtype="float64") for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    inside = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    turned = x > (a + 1) / (a + b + 2)
    u, v, z = (np.where(turned, one, other)[inside] for one, other in ((b, a), (a, b), (1 - x, x)))
    front = np.exp(lgamma(u + v) - lgamma(u) - lgamma(v) + u * np.log(z) + v * np.log1p(-z)) / u
    c, d = np.ones_like(z), 1 - (u + v) * z / (u + 1)
    d = 1 / np.where(np.abs(d) > _TINY, d, _TINY)
    h = d.copy()
    for m in range(1, 100000):
        for step in (m * (v - m) * z / ((u + 2 * m - 1) * (u + 2 * m)), -(u + m) * (u + v + m) * z / ((u + 2 * m) * (u + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) > _TINY, d, _TINY)
            c = 1 + step / c
            c = np.where(np.abs(c) > _TINY, c, _TINY)
            h = h * c * d
        if not (np.abs(c * d - 1) > _NEAR).any():
            break
    found = front * h
    out[inside] = np.where(turned[inside], 1 - found, found)
    return out


def inverse(cdf, p, low: float, high: float) -> np.ndarray:
    """The x in [low, high] (grown if it is infinite) where an increasing function of arrays reaches p."""
    p = np.asarray(p, dtype="float64")
    a = np.full_like(p, low)
    b = np.full_like(p, max(1.0, 2 * low) if high == math.inf else high)
    while high == math.inf:
        short = (cdf(b) < p) & (b < 1e300)
        if not short.any():
            break
        a, b = np.where(short, b, a), np.where(short, b * 2, b)
    for _ in range(400):
        middle = (a + b) / 2
        if ((middle == a) | (middle == b) | np.isnan(p)).all():
            break
        under = cdf(middle) < p
        a, b = np.where(under, middle, a), np.where(under, b, middle)
    return np.where(np.isnan(p), np.nan, (a + b) / 2)


# -- normal --------------------------------------------------------------------------------------


def erf(x) -> np.ndarray:
    return np.sign(x) * gamma_pq(0.5, np.square(x))[0]


def erfc(x) -> np.ndarray:
    p, q = gamma_pq(0.5, np.square(x))
    return np.where(np.asarray(x) < 0, 1 + p, q)


def phi(z) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z) / math.sqrt(2))


def _density(z):
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@vector("NORM.S.INV", "NORMSINV")
def norm_s_inv(p):
    """Bisection of the smaller tail, so that both ends keep their precision."""
    p = np.asarray(p, dtype="float64") * _where(p > 0, p < 1)
    # The middle is 0; halving towards it would take hundreds of steps.
    z = inverse(lambda x: -phi(-x), np.where(p == 0.5, -0.25, -np.minimum(p, 1 - p)), 0.0, math.inf)
    return np.where(p == 0.5, 0.0, np.where(p < 0.5, -z, z))


vector("GAUSS")(lambda z: phi(z) - 0.5)
scalar("PHI")(lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi))
vector("NORMSDIST")(phi)
vector("NORM.S.DIST", sig="nb")(lambda z, c: np.where(c != 0, phi(z), _density(z)))
vector("ERF", sig="n|n")(lambda a, b=None: erf(a) if b is None else erf(b) - erf(a))
vector("ERF.PRECISE")(erf)
vector("ERFC", "ERFC.PRECISE")(erfc)


@vector("NORM.DIST", "NORMDIST", sig="nnnb")
def norm_dist(x, m, s, c):
    z = (x - m) / s * _where(s > 0)
    return np.where(c != 0, phi(z), _density(z) / s)


@vector("NORM.INV", "NORMINV", sig="nnn")
def norm_inv(p, m, s):
    return m + s * norm_s_inv(p) * _where(s > 0)


@vector("LOGNORM.DIST", sig="nnnb")
def lognorm_dist(x, m, s, c):
    z = (np.log(x) - m) / s * _where(x > 0, s > 0)
    return np.where(c != 0, phi(z), _density(z) / (s * x))


vector("LOGNORMDIST", sig="nnn")(lambda x, m, s: lognorm_dist(x, m, s, np.ones_like(x)))
vector("LOGNORM.INV", "LOGINV", sig="nnn")(lambda p, m, s: np.exp(norm_inv(p, m, s)))


@vector("CONFIDENCE.NORM", "CONFIDENCE", sig="nnn")
def confidence_norm(alpha, sd, n):
    return norm_s_inv(1 - alpha / 2) * sd / np.sqrt(np.trunc(n)) * _where(alpha > 0, alpha < 1, sd > 0, n >= 1)


# -- gamma family --------------------------------------------------------------------------------


@kernel("GAMMA")
def gamma(x: float) -> float:
    if x <= 0 and x == int(x):
        raise FormulaError("#NUM!")
    return math.gamma(x)


vector("GAMMALN", "GAMMALN.PRECISE")(lambda x: lgamma(x) * _where(x > 0))


@vector("GAMMA.DIST", "GAMMADIST", sig="nnnb")
def gamma_dist(x, a, b, c):
    density = np.where(x > 0, np.exp((a - 1) * np.log(x) - x / b - a * np.log(b) - lgamma(a)), np.where(a == 1, 1 / b, 0.0))
    return np.where(c != 0, gamma_pq(a, x / b)[0], density) * _where(x >= 0, a > 0, b > 0)


@vector("GAMMA.INV", "GAMMAINV", sig="nnn")
def gamma_inv(p, a, b):
    fits = _where(p >= 0, p < 1, a > 0, b > 0)
    return np.where(p == 0, 0.0, b * inverse(lambda x: gamma_pq(a, x)[0], p * fits, 0.0, math.inf)) * fits


vector("CHISQ.DIST", sig="nnb")(lambda x, k, c: gamma_dist(x, np.trunc(k) / 2, 2.0, c))


@vector("CHISQ.DIST.RT", "CHIDIST", sig="nn")
def chisq_rt(x, k):
    return gamma_pq(np.trunc(k) / 2, x / 2)[1] * _where(x >= 0, k >= 1)


vector("CHISQ.INV", sig="nn")(lambda p, k: gamma_inv(p, np.trunc(k) / 2, 2.0))
vector("CHISQ.INV.RT", "CHIINV", sig="nn")(lambda p, k: gamma_inv(1 - p, np.trunc(k) / 2, 2.0))


@vector("POISSON.DIST", "POISSON", sig="nnb")
def poisson(x, rate, c):
    k = np.trunc(x)
    density = np.where(rate == 0, k == 0, np.exp(k * np.log(rate) - rate - lgamma(k + 1)))
    return np.where(c != 0, gamma_pq(k + 1, rate)[1], density) * _where(k >= 0, rate >= 0)


@scalar("EXPON.DIST", "EXPONDIST", sig="nnb")
def expon(x: Column, rate: Column, c: Column) -> Column:
    return F.when((x >= 0) & (rate > 0), F.when(c, -F.expm1(-rate * x)).otherwise(rate * F.exp(-rate * x)))


@scalar("WEIBULL.DIST", "WEIBULL", sig="nnnb")
def weibull(x: Column, a: Column, b: Column, c: Column) -> Column:
    z = F.pow(x / b, a)
    return F.when((x >= 0) & (a > 0) & (b > 0), F.when(c, -F.expm1(-z)).otherwise(a / b * F.pow(x / b, a - 1) * F.exp(-z)))


# -- beta family ---------------------------------------------------------------------------------


@vector("BETA.DIST", sig="nnnb|nn")
def beta_dist(x, a, b, c, low=0.0, high=1.0):
    z = (x - low) / (high - low)
    density = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b)) * z ** (a - 1) * (1 - z) ** (b - 1) / (high - low)
    return np.where(c != 0, beta_i(a, b, z), density) * _where(a > 0, b > 0, low <= x, x <= high, low < high)


vector("BETADIST", sig="nnn|nn")(lambda x, a, b, low=0.0, high=1.0: beta_dist(x, a, b, np.ones_like(x), low, high))


@vector("BETA.INV", "BETAINV", sig="nnn|nn")
def beta_inv(p, a, b, low=0.0, high=1.0):
    fits = _where(p > 0, p < 1, a > 0, b > 0, low < high)
    return low + (high - low) * inverse(lambda x: beta_i(a, b, x), p * fits, 0.0, 1.0)


def _choose(n, k):
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


@vector("BINOM.DIST", "BINOMDIST", sig="nnnb")
def binom(k, n, p, c):
    k, n = np.trunc(k), np.trunc(n)
    density = np.where((p == 0) | (p == 1), k == n * p, np.exp(_choose(n, k) + k * np.log(p) + (n - k) * np.log1p(-p)))
    return np.where(c != 0, np.where(k == n, 1.0, beta_i(n - k, k + 1, 1 - p)), density) * _where(k >= 0, k <= n, p >= 0, p <= 1)


@vector("BINOM.DIST.RANGE", sig="nnn|n")
def binom_range(n, p, low, high=None):
    low = np.trunc(low)
    high = low if high is None else np.trunc(high)
    every = np.ones_like(n)
    return binom(high, n, p, every) - np.where(low > 0, binom(np.maximum(low - 1, 0), n, p, every), 0.0) + 0 * _where(low >= 0, low <= high)


@vector("BINOM.INV", "CRITBINOM", sig="nnn")
def binom_inv(n, p, alpha):
    fits = _where(n >= 0, p >= 0, p <= 1, alpha >= 0, alpha <= 1)
    low, high = np.zeros_like(n), np.where(fits == 1, np.trunc(n), 0.0)
    while (low < high).any():
        middle = np.floor((low + high) / 2)
        enough = binom(middle, n, p, np.ones_like(n)) >= alpha * (1 - 1e-12)  # equal but for rounding
        low, high = np.where((low < high) & ~enough, middle + 1, low), np.where((low < high) & enough, middle, high)
    return low * fits


@vector("NEGBINOM.DIST", sig="nnnb")
def negbinom(f, s, p, c):
    f, s = np.trunc(f), np.trunc(s)
    density = np.exp(_choose(f + s - 1, f) + s * np.log(p)) * (1 - p) ** f
    return np.where(c != 0, beta_i(s, f + 1, p), density) * _where(f >= 0, s >= 1, p > 0, p <= 1)


vector("NEGBINOMDIST", sig="nnn")(lambda f, s, p: negbinom(f, s, p, np.zeros_like(f)))


@kernel("HYPGEOM.DIST", sig="nnnnb")
def hypgeom(s: float, n: float, big: float, total: float, c: bool) -> float:
    s, n, big, total = int(s), int(n), int(big), int(total)
    if not (0 <= n <= total and 0 <= big <= total and 0 <= s <= min(n, big)):
        raise FormulaError("#NUM!")
    one = lambda k: math.comb(big, k) * math.comb(total - big, n - k) / math.comb(total, n) if n - k <= total - big else 0.0
    return math.fsum(one(k) for k in range(s + 1)) if c else one(s)


kernel("HYPGEOMDIST", sig="nnnn")(lambda s, n, b, t: hypgeom(s, n, b, t, False))


@vector("F.DIST", sig="nnnb")
def f_dist(x, a, b, c):
    a, b = np.trunc(a), np.trunc(b)
    density = np.exp(a / 2 * np.log(a) + b / 2 * np.log(b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log(a * x + b) + lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2))
    density = np.where(x == 0, np.where(a < 2, np.inf, a == 2), density)
    return np.where(c != 0, beta_i(a / 2, b / 2, a * x / (a * x + b)), density) * _where(x >= 0, a >= 1, b >= 1)


@vector("F.DIST.RT", "FDIST", sig="nnn")
def f_rt(x, a, b):
    a, b = np.trunc(a), np.trunc(b)
    return beta_i(b / 2, a / 2, b / (a * x + b)) * _where(x >= 0, a >= 1, b >= 1)


@vector("F.INV.RT", "FINV", sig="nnn")
def f_inv_rt(p, a, b):
    found = inverse(lambda x: -f_rt(x, a, b), np.where(p == 1, -0.5, -p) * _where(p > 0, p <= 1, a >= 1, b >= 1), 0.0, math.inf)
    return np.where(p == 1, 0 * found, found)


@vector("F.INV", sig="nnn")
def f_inv(p, a, b):
    found = inverse(lambda x: f_dist(x, a, b, np.ones_like(x)), p * _where(p > 0, p < 1, a >= 1, b >= 1), 0.0, math.inf)
    return np.where(p == 0, 0.0, found)


@vector("T.DIST", sig="nnb")
def t_dist(x, k, c):
    k = np.trunc(k)
    tail = beta_i(k / 2, 0.5, k / (k + x * x)) / 2
    density = np.exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / np.sqrt(k * math.pi) * (1 + x * x / k) ** (-(k + 1) / 2)
    return np.where(c != 0, np.where(x < 0, tail, 1 - tail), density) * _where(k >= 1)


@vector("T.DIST.RT", sig="nn")
def t_rt(x, k):
    return t_dist(-x, k, np.ones_like(x))


@vector("T.DIST.2T", sig="nn")
def t_2t(x, k):
    return 2 * t_rt(x, k) * _where(x >= 0)


@vector("TDIST", sig="nnn")
def tdist(x, k, tails):
    tails = np.trunc(tails)
    return tails * t_rt(x, k) * _where(x >= 0, (tails == 1) | (tails == 2))


@vector("T.INV.2T", "TINV", sig="nn")
def t_inv_2t(p, k):
    found = inverse(lambda x: -2 * t_rt(x, k), np.where(p == 1, -0.5, -p) * _where(p > 0, p <= 1, k >= 1), 0.0, math.inf)
    return np.where(p == 1, 0 * found, found)


@vector("T.INV", sig="nn")
def t_inv(p, k):
    z = t_inv_2t(2 * np.minimum(p, 1 - p), k) * _where(p > 0, p < 1)
    return np.where(p > 0.5, z, -z)


@vector("CONFIDENCE.T", sig="nnn")
def confidence_t(alpha, sd, n):
    return t_inv_2t(alpha, np.trunc(n) - 1) * sd / np.sqrt(np.trunc(n)) * _where(alpha > 0, alpha < 1, sd > 0, n >= 2)


scalar("FISHER")(F.atanh)
scalar("FISHERINV")(F.tanh)

# -- tests: aggregates give moments, a kernel the tail ------------------------------------------------


def _tests() -> None:
    from quadrille.functions.registry import fn

    @aggregate("CHISQ.TEST", "CHITEST", sig="rr", err="#N/A")
    def chisq_test(actual, expected):
        return fn("CHISQ.DIST.RT")(F.sum(F.try_divide(F.pow(actual - expected, 2), expected)), F.when(F.count(actual) > 1, F.count(actual) - 1.0))

    @aggregate("F.TEST", "FTEST", sig="rr", err="#DIV/0!")
    def f_test(a, b):
        one = fn("F.DIST.RT")(F.try_divide(F.var_samp(a), F.var_samp(b)), F.count(a) - 1.0, F.count(b) - 1.0)
        return 2 * F.least(one, 1 - one)

    @aggregate("T.TEST", "TTEST", sig="rrnn", err="#DIV/0!")
    def t_test(a, b, tails, kind):
        n, m = F.count(a) * 1.0, F.count(b) * 1.0
        u, v = F.var_samp(a) / n, F.var_samp(b) / m
        d = a - b
        pooled = F.sqrt(((n - 1) * F.var_samp(a) + (m - 1) * F.var_samp(b)) / (n + m - 2) * (1 / n + 1 / m))
        t = F.when(kind == 1, F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).when(kind == 2, (F.avg(a) - F.avg(b)) / pooled).when(kind == 3, (F.avg(a) - F.avg(b)) / F.sqrt(u + v))
        welch = F.pow(u + v, 2) / (u * u / (n - 1) + v * v / (m - 1))
        # A fractional number of degrees of freedom is taken as it is, by the beta function.
        freedom = F.when(kind == 1, F.count(d) - 1.0).when(kind == 2, n + m - 2).otherwise(welch)
        return fn("QUADRILLE.TTAIL")(F.abs(t), freedom, tails)

    @aggregate("Z.TEST", "ZTEST", sig="rn|n", err="#N/A")
    def z_test(a, x, sigma=None):
        sd = F.stddev_samp(a) if sigma is None else sigma
        return 1 - fn("NORMSDIST")((F.avg(a) - x) / (sd / F.sqrt(F.count(a))))


@vector("QUADRILLE.TTAIL", sig="nnn")
def _tail(t, k, tails):
    return np.trunc(tails) * beta_i(k / 2, 0.5, k / (k + t * t)) / 2


_tests()
__all__ = ["beta_i", "gamma_pq", "inverse", "lgamma", "norm_s_inv", "phi"]
