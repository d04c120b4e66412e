"""Mathematics and trigonometry."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, aggregate, finite, fold, kernel, round15, scalar

_L = F.lit
#: Beyond this, trigonometric functions have no value.
_TURNS = float(2**27)


def _where(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


for _name, _f in {"ABS": F.abs, "ASINH": F.asinh, "ATAN": F.atan, "COSH": F.cosh, "SINH": F.sinh, "TANH": F.tanh, "EXP": F.exp, "DEGREES": F.degrees, "RADIANS": F.radians, "ACOSH": F.acosh, "ACOS": F.acos, "ASIN": F.asin, "SIGN": F.signum, "LN": F.ln, "LOG10": F.log10}.items():
    scalar(_name)(lambda x, f=_f: finite(f(x)))
for _name, _f in {"SIN": F.sin, "COS": F.cos, "TAN": F.tan, "SEC": F.sec}.items():
    scalar(_name)(lambda x, f=_f: _where(F.abs(x) < _TURNS, f(x)))
for _name, _f in {"COT": F.cot, "CSC": F.csc}.items():
    scalar(_name, err="#DIV/0!")(lambda x, f=_f: _where((x != 0) & (F.abs(x) < _TURNS), f(x)))

scalar("INT")(lambda x: F.floor(x).cast("double"))
scalar("ATANH")(lambda x: _where(F.abs(x) < 1, F.atanh(x)))
scalar("ACOT")(lambda x: F.when(x == 0, F.pi() / 2).when(x > 0, F.atan(1 / x)).otherwise(F.atan(F.try_divide(_L(1.0), x)) + F.pi()))
scalar("ACOTH")(lambda x: _where(F.abs(x) > 1, F.atanh(F.try_divide(_L(1.0), x))))
scalar("ATAN2", sig="nn", err="#DIV/0!")(lambda x, y: _where((x != 0) | (y != 0), F.atan2(y, x)))
scalar("COTH", err="#DIV/0!")(lambda x: F.try_divide(_L(1.0), F.tanh(x)))
scalar("CSCH", err="#DIV/0!")(lambda x: F.try_divide(_L(1.0), F.sinh(x)))
scalar("SECH")(lambda x: F.try_divide(_L(1.0), F.cosh(x)))
scalar("SQRT")(lambda x: _where(x >= 0, F.sqrt(x)))
scalar("SQRTPI")(lambda x: _where(x >= 0, F.sqrt(x * F.pi())))
scalar("PI", sig="")(lambda: F.pi())
scalar("RAND", sig="")(lambda: F.rand())
scalar("RANDBETWEEN", sig="nn")(lambda a, b: F.floor(F.rand() * (F.floor(F.greatest(a, b)) - F.ceil(F.least(a, b)) + 1)) + F.ceil(F.least(a, b)).cast("double"))
scalar("EVEN")(lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2)
scalar("ODD")(lambda x: F.when(x == 0, _L(1.0)).otherwise(F.signum(x) * (F.ceil((F.abs(x) - 1) / 2) * 2 + 1)))


@scalar("LOG", sig="n|n")
def log(x: Column, base: Column = 10.0) -> Column:
    return _where((x > 0) & (base > 0) & (base != 1), F.try_divide(F.ln(x), F.ln(base)))


@scalar("POWER", "^", sig="nn")
def power(b: Column, e: Column) -> Column:
    """0^0 and a fractional power of a negative number are #NUM!, a negative power of 0 #DIV/0!."""
    return _where(~((b == 0) & (e <= 0)) & ~((b < 0) & (e != F.floor(e))), finite(F.pow(b, e)))


@scalar("MOD", sig="nn", err="#DIV/0!")
def mod(n: Column, d: Column) -> Column:
    ratio = F.try_divide(n, d)
    return _where(F.abs(ratio) <= float(2**40), n - d * F.floor(ratio))


@scalar("QUOTIENT", sig="nn", err="#DIV/0!")
def quotient(n: Column, d: Column) -> Column:
    return _towards_zero(F.try_divide(n, d))


def _towards_zero(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


def _snapped(x: Column) -> Column:
    """The number with noise after its twelfth decimal taken off, where it is small enough to have any."""
    return F.when(F.abs(x) < 1e6, F.rint(x * 1e12) / 1e12).otherwise(round15(x))


@scalar("ROUND", sig="n|n")
def round_half_up(x: Column, d: Column = 0.0) -> Column:
    f = F.pow(_L(10.0), _towards_zero(d))
    return F.signum(x) * F.floor(_snapped(F.abs(x) * f) + 0.5) / f


@scalar("ROUNDUP", sig="n|n")
def roundup(x: Column, d: Column = 0.0) -> Column:
    f = F.pow(_L(10.0), _towards_zero(d))
    return F.signum(x) * F.ceil(_snapped(F.abs(x) * f)) / f


@scalar("ROUNDDOWN", sig="n|n")
def rounddown(x: Column, d: Column = 0.0) -> Column:
    f = F.pow(_L(10.0), _towards_zero(d))
    return F.signum(x) * F.floor(_snapped(F.abs(x) * f)) / f


@scalar("TRUNC", sig="n|n")
def trunc(x: Column, d: Column = 0.0) -> Column:
    f = F.pow(_L(10.0), _towards_zero(d))
    return _towards_zero(x * f) / f


@scalar("CEILING", "CEILING.MATH", "CEILING.PRECISE", "ISO.CEILING", sig="n|nn")
def ceiling(x: Column, step: Column = 1.0, away: Column = 0.0) -> Column:
    s = F.abs(step)
    up = F.when((x < 0) & (away != 0), F.floor(F.try_divide(x, s))).otherwise(F.ceil(F.try_divide(x, s)))
    return F.when(s == 0, _L(0.0)).otherwise(up * s)


@scalar("FLOOR", "FLOOR.MATH", "FLOOR.PRECISE", sig="n|nn")
def floor(x: Column, step: Column = 1.0, toward: Column = 0.0) -> Column:
    s = F.abs(step)
    down = F.when((x < 0) & (toward != 0), F.ceil(F.try_divide(x, s))).otherwise(F.floor(F.try_divide(x, s)))
    return F.when(s == 0, _L(0.0)).otherwise(down * s)


@scalar("MROUND", sig="nn")
def mround(x: Column, m: Column) -> Column:
    q = F.try_divide(x, m)
    return F.when((x == 0) | (m == 0), _L(0.0)).when(F.signum(x) == F.signum(m), F.floor(q + 0.5) * m)


def _product(first: Column, last: Column, step: int = 1) -> Column:
    """first · (first+step) · … · last, 1 if there is none."""
    some = (last >= first) if step > 0 else (last <= first)
    terms = F.when(some, F.sequence(first.cast("int"), last.cast("int"), _L(step))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, _L(1.0), lambda a, i: a * i)


@scalar("FACT")
def fact(n: Column) -> Column:
    return _where((n >= 0) & (n < 171), _product(_L(1), F.floor(F.least(n, _L(170.0)))))


@scalar("FACTDOUBLE")
def factdouble(n: Column) -> Column:
    return _where((n >= -1) & (n <= 300), _product(F.floor(F.greatest(F.least(n, _L(300.0)), _L(1.0))), _L(1), -2))


@scalar("COMBIN", sig="nn")
def combin(n: Column, k: Column) -> Column:
    n, k = F.floor(n), F.floor(k)
    small = F.least(k, n - k)
    steps = F.when((small >= 1) & (small <= 10000), F.sequence(_L(1), small.cast("int"))).otherwise(F.array().cast("array<int>"))
    # Beyond 10,000 steps the value is past any double.
    return _where((n >= 0) & (k >= 0) & (k <= n) & (small <= 10000), finite(F.rint(F.aggregate(steps, _L(1.0), lambda a, i: a * (n - small + i) / i))))


@scalar("COMBINA", sig="nn")
def combina(n: Column, k: Column) -> Column:
    n, k = F.floor(n), F.floor(k)
    return F.when((n == 0) & (k == 0), _L(1.0)).otherwise(combin(n + k - 1, k))


@scalar("PERMUT", sig="nn")
def permut(n: Column, k: Column) -> Column:
    n, k = F.floor(n), F.floor(k)
    return _where((n >= 0) & (k >= 0) & (k <= n), _product(n - k + 1, n))


scalar("PERMUTATIONA", sig="nn")(lambda n, k: _where((n >= 0) & (k >= 0), finite(F.pow(F.floor(n), F.floor(k)))))


@scalar("BASE", sig="nn|n", returns="text")
def base(n: Column, radix: Column, width: Column = 0.0) -> Column:
    digits = F.call_function("conv", F.floor(n).cast("bigint").cast("string"), _L(10), radix.cast("int"))
    return _where((n >= 0) & radix.between(2, 36), F.when(F.length(digits) < width, F.lpad(digits, width.cast("int"), "0")).otherwise(digits))


@scalar("DECIMAL", sig="tn")
def decimal(text: Column, radix: Column) -> Column:
    digits = F.upper(F.trim(text))
    values = F.transform(F.split(digits, ""), lambda c: F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    good = F.forall(values, lambda v: (v >= 0) & (v < radix)) & (F.length(digits) > 0)
    return _where(good & radix.between(2, 36), F.aggregate(values, _L(0.0), lambda a, v: a * radix + v))


@aggregate("PRODUCT")
def product(*xs: Column) -> Column:
    """15 digits, once at the end; 0 for no numbers."""
    count = reduce(lambda a, b: a + b, (F.count(x) for x in xs))
    value = reduce(lambda a, b: a * b, (F.coalesce(F.product(x), _L(1.0)) for x in xs))
    return F.when(count == 0, _L(0.0)).otherwise(round15(value))


aggregate("SUMSQ")(lambda *xs: round15(reduce(lambda a, b: a + b, (F.coalesce(F.sum(x * x), _L(0.0)) for x in xs))))
aggregate("SUMPRODUCT")(lambda *xs: F.coalesce(F.sum(reduce(lambda a, b: a * b, (F.coalesce(x, _L(0.0)) for x in xs))), _L(0.0)))
aggregate("SUMX2MY2", sig="rr", err="#DIV/0!")(lambda x, y: F.sum(x * x - y * y))
aggregate("SUMX2PY2", sig="rr", err="#DIV/0!")(lambda x, y: F.sum(x * x + y * y))
aggregate("SUMXMY2", sig="rr", err="#DIV/0!")(lambda x, y: F.sum((x - y) * (x - y)))
aggregate("PERCENTOF", sig="rr", err="#DIV/0!")(lambda part, whole: F.try_divide(F.coalesce(F.sum(part), _L(0.0)), F.sum(whole)))


def _whole(lists: tuple[list[float], ...]) -> list[int]:
    out = [math.floor(v) for values in lists for v in values]
    if not out or any(v < 0 or v > 2**53 for v in out):
        raise FormulaError("#NUM!")
    return out


fold("GCD", sig="r*")(lambda *v: float(math.gcd(*_whole(v))))
fold("LCM", sig="r*")(lambda *v: float(math.lcm(*_whole(v))))


@fold("MULTINOMIAL", sig="r*")
def multinomial(*v: list[float]) -> float:
    total, out = 0, 1
    for k in _whole(v):
        total += k
        out *= math.comb(total, k)
    return float(out)


@fold("SERIESSUM", sig="nnnr")
def seriessum(x: float, n: float, m: float, coefficients: list[float]) -> float:
    return sum(a * x ** (n + i * m) for i, a in enumerate(coefficients))


# Roman numerals and their subtractive forms, most classic first.
_ROMAN = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
_ROMAN_PAIRS = (
    {"CM": 900, "CD": 400, "XC": 90, "XL": 40, "IX": 9, "IV": 4},
    {"LM": 950, "LD": 450, "VC": 95, "VL": 45},
    {"XM": 990, "XD": 490, "IC": 99, "IL": 49},
    {"VM": 995, "VD": 495},
    {"IM": 999, "ID": 499},
)


@kernel("ROMAN", sig="n|n", returns="text", err="#VALUE!")
def roman(n: float, form: float = 0) -> str:
    n = int(n)
    if not 0 <= n <= 3999 or not 0 <= form <= 4:
        raise FormulaError("#VALUE!")
    signs = dict(_ROMAN)
    for pairs in _ROMAN_PAIRS[: int(form) + 1]:
        signs |= pairs
    out = ""
    for sign, value in sorted(signs.items(), key=lambda x: -x[1]):
        while n >= value:
            out, n = out + sign, n - value
    return out


@kernel("ARABIC", sig="t", err="#VALUE!")
def arabic(text: str) -> float:
    text = text.strip().upper()
    sign = -1 if text.startswith("-") else 1
    values = [_ROMAN[c] if c in _ROMAN else None for c in text.lstrip("-")]
    if None in values:
        raise FormulaError("#VALUE!")
    return float(sign * sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values)))


# -- matrices: arrays of rows ------------------------------------------------------------------


@scalar("MUNIT", returns="array")
def munit(n: Column) -> Column:
    side = F.sequence(_L(1), n.cast("int"))
    return F.transform(side, lambda i: F.transform(side, lambda j: F.when(i == j, 1.0).otherwise(0.0)))


@scalar("SEQUENCE", sig="n|nnn", returns="array")
def sequence(rows: Column, cols: Column = 1.0, start: Column = 1.0, step: Column = 1.0) -> Column:
    """Values in row order."""
    return F.transform(F.sequence(_L(0), (rows * cols).cast("int") - 1), lambda i: start + i * step)


@scalar("RANDARRAY", sig="|nnnnb", returns="array")
def randarray(rows: Column = 1.0, cols: Column = 1.0, low: Column = 0.0, high: Column = 1.0, whole: Column = False) -> Column:
    seed = F.floor(F.rand() * 1e15)
    draw = lambda i: F.pmod(F.xxhash64(seed, i), _L(1 << 53)) / float(1 << 53)
    return F.transform(F.sequence(_L(1), (rows * cols).cast("int")), lambda i: F.when(whole, F.floor(low + draw(i) * (high - low + 1)).cast("double")).otherwise(low + draw(i) * (high - low)))
