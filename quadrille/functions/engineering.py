"""Engineering functions: number bases, bits, complex numbers as text, Bessel functions, units."""

from __future__ import annotations

import cmath
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import FormulaError, kernel, scalar

_L = F.lit


def _need(*conditions: bool) -> None:
    if not all(conditions):
        raise FormulaError("#NUM!")


# -- number bases: ten digits in two's complement ----------------------------------------------------

#: Base and number of bits of each kind.
_BASES = {"BIN": (2, 10), "OCT": (8, 30), "HEX": (16, 40)}


def _parsed(kind: str, t: Column) -> Column:
    base, bits = _BASES[kind]
    t = F.upper(F.trim(t))
    digits = {2: "01", 8: "0-7", 16: "0-9A-F"}[base]
    value = F.call_function("conv", F.when(t == "", "0").otherwise(t), _L(base), _L(10)).cast("bigint")
    signed = F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)
    return F.when(F.call_function("rlike", t, _L(f"^[{digits}]{{0,10}}$")), signed)


def _shown(kind: str, n: Column, places: Column | None) -> Column:
    base, bits = _BASES[kind]
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    n = F.floor(n).cast("bigint")
    text = F.call_function("conv", F.when(n < 0, n + (1 << bits)).otherwise(n).cast("string"), _L(10), _L(base))
    if places is not None:
        p = F.floor(places).cast("int")
        text = F.when(n < 0, text).when((p >= F.length(text)) & (p <= 10), F.lpad(text, p, "0"))
    return F.when(n.between(low, high), text)


for _from in _BASES:
    scalar(f"{_from}2DEC", sig="t")(lambda t, k=_from: _parsed(k, t).cast("double"))
    scalar(f"DEC2{_from}", sig="n|n", returns="text")(lambda n, p=None, k=_from: _shown(k, n, p))
    for _to in _BASES:
        if _to != _from:
            scalar(f"{_from}2{_to}", sig="t|n", returns="text")(lambda t, p=None, a=_from, b=_to: _shown(b, _parsed(a, t), p))

_BITS = float(2**48)


def _bits(name: str, f) -> None:
    def build(a: Column, b: Column) -> Column:
        x, y = F.floor(a).cast("bigint"), F.floor(b).cast("bigint")
        return F.when(a.between(0, _BITS - 1) & b.between(0, _BITS - 1), f(x, y).cast("double"))

    scalar(name, sig="nn")(build)


_bits("BITAND", lambda a, b: a.bitwiseAND(b))
_bits("BITOR", lambda a, b: a.bitwiseOR(b))
_bits("BITXOR", lambda a, b: a.bitwiseXOR(b))


def _shift(a: Column, n: Column) -> Column:
    out = F.floor(F.floor(a) * F.pow(_L(2.0), F.floor(n)))
    return F.when((a >= 0) & (a < _BITS) & (F.abs(n) <= 53) & (out < _BITS), out.cast("double"))


scalar("BITLSHIFT", sig="nn")(_shift)
scalar("BITRSHIFT", sig="nn")(lambda a, n: _shift(a, -n))

# -- complex numbers -----------------------------------------------------------------------------

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_COMPLEX = re.compile(rf"^(?:({_NUMBER})(?![\dij.]))?(?:([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)?)([ij]))?$")


def parse_complex(text: str) -> tuple[complex, str]:
    t = text.strip().replace(" ", "")
    m = _COMPLEX.match(t)
    if not t or not m or not (m[1] or m[3]):
        raise FormulaError("#NUM!")
    imaginary = 0.0
    if m[3]:
        imaginary = float(m[2] + "1") if m[2] in ("", "+", "-") else float(m[2])
    return complex(float(m[1] or 0), imaginary), m[3] or "i"


def _digits(x: float) -> str:
    out = f"{x:.15g}".replace("e", "E")
    return "0" if out in ("-0", "0") else out


def show_complex(z: complex, unit: str = "i") -> str:
    re_, im = _digits(z.real), _digits(z.imag)
    if im == "0":
        return re_
    part = {"1": "", "-1": "-"}.get(im, im) + unit
    if re_ == "0":
        return part
    return re_ + ("" if part.startswith("-") else "+") + part


@kernel("COMPLEX", sig="nn|t", returns="text", err="#VALUE!")
def complex_(a: float, b: float, unit: str = "i") -> str:
    if unit not in ("i", "j"):
        raise FormulaError("#VALUE!")
    return show_complex(complex(a, b), unit)


for _name, _f in {"IMABS": abs, "IMREAL": lambda z: z.real, "IMAGINARY": lambda z: z.imag}.items():
    kernel(_name, sig="t")(lambda t, f=_f: float(f(parse_complex(t)[0])))


@kernel("IMARGUMENT", sig="t", err="#DIV/0!")
def imargument(t: str) -> float:
    z = parse_complex(t)[0]
    _need(z != 0)
    return cmath.phase(z)


def _inverse(f):
    return lambda z: 1 / f(z)


_ELEMENTARY = {
    "IMCONJUGATE": complex.conjugate, "IMCOS": cmath.cos, "IMCOSH": cmath.cosh, "IMCOT": _inverse(cmath.tan), "IMCSC": _inverse(cmath.sin), "IMCSCH": _inverse(cmath.sinh), "IMEXP": cmath.exp, "IMLN": cmath.log,
    "IMLOG10": cmath.log10, "IMLOG2": lambda z: cmath.log(z) / math.log(2), "IMSEC": _inverse(cmath.cos), "IMSECH": _inverse(cmath.cosh), "IMSIN": cmath.sin, "IMSINH": cmath.sinh, "IMSQRT": cmath.sqrt, "IMTAN": cmath.tan,
}
for _name, _f in _ELEMENTARY.items():

    def _apply(t: str, f=_f) -> str:
        z, unit = parse_complex(t)
        return show_complex(f(z), unit)

    kernel(_name, sig="t", returns="text")(_apply)


def _together(name: str, f) -> None:
    def apply(*texts: str) -> str:
        parts = [parse_complex(t) for t in texts]
        out = parts[0][0]
        for z, _ in parts[1:]:
            out = f(out, z)
        return show_complex(out, next((u for z, u in parts if z.imag), parts[0][1]))

    kernel(name, sig="tt" if name in ("IMSUB", "IMDIV") else "t*", returns="text")(apply)


_together("IMSUM", lambda a, b: a + b)
_together("IMSUB", lambda a, b: a - b)
_together("IMPRODUCT", lambda a, b: a * b)
_together("IMDIV", lambda a, b: a / b)


@kernel("IMPOWER", sig="tn", returns="text")
def impower(t: str, n: float) -> str:
    z, unit = parse_complex(t)
    _need(z != 0 or n > 0)
    return show_complex(z**int(n) if n == int(n) and abs(n) < 64 else z**n, unit)


# -- Bessel functions: integrals over a period, which the trapezoidal rule gives to full precision -----------


def _period(f, terms: int) -> float:
    """Mean of an even, smooth function of period 2 pi over half a period."""
    return math.fsum([(f(0.0) + f(math.pi)) / 2, *(f(math.pi * k / terms) for k in range(1, terms))]) / terms


@kernel("BESSELJ", sig="nn")
def besselj(x: float, n: float) -> float:
    n = int(n)
    _need(n >= 0)
    return _period(lambda t: math.cos(n * t - x * math.sin(t)), 64 + 2 * int(abs(x)) + 2 * n)


@kernel("BESSELI", sig="nn")
def besseli(x: float, n: float) -> float:
    n = int(n)
    _need(n >= 0)
    if abs(x) < 10:
        half, term, total = x / 2, (x / 2) ** n / math.factorial(n), 0.0
        for k in range(1, 200):
            total += term
            term *= half * half / (k * (k + n))
        return total
    return _period(lambda t: math.exp(x * math.cos(t)) * math.cos(n * t), 96 + 2 * int(abs(x)) + 2 * n)


def _simpson(f, low: float, high: float, n: int) -> float:
    h = (high - low) / n
    return h / 3 * math.fsum([f(low), f(high), *((4 if k % 2 else 2) * f(low + k * h) for k in range(1, n))])


@kernel("BESSELK", sig="nn")
def besselk(x: float, n: float) -> float:
    """The integral of exp(-x cosh t) cosh(n t), whose integrand falls off doubly exponentially."""
    n = int(n)
    _need(n >= 0, x > 0)
    high = math.acosh(1 + 750 / x)
    return _simpson(lambda t: math.exp(-x * math.cosh(t)) * math.cosh(n * t) if x * math.cosh(t) - n * t < 740 else 0.0, 0.0, high, 4000)


@kernel("BESSELY", sig="nn")
def bessely(x: float, n: float) -> float:
    """From the integral form: an oscillating part over half a period and a falling one."""
    n = int(n)
    _need(n >= 0, x > 0)
    if n > 1:
        a, b = bessely(x, 0), bessely(x, 1)
        for k in range(1, n):
            a, b = b, 2 * k / x * b - a
        return b
    first = _simpson(lambda t: math.sin(x * math.sin(t) - n * t), 0.0, math.pi, 4000)
    high = math.asinh(750 / x)
    second = _simpson(lambda t: (math.exp(n * t) + (-1) ** n * math.exp(-n * t)) * math.exp(-x * math.sinh(t)), 0.0, high, 20000)
    return (first - second) / math.pi


# -- units ---------------------------------------------------------------------------------------

# Size of each unit in metres or grams.
_LENGTH = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254}
_MASS = {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lbm": 453.59237, "ozm": 28.349523125}
_DEGREES = {"C": (1.0, 273.15), "K": (1.0, 0.0), "F": (5 / 9, 459.67 * 5 / 9)}


@kernel("CONVERT", sig="ntt", err="#N/A")
def convert(x: float, a: str, b: str) -> float:
    for units in (_LENGTH, _MASS):
        if a in units and b in units:
            return x * units[a] / units[b]
    if a in _DEGREES and b in _DEGREES:
        if a == b:
            return x
        (scale, zero), (scale2, zero2) = _DEGREES[a], _DEGREES[b]
        return (x * scale + zero - zero2) / scale2
    raise FormulaError("#N/A")
