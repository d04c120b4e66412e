"""The function library: each name with its signature, kind and builder of Spark Columns.

A signature has one letter for each argument: n number, t text, b truth value, d date, a as it is, r range,
o range as an array in its order.
Arguments after ``|`` may be left out; a final ``*`` repeats the one before. Kinds:

- scalar: Columns to a Column, all in the JVM;
- kernel: a function of NumPy arrays (``vector``) or of plain values, run over Arrow batches;
- agg: Columns of a range to an aggregate Column;
- fold: a Python function of a range's numbers in order, over an aggregated array.

``err`` is the error a value of NULL stands for when no argument was in error.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT = {"num": "double", "text": "string", "bool": "boolean", "int": "bigint", "date": "double", "any": "string", "array": "array<double>", "matrix": "array<array<double>>"}


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    signature: str
    build: Callable[..., Column]
    returns: str
    err: str

    @property
    def required(self) -> str:
        return self.signature.split("|")[0].rstrip("*")

    def letters(self, n: int) -> str:
        """One letter for each of n arguments; raises TypeError when they don't fit."""
        plain = self.signature.replace("|", "")
        if plain.endswith("*"):
            plain = plain[:-1]
            plain += plain[-1] * max(0, n - len(plain))
        if not len(self.required) <= n <= len(plain):
            raise TypeError(f"{self.name} takes {self.signature or 'no'} arguments, got {n}")
        return plain[:n]


FUNCTIONS: dict[str, Function] = {}


def constant(value: float | str) -> Column:
    """A literal that builders can look into with ``known``."""
    x = F.lit(value)
    x.__dict__["_known"] = value
    return x


def known(x: Column) -> object | None:
    """The value of an argument that is a literal of the formula, else None."""
    return x.__dict__.get("_known")


def _filled(build: Callable[..., Column], signature: str) -> Callable[..., Column]:
    """The builder with left-out arguments given as literals of their defaults (modules load without a session)."""
    parameters = [p for p in inspect.signature(build).parameters.values() if p.kind is p.POSITIONAL_OR_KEYWORD]
    parameters = parameters[: len(signature.replace("|", "").rstrip("*"))]

    def full(*args: Column) -> Column:
        rest = [p.default for p in parameters[len(args) :]]
        if not any(d is not None and d is not inspect.Parameter.empty and isinstance(d, (int, float, str)) for d in rest):
            return build(*args)
        return build(*args, *(constant(d) if isinstance(d, (int, float, str)) else d for d in rest if d is not inspect.Parameter.empty))

    return full


def _add(names: tuple[str, ...], kind: str, signature: str, build: Callable[..., Column], returns: str, err: str) -> None:
    for name in names:
        if name in FUNCTIONS:
            raise ValueError(f"{name} is defined twice")
        FUNCTIONS[name] = Function(name, kind, signature, build, returns, err)


def scalar(*names: str, sig: str = "n", returns: str = "num", err: str = "#NUM!"):
    def wrap(build):
        _add(names, "scalar", sig, _filled(build, sig), returns, err)
        return build

    return wrap


def aggregate(*names: str, sig: str = "r*", returns: str = "num", err: str = "#NUM!"):
    def wrap(build):
        _add(names, "agg", sig, _filled(build, sig), returns, err)
        return build

    return wrap


class FormulaError(Exception):
    """A formula's error value, such as #NUM!."""


def _plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") and not hasattr(x, "__len__") else x


def _alike(columns: tuple[pd.Series, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct list of arguments, and which of them each row has; floats are told apart by their bits."""
    code = np.zeros(len(columns[0]), dtype="int64")
    for c in columns:
        own = pd.factorize(c.to_numpy().view("int64") if c.dtype == "float64" else c)[0] + 1
        code = pd.factorize(code * (own.max(initial=0) + 1) + own)[0]
    return np.unique(code, return_index=True)[1], code


def arrow_udf(function: Callable, returns: str) -> Callable[..., Column]:
    """A pandas UDF that applies a function of plain values; errors and NULL arguments give NULL.

    Of each batch the function sees a list of arguments once: a formula's literals come with every row.
    """

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        # Arrays have no hash.
        lists = any(hasattr(x, "__len__") and not isinstance(x, str) for c in columns if c.dtype == "object" for x in c)
        firsts, code = (None, None) if lists else _alike(columns)
        for row in zip(*(columns if lists else (c.iloc[firsts] for c in columns)), strict=True):
            try:
                values = [_plain(x) for x in row]
                found = None if any(v is None for v in values) else function(*values)
                out.append(None if isinstance(found, float) and not abs(found) < float("inf") else found)
            except (FormulaError, ArithmeticError, ValueError, IndexError):
                out.append(None)
        out = pd.Series(out, dtype="float64" if returns in ("num", "date") else "object")
        return out if lists else out.take(code).reset_index(drop=True)

    def first(a: pd.Series, *rest: pd.Series) -> pd.Series:
        return run(a, *rest)

    return F.pandas_udf(first, RESULT[returns])


def kernel(*names: str, sig: str = "n", returns: str = "num", err: str = "#NUM!"):
    def wrap(function):
        udf: list[Callable[..., Column]] = []

        def build(*columns: Column) -> Column:
            if not udf:
                udf.append(arrow_udf(function, returns))
            return udf[0](*columns)

        _add(names, "kernel", sig, build, returns, err)
        return function

    return wrap


def vector(*names: str, sig: str = "n", returns: str = "num", err: str = "#NUM!"):
    """A function of whole NumPy arrays, one for each argument: an Arrow batch at a time; NaN stands for its error."""

    def wrap(function):
        def run(first: pd.Series, *rest: pd.Series) -> pd.Series:
            columns = [np.asarray(c.astype("float64"), dtype="float64") for c in (first, *rest)]
            with np.errstate(all="ignore"):
                out = np.array(np.broadcast_to(function(*columns), columns[0].shape), dtype="float64")
            out[~np.isfinite(out) | np.isnan(columns).any(axis=0)] = np.nan
            return pd.Series(out)

        udf: list[Callable[..., Column]] = []

        def build(*columns: Column) -> Column:
            if not udf:
                udf.append(F.pandas_udf(run, RESULT[returns]))
            return udf[0](*columns)

        _add(names, "kernel", sig, build, returns, err)
        return function

    return wrap


def fold(*names: str, sig: str = "r", returns: str = "num", err: str = "#NUM!"):
    """A function of ordered lists of numbers, one for each range argument, and plain values."""

    def wrap(function):
        def build(*columns: Column) -> Column:
            return arrow_udf(lambda *v: function(*(list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in v)), returns)(*columns)

        _add(names, "fold", sig, build, returns, err)
        return function

    return wrap


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def round15(x: Column) -> Column:
    """The number with fifteen significant digits."""
    exponent = F.lit(14) - F.floor(F.log10(F.abs(x))).cast("int")
    factor = F.pow(F.lit(10.0), exponent)
    return F.when(x == 0, F.lit(0.0)).when(F.abs(exponent) > 290, x).otherwise(F.rint(x * factor) / factor)


def fn(name: str) -> Callable[..., Column]:
    """The builder of a function by name, for use on Columns directly."""
    return FUNCTIONS[name.upper()].build


def register(name: str, build: Callable[..., Column], signature: str = "a*", returns: str = "num", err: str = "#VALUE!") -> None:
    """Add a user's function (of Columns, pandas UDFs included) that formulas can then call."""
    _add((name.upper(),), "scalar", signature, build, returns, err)
