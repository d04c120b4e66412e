"""Criteria such as ">5", "<>x" or "a*" as predicates that the optimizer can push down."""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = ("<=", ">=", "<>", "<", ">", "=")


def wildcard_regex(pattern: str) -> str | None:
    """A regular expression for a pattern with * ? and ~ escapes; None when there is none of them."""
    if not re.search(r"[*?~]", pattern):
        return None
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            out += re.escape(pattern[i + 1])
            i += 1
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?is)^{out}$"


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


#: Case variants that an equality of text lists, so that it reaches the scan.
_VARIANTS = 64


def same_text(column: Column, bound: str) -> Column:
    """Equality without regard to case, as a list of all case variants where these are few; NULL for NULL."""
    low = bound.lower()
    if low.isascii():
        # The Kelvin sign is the one further character whose lower case is an ASCII letter.
        letters = [dict.fromkeys((c, c.upper(), *("\u212a" * (c == "k")))) for c in low]
        if math.prod(map(len, letters)) <= _VARIANTS:
            return column.isin(["".join(x) for x in itertools.product(*letters)])
    return F.lower(column) == F.lit(low)


def criterion(column: Column, dtype: str, value: float | str | bool | None) -> Column:
    """Rows of a column (dtype: num, text, bool or date) that meet a literal criterion; NULL counts as not met.

    Numbers are compared with numbers only; text is equal without regard to case, * and ? stand for any
    characters. A bound of an order comparison that is no number counts as 0. Blanks meet only "=", "" and "<>…".
    """
    if dtype == "mixed":
        number = column.try_cast("double")
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return criterion(number, "num", value)
        text = str(value or "")
        op = next((o for o in _OPS if text.startswith(o)), "")
        if op in ("<", ">", "<=", ">=") or _number(text[len(op) :]) is not None:
            return criterion(number, "num", text)
        return criterion(column, "text", text)
    if value is None:
        value = ""
    if isinstance(value, bool):
        return column == F.lit(value) if dtype == "bool" else F.lit(False)
    if not isinstance(value, str):
        return column == F.lit(float(value)) if dtype in ("num", "date") else F.lit(False)
    op = next((o for o in _OPS if value.startswith(o)), "")
    bound = value[len(op) :]
    number = _number(bound)
    if op in ("<", ">", "<=", ">="):
        if dtype == "date" and number is None and bound:
            return _compare(op, column, F.lit(bound).cast("timestamp"))
        if dtype not in ("num", "date"):
            return F.lit(False)
        return _compare(op, column, F.lit(number if number is not None else 0.0))
    if bound == "":
        blank = column.isNull() | (column == "") if dtype == "text" else column.isNull()
        return ~blank if op == "<>" else blank
    if dtype == "bool":
        equal = column == F.lit(bound.upper() == "TRUE") if bound.upper() in ("TRUE", "FALSE") else F.lit(False)
    elif dtype in ("num", "date") and number is not None:
        equal = column == F.lit(number)
    elif dtype == "text":
        regex = wildcard_regex(bound)
        equal = column.rlike(regex) if regex else same_text(column, bound)
    else:
        equal = F.lit(False)
    return column.isNull() | ~equal if op == "<>" else equal


def correlated(column: Column, dtype: str, value: Column) -> Column:
    """Rows equal to a value of another row: what becomes an equality join."""
    return F.lower(column) == F.lower(value) if dtype == "text" else column == value
