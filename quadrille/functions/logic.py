"""Logical and information functions on typed values. Error tests are forms of the compiler."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.registry import scalar

_L = F.lit

scalar("TRUE", sig="", returns="bool")(lambda: _L(True))
scalar("FALSE", sig="", returns="bool")(lambda: _L(False))
scalar("NA", sig="", returns="num", err="#N/A")(lambda: _L(None).cast("double"))
scalar("NOT", sig="b", returns="bool", err="#VALUE!")(lambda b: ~b)
scalar("ISEVEN", returns="bool", err="#VALUE!")(lambda n: F.pmod(_towards(n), _L(2.0)) == 0)
scalar("ISODD", returns="bool", err="#VALUE!")(lambda n: F.pmod(_towards(n), _L(2.0)) == 1)
scalar("DELTA", sig="n|n")(lambda a, b=0.0: (a == b).cast("double"))
scalar("GESTEP", sig="n|n")(lambda a, b=0.0: (a >= b).cast("double"))
scalar("AREAS", sig="a")(lambda _: _L(1.0))
scalar("HYPERLINK", sig="t|t", returns="text")(lambda link, name=None: link if name is None else F.coalesce(name, link))


def _towards(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x))


@scalar("ADDRESS", sig="nn|nbt", returns="text", err="#VALUE!")
def address(row: Column, col: Column, kind: Column = 1, a1: Column = True, sheet: Column | None = None) -> Column:
    """A cell's address: kind 1 both absolute, 2 row, 3 column, 4 neither."""
    c = F.floor(col).cast("int")
    letter = lambda x: F.call_function("chr", x + 65)
    first = F.when(c > 702, letter(F.floor((c - 703) / 676).cast("int"))).otherwise(_L(""))
    second = F.when(c > 26, letter(F.pmod(F.floor((c - 27) / 26), _L(26)).cast("int"))).otherwise(_L(""))
    name = F.concat(first, second, letter(F.pmod(c - 1, _L(26)).cast("int")))
    r = F.floor(row).cast("bigint").cast("string")
    col_mark, row_mark = F.when(kind.isin(1, 3), "$").otherwise(""), F.when(kind.isin(1, 2), "$").otherwise("")
    local = F.when(a1, F.concat(col_mark, name, row_mark, r)).otherwise(F.concat(_L("R"), r, _L("C"), c.cast("string")))
    text = local if sheet is None else F.concat(sheet, _L("!"), local)
    return F.when((row >= 1) & col.between(1, 16384), text)


def all_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, _L(True))


def any_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, _L(False))


scalar("AND", sig="b*", returns="bool", err="#VALUE!")(lambda *b: all_true(*(F.coalesce(x, _L(False)) for x in b)))
scalar("OR", sig="b*", returns="bool", err="#VALUE!")(lambda *b: any_true(*(F.coalesce(x, _L(False)) for x in b)))
scalar("XOR", sig="b*", returns="bool", err="#VALUE!")(lambda *b: reduce(lambda x, y: x != y, (F.coalesce(x, _L(False)) for x in b)))

# Functions of services that are not there: always the error.
for _name in ("STOCKHISTORY", "RTD", "CUBEKPIMEMBER", "CUBEMEMBER", "CUBEMEMBERPROPERTY", "CUBERANKEDMEMBER", "CUBESET", "CUBESETCOUNT", "CUBEVALUE"):
    scalar(_name, sig="|a*", err="#N/A")(lambda *_: _L(None).cast("double"))
for _name in ("WEBSERVICE", "IMAGE"):
    scalar(_name, sig="|a*", err="#VALUE!")(lambda *_: _L(None).cast("double"))
