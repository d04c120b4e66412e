"""Syntax trees to Spark Columns and DataFrames.

A formula is compiled against a catalogue of tables and, for a filled-down formula, a current table. In it:

- ``[@c]``, and a range of the current table, is the row's value;
- an aggregate of ranges is an aggregate Column in a grouping, and a scalar subquery anywhere else, so a plan
  may mix rows with totals of any table; values of the current row inside it correlate the subquery, which
  Catalyst turns into one aggregation and one join (a SUMIFS per row is never a loop);
- lookups are first-match subqueries, or as-of joins for sorted keys of each row;
- LET is substitution, LAMBDA a higher-order function's body.

Values carry an error lane: a Column that holds an error code or NULL. Errors of arguments come first, in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import FUNCTIONS
from quadrille.functions.dates import from_serial, moment_of, networkdays, or_zero, to_serial, workday
from quadrille.functions.registry import finite
from quadrille.functions.text import display, text_format
from quadrille.operators.ordinals import numbered, running_total
from quadrille.plans import formula as fx
from quadrille.plans.criteria import correlated, criterion, same_text


class CompileError(ValueError):
    """A formula that has no plan, such as an unknown name or a cycle."""


def type_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.ArrayType):
        return "array"
    return "text"


#: Metadata of a text column that stands for cells of several kinds; its numbers count as numbers.
MIXED = "mixed"


@dataclass(frozen=True)
class Table:
    """A named DataFrame; ``order`` names the columns that give its rows their order (unique together)."""

    name: str
    df: DataFrame
    order: tuple[str, ...] = ()
    letters: bool = False
    totals: dict[str, str] = field(default_factory=dict)
    formulas: dict[str | tuple[int, str], str] = field(default_factory=dict)  # text by column, or by row and column
    whole: DataFrame | None = None  # where df is a part that refers to rows outside and so has no schema yet

    @property
    def shape(self) -> DataFrame:
        return self.df if self.whole is None else self.whole

    def column(self, name: str) -> str:
        found = [c for c in self.shape.columns if c.lower() == name.lower()]
        if not found:
            raise CompileError(f"#REF! {self.name} has no column {name!r}")
        return found[0]

    def dtype(self, name: str) -> str:
        f = self.shape.schema[name]
        return MIXED if f.metadata.get(MIXED) else type_of(f.dataType)

    @property
    def visible(self) -> list[str]:
        return [c for c in self.shape.columns if c != "_r"]


@dataclass(frozen=True)
class Value:
    col: Column
    type: str
    err: Column | None = None
    literal: bool = False
    py: object = None
    frame: DataFrame | None = None  # one row, column v: where the value is a subquery's array


def over(v: Value, f: Callable[[Column], Column], kind: str = "array") -> Value:
    """f of an array value; of a subquery's array inside the subquery, as lambdas cannot hold one."""
    if v.frame is None:
        return Value(f(v.col), kind, v.err)
    return in_frame(v.frame.select(f(F.col("v")).alias("v")), kind, v.err)


def in_frame(frame: DataFrame, kind: str = "array", err: Column | None = None) -> Value:
    return Value(frame.scalar(), kind, err, frame=frame)


def _first_error(values: list[Value], own: Column | None = None) -> Column | None:
    errors = [v.err for v in values if v.err is not None] + ([own] if own is not None else [])
    return F.coalesce(*errors) if len(errors) > 1 else errors[0] if errors else None


def as_number(v: Value) -> Column:
    if v.type == "num":
        return v.col.cast("double") if not v.literal else v.col
    if v.type == "bool":
        return v.col.cast("double")
    if v.type == "date":
        return to_serial(v.col)
    return F.trim(v.col).try_cast("double")


def as_text(v: Value) -> Column:
    if v.type in ("text", MIXED):
        return F.coalesce(v.col, F.lit("")) if v.err is None else v.col
    if v.type == "bool":
        return F.when(v.col, "TRUE").when(~v.col, "FALSE")
    if v.type == "date":
        return display(to_serial(v.col))
    if v.type == "array":
        # Whole numbers of an array are shown without a point.
        return F.array_join(F.transform(v.col, lambda x: F.regexp_replace(x.cast("string"), r"^(-?[0-9]+)\.0$", "$1")), ", ")
    return display(v.col.cast("double"))


def as_bool(v: Value) -> Column:
    if v.type == "bool":
        return v.col
    if v.type in ("text", MIXED):
        t = F.upper(F.trim(v.col))
        return F.when(t == "TRUE", True).when(t == "FALSE", False).otherwise(t.try_cast("double") != 0)
    return F.coalesce(as_number(v), F.lit(0.0)) != 0


def coerced(v: Value, letter: str) -> Column:
    if letter in "nd":
        # A blank counts as zero; text that is no number stays NULL.
        x = as_number(v)
        if v.literal and isinstance(v.py, (int, float)) and not isinstance(v.py, bool):
            x.__dict__["_known"] = float(v.py)
        return x if v.literal or v.err is not None or v.type in ("text", MIXED) else or_zero(x)
    out = {"t": as_text, "b": as_bool}.get(letter, lambda v: v.col)(v)
    if letter == "t" and v.literal and isinstance(v.py, str):
        out.__dict__["_known"] = v.py
    return out


@dataclass
class Near:
    """An approximate lookup by a key of each row; lookups of one key in one column share it, and so one join."""

    name: str
    key: Column
    rows: DataFrame
    x: Column
    order: Column
    below: bool
    values: list[Column] = field(default_factory=list)

    def right(self) -> DataFrame:
        """One row a key: of equal keys the last below, the first above."""
        pick = F.max_by if self.below else F.min_by
        hit = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(self.values)))
        return self.rows.where(self.x.isNotNull()).groupBy(self.x.alias("_key")).agg(pick(hit, self.order).alias("_hit"))


@dataclass
class Context:
    tables: dict[str, Table]
    current: Table | None = None
    grouped: bool = False
    names: dict[str, Value] = field(default_factory=dict)
    pivots: dict[str, tuple[DataFrame, object]] = field(default_factory=dict)  # cells and spec by name
    outer: set[str] = field(default_factory=set)  # columns of the row outside that a subquery on the same table uses
    scope: Table | None = None  # the table whose rows an aggregate's argument ranges over
    near: dict[tuple, Near] = field(default_factory=dict)  # approximate lookups of each row, to be joined
    means: dict[str, Column] | None = None  # what AVEDEV needs the group's mean of, to be joined; None where nothing joins it

    def table(self, name: str | None) -> Table:
        if name is None:
            if self.current is None:
                raise CompileError("#REF! no current table for [@…]")
            return self.current
        found = self.tables.get(name.lower())
        if found is None:
            raise CompileError(f"#REF! unknown table {name!r}")
        return found


# The errors in the order of their numbers.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")
_SUBTOTAL = ("AVERAGE", "COUNT", "COUNTA", "MAX", "MIN", "PRODUCT", "STDEV.S", "STDEV.P", "SUM", "VAR.S", "VAR.P")
_AGGREGATE = (*_SUBTOTAL, "MEDIAN", "MODE.SNGL", "LARGE", "SMALL", "PERCENTILE.INC", "QUARTILE.INC", "PERCENTILE.EXC", "QUARTILE.EXC")
_CONDITIONAL = {"SUMIF": "SUM", "SUMIFS": "SUM", "COUNTIF": "COUNT", "COUNTIFS": "COUNT", "AVERAGEIF": "AVERAGE", "AVERAGEIFS": "AVERAGE", "MAXIFS": "MAX", "MINIFS": "MIN"}
_DATABASE = {"DAVERAGE": "AVERAGE", "DCOUNT": "COUNT", "DCOUNTA": "COUNTA", "DMAX": "MAX", "DMIN": "MIN", "DPRODUCT": "PRODUCT", "DSTDEV": "STDEV.S", "DSTDEVP": "STDEV.P", "DSUM": "SUM", "DVAR": "VAR.S", "DVARP": "VAR.P"}
_ORDER_STATISTICS = ("AVEDEV", "LARGE", "SMALL", "PERCENTILE.EXC", "QUARTILE.EXC", "TRIMMEAN")
_TEXT_AS_ZERO = ("AVERAGEA", "MAXA", "MINA", "STDEVA", "STDEVPA", "VARA", "VARPA")


#: Comparisons, and what each is with its sides exchanged.
_MIRROR = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def _is_truth(node: fx.Node) -> bool:
    """Whether a formula's value is a truth value, or a product or sum of some, and so never negative."""
    if isinstance(node, fx.Binary):
        return node.op in _MIRROR or (node.op in ("*", "+") and _is_truth(node.left) and _is_truth(node.right))
    return isinstance(node, fx.Call) and node.name in ("AND", "OR") and all(map(_is_truth, node.args))


class Compiler:
    def __init__(self, context: Context):
        self.ctx = context

    # -- references ------------------------------------------------------------------------------

    def range_of(self, node: fx.Node) -> tuple[Table, list[str], Column | None]:
        """Table, columns and row condition of a range."""
        if isinstance(node, fx.Structured):
            table = self.ctx.table(node.table)
            if not node.columns:
                return table, table.visible, None
            if len(node.columns) == 3 and node.columns[1] == ":":
                names = table.visible
                a, b = sorted(names.index(table.column(node.columns[i])) for i in (0, 2))
                return table, names[a : b + 1], None
            return table, [table.column(c) for c in node.columns], None
        if isinstance(node, fx.Name) and node.name.lower() in self.ctx.tables:
            table = self.ctx.table(node.name)
            return table, table.visible, None
        if isinstance(node, fx.CellRange):
            table = self.ctx.table(node.sheet) if node.sheet else self.ctx.current or next(iter(self.ctx.tables.values()))
            names = table.visible
            at = lambda s: sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(s))) - 1
            a, b = (0, len(names) - 1) if node.first is None else (at(node.first), min(at(node.last), len(names) - 1))
            if a >= len(names):
                raise CompileError(f"#REF! {table.name} has {len(names)} columns")
            rows = None if node.top is None else F.col("_r").between(node.top, node.bottom)
            return table, names[a : b + 1], rows
        raise CompileError("#REF! a range is needed")

    def is_range(self, node: fx.Node) -> bool:
        if isinstance(node, fx.Structured):
            column = not node.this_row or (self.ctx.grouped and self.ctx.scope is None)
            return column and node.part in ("data", "all")
        if isinstance(node, fx.Name):
            return node.name.lower() in self.ctx.tables and node.name.lower() not in self.ctx.names
        return isinstance(node, fx.CellRange) and not (node.single and self.ctx.scope is None)

    def tables_in(self, node: fx.Node) -> list[Table]:
        found = []
        for r in fx.references(node):
            if self.is_range(r):
                t = self.range_of(r)[0]
                if all(t.name != x.name for x in found):
                    found.append(t)
        return found

    def row_value(self, table: Table, name: str) -> Value:
        """A column of the row at hand; of the row outside, in a subquery."""
        dtype = table.dtype(name)
        inside = self.ctx.scope is not None and self.ctx.scope.name == table.name
        column = F.col(f"`{name}`")
        if self.ctx.scope is not None and not inside:
            column = column.outer()
        return Value(column, dtype)

    # -- entry points ----------------------------------------------------------------------------

    def value(self, node: fx.Node) -> Value:
        match node:
            case fx.Literal(None):
                return Value(F.lit(None).cast("double"), "num", literal=True, py=None)
            case fx.Literal(v):
                kind = "bool" if isinstance(v, bool) else "num" if isinstance(v, float) else "text"
                return Value(F.lit(v), kind, literal=True, py=v)
            case fx.ErrorValue(code):
                return Value(F.lit(None).cast("double"), "num", F.lit(code))
            case fx.Array(rows):
                items = [self.value(x) for r in rows for x in r]
                kind = "text" if any(v.type == "text" for v in items) else "num"
                return Value(F.array(*(as_text(v) if kind == "text" else as_number(v) for v in items)), "array", _first_error(items))
            case fx.Name(name):
                if name.lower() in self.ctx.names:
                    return self.ctx.names[name.lower()]
                if self.is_range(node):
                    return self.range_value(node)
                raise CompileError(f"#NAME? {name}")
            case fx.Structured() if node.part == "headers":
                table = self.ctx.table(node.table)
                return Value(F.lit(table.column(node.columns[0])), "text", literal=True, py=table.column(node.columns[0]))
            case fx.Structured() if node.part == "totals":
                table = self.ctx.table(node.table)
                total = table.totals.get(table.column(node.columns[0]))
                if total is None:
                    return Value(F.lit(None).cast("double"), "num")
                return self.value(fx.parse(total))
            case fx.Structured() if node.this_row:
                table = self.ctx.table(node.table)
                saved, inner = self.ctx.current, table.column(node.columns[0])
                if saved is not None and table.name == saved.name and self.ctx.scope is not None:
                    if self.ctx.scope.name != table.name:
                        return Value(F.col(f"`{inner}`").outer(), table.dtype(inner))
                    # Under its own name it would be the inner row's; with_columns adds it under this one.
                    self.ctx.outer.add(inner)
                    return Value(F.col(f"`_outer_{inner}`").outer(), table.dtype(inner))
                return self.row_value(table, inner)
            case fx.Structured() | fx.CellRange():
                return self.range_value(node)
            case fx.Unary("-", fx.Literal(float(x))):
                return Value(F.lit(-x), "num", literal=True, py=-x)
            case fx.Unary(op, arg):
                v = self.value(arg)
                x = as_number(v)
                return Value({"-": -x, "+": v.col, "%": x / 100}[op], v.type if op == "+" else "num", self.lane(v, x))
            case fx.Binary(op, a, b):
                return self.binary(op, self.value(a), self.value(b))
            case fx.Call():
                return self.call(node)
        raise CompileError(f"cannot compile {node!r}")

    def lane(self, v: Value, number: Column) -> Column | None:
        own = F.when(number.isNull() & v.col.isNotNull(), F.lit("#VALUE!")) if v.type == "text" else None
        return _first_error([v], own)

    def range_value(self, node: fx.Node) -> Value:
        table, columns, rows = self.range_of(node)
        here = self.ctx.scope or self.ctx.current
        if here is not None and here.name == table.name and len(columns) == 1:
            v = Value(F.col(f"`{columns[0]}`"), table.dtype(columns[0]))
            return v if rows is None else replace(v, col=F.when(rows, v.col))
        if isinstance(node, fx.CellRange) and node.single:
            one = table.df.where(rows).select(F.first(F.col(f"`{columns[0]}`"))).scalar()
            return Value(one, table.dtype(columns[0]))
        return self.array_of(node)

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op == "&":
            return Value(F.concat(as_text(a), as_text(b)), "text", _first_error([a, b]))
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return Value(self.compare(op, a, b), "bool", _first_error([a, b]))
        x, y = coerced(a, "n"), coerced(b, "n")
        bad = [F.when(n.isNull() & v.col.isNotNull(), F.lit("#VALUE!")) for v, n in ((a, x), (b, y)) if v.type == "text"]
        args = F.coalesce(*bad) if bad else None
        if op == "/":
            out, own = F.try_divide(x, y), F.when(y == 0, F.lit("#DIV/0!"))
        elif op == "^":
            out = FUNCTIONS["^"].build(x, y)
            own = F.when((x == 0) & (y < 0), F.lit("#DIV/0!")).when(out.isNull() & x.isNotNull() & y.isNotNull(), F.lit("#NUM!"))
        else:
            out, own = {"+": x + y, "-": x - y, "*": x * y}[op], None
        return Value(out, "num", _first_error([a, b], F.coalesce(*(e for e in (args, own) if e is not None)) if args is not None or own is not None else None))

    def compare(self, op: str, a: Value, b: Value) -> Column:
        """Blank counts as the other side's empty value; number < text < truth value; text without case, hyphens last."""
        rank = {"num": 1, "date": 1, "text": 2, "bool": 3, "array": 2}
        # A cell of any kind is taken as what it is compared with.
        if MIXED in (a.type, b.type):
            other = ({a.type, b.type} - {MIXED} or {"text"}).pop()
            as_other = {"num": as_number, "date": as_number, "bool": as_bool}.get(other, as_text)
            a, b = (Value(as_other(v), "num" if other == "date" else other, v.err) if v.type == MIXED else v for v in (a, b))
        if rank[a.type] != rank[b.type]:
            if a.literal and a.py is None or b.literal and b.py is None:
                a, b = (replace(v, type=w.type, col=F.lit({"text": "", "bool": False}.get(w.type, 0.0))) if v.literal and v.py is None else v for v, w in ((a, b), (b, a)))
            else:
                x, y = F.lit(rank[a.type]), F.lit(rank[b.type])
                return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if a.type == "text" and b.type == "text":
            x, y = (F.lower(F.coalesce(v.col, F.lit(""))) for v in (a, b))
            if op not in ("=", "<>"):
                x, y = (F.struct(F.replace(t, F.lit("-"), F.lit("")).alias("a"), t.alias("b")) for t in (x, y))
        elif a.type == b.type == "bool":
            x, y = (F.coalesce(v.col, F.lit(False)) for v in (a, b))
        elif a.type == b.type == "date":
            x, y = a.col, b.col
        else:
            x, y = (F.coalesce(as_number(v), F.lit(0.0)) if not v.literal else as_number(v) for v in (a, b))
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]

    def filter_condition(self, node: fx.Node) -> Column:
        """A formula as a filter's condition, in which NULL counts as false: products of truth values become AND,
        sums OR, and comparisons of a column with a literal stay bare, so that they reach the scan."""
        if isinstance(node, fx.Binary) and node.op in ("*", "+") and _is_truth(node.left) and _is_truth(node.right) and self.value(node).err is None:
            a, b = self.filter_condition(node.left), self.filter_condition(node.right)
            return a & b if node.op == "*" else a | b
        if isinstance(node, fx.Call) and node.name in ("AND", "OR") and all(map(_is_truth, node.args)) and all(self.value(x).err is None for x in node.args):
            parts = [self.filter_condition(x) for x in node.args]
            return reduce(lambda a, b: a & b if node.name == "AND" else a | b, parts)
        if isinstance(node, fx.Binary) and node.op in _MIRROR:
            a, b, op = self.value(node.left), self.value(node.right), node.op
            if a.literal and not b.literal:
                a, b, op = b, a, _MIRROR[op]
            if b.literal and not a.literal and a.err is None:
                if a.type == b.type == "num" and isinstance(b.py, (int, float)):
                    bare = {"=": a.col == b.col, "<>": a.col != b.col, "<": a.col < b.col, ">": a.col > b.col, "<=": a.col <= b.col, ">=": a.col >= b.col}[op]
                    # A blank counts as zero.
                    return bare | a.col.isNull() if {"=": 0 == b.py, "<>": 0 != b.py, "<": 0 < b.py, ">": 0 > b.py, "<=": 0 <= b.py, ">=": 0 >= b.py}[op] else bare
                if a.type == b.type == "text" and isinstance(b.py, str) and b.py and op in ("=", "<>"):
                    same = same_text(a.col, b.py)
                    return same if op == "=" else a.col.isNull() | ~same
        v = self.value(node)
        return v.col.cast("boolean") if v.type == "bool" else v.col != 0

    # -- arrays ----------------------------------------------------------------------------------

    def array_of(self, node: fx.Node) -> Value:
        """An array value; of a range, its non-blank elements in order, which suits ranges of a spreadsheet's size."""
        if not self.is_range(node):
            v = self.value(node)
            return v if v.type == "array" else replace(v, col=F.array(v.col), type="array")
        table, columns, rows = self.range_of(node)
        df = table.df if rows is None else table.df.where(rows)
        collected = self.ordered(table, F.col(f"`{columns[0]}`") if len(columns) == 1 else F.array(*(F.col(f"`{c}`") for c in columns)))
        if len(columns) > 1:
            collected = F.flatten(collected)
        if self.ctx.grouped:
            return Value(collected, "array")
        return in_frame(df.select(collected.alias("v")))

    def resolved(self, node: fx.Node) -> fx.Node:
        """INDIRECT and OFFSET as the references they are."""
        if isinstance(node, fx.Call) and node.name in ("INDIRECT", "OFFSET"):
            return {"INDIRECT": indirect, "OFFSET": offset}[node.name](self, *node.args)
        return node

    @staticmethod
    def ordered(table: Table, x: Column) -> Column:
        if not table.order:
            return F.collect_list(x)
        pairs = F.collect_list(F.when(x.isNotNull(), F.struct(*(F.col(f"`{c}`") for c in table.order), x.alias("_x"))))
        return F.transform(F.array_sort(pairs), lambda p: p["_x"])

    def lambda_of(self, node: fx.Node) -> tuple[list[str], fx.Node]:
        if not (isinstance(node, fx.Call) and node.name == "LAMBDA"):
            raise CompileError("#VALUE! a LAMBDA is needed")
        return [a.name.lower() for a in node.args[:-1]], node.args[-1]

    def bound(self, names: list[str], values: list[Value], body: fx.Node) -> Value:
        saved = self.ctx.names
        self.ctx.names = saved | dict(zip(names, values, strict=False))
        try:
            return self.value(body)
        finally:
            self.ctx.names = saved

    # -- calls -----------------------------------------------------------------------------------

    def call(self, node: fx.Call) -> Value:
        name, args = node.name, node.args
        special = _FORMS.get(name)
        if special:
            return special(self, *args)
        if name in _CONDITIONAL:
            return self.conditional(name, args)
        if name in _DATABASE:
            return self.database(_DATABASE[name], args)
        if name in ("SUBTOTAL", "AGGREGATE"):
            number = int(self.value(args[0]).py)
            table = _SUBTOTAL if name == "SUBTOTAL" else _AGGREGATE
            number = number % 100 if name == "SUBTOTAL" else number
            if name == "SUBTOTAL" and number == 12:
                return self.aggregate("MEDIAN", args[1:])
            if not 1 <= number <= len(table):
                return Value(F.lit(None).cast("double"), "num", F.lit("#VALUE!"))
            return self.aggregate(table[number - 1], args[1:] if name == "SUBTOTAL" else args[2:])
        found = FUNCTIONS.get(name)
        if name in ("COUNTA", "COUNTBLANK") or (found and found.kind in ("agg", "fold")):
            return self.aggregate(name, args)
        if found is None:
            raise CompileError(f"#NAME? {name}")
        if any(self.is_range(a) for a in args) and found.signature.endswith("*") and name in ("AND", "OR", "XOR"):
            return self.truth(name, args)
        values = [self.value(a) for a in args]
        letters = found.letters(len(values))
        columns = [coerced(v, x) for v, x in zip(values, letters, strict=True)]
        own = []
        for v, x, c in zip(values, letters, columns, strict=True):
            if x in "nd" and v.type == "text":
                own.append(F.when(c.isNull() & v.col.isNotNull(), F.lit("#VALUE!")))
        # A trailing literal that is left blank takes its default.
        while columns and values[-1].literal and values[-1].py is None and len(columns) > len(found.required):
            columns.pop()
            values.pop()
        if found.kind == "scalar" and "d" in letters and any(isinstance(a, (fx.Call, fx.Binary)) for a in args):
            out = bound_once(found.build, columns)
        else:
            out = found.build(*columns)
        if found.returns in ("num", "date") and found.kind == "scalar":
            out = finite(out.cast("double"))
        known = [c.isNotNull() for c, v in zip(columns, values, strict=True) if not v.literal]
        failed = out.isNull()
        for k in known:
            failed = failed & k
        own.append(F.when(failed, F.lit(found.err)))
        return Value(out, {"int": "num", "date": "num"}.get(found.returns, found.returns), _first_error(values, F.coalesce(*own)))

    def aggregate(self, name: str, args: tuple[fx.Node, ...], where: Callable[[Table], Column] | None = None) -> Value:
        """An aggregate of ranges and values, as a Column of a grouping or as a subquery."""
        args = tuple(map(self.resolved, args))
        forms = isinstance(args[0], fx.Call) and args[0].name in _ARRAY_CALLS if args else False
        if len(args) == 1 and name in _ARRAY_FORMS and (forms or not self.tables_in(args[0])):
            v = self.value(args[0])
            if v.type == "array":
                return over(v, _ARRAY_FORMS[name], "num")
        found = FUNCTIONS.get(name)
        tables = [t for a in args for t in self.tables_in(a)]
        if not tables:
            values = [self.value(a) for a in args]
            if name == "COUNTA":
                return Value(F.lit(float(sum(not (v.literal and v.py is None) for v in values))), "num")
            return self.direct(name, values)
        table = tables[0]
        if any(t.name != table.name for t in tables):
            if name in ("SUM", "COUNT", "COUNTA", "MAX", "MIN"):
                parts = [self.aggregate(name, (a,)) for a in args]
                combine = {"MAX": F.greatest, "MIN": F.least}.get(name)
                total = combine(*(p.col for p in parts)) if combine else sum((p.col for p in parts[1:]), parts[0].col)
                return Value(total, "num", _first_error(parts))
            raise CompileError(f"{name} takes ranges of one table; join or stack them first")
        saved, grouped = self.ctx.scope, self.ctx.grouped
        inline = grouped and self.ctx.current is not None and self.ctx.current.name == table.name
        self.ctx.scope = table if not inline else saved
        try:
            if not inline and where is None and table.whole is None and name in _ORDER_STATISTICS:
                of_order = self.order_statistic(name, args, table)
                if of_order is not None:
                    return of_order
            columns, errors = [], []
            letters = found.letters(sum(self.width(a) for a in args)) if found else "a" * 99
            order = table
            for a in args:
                for v in self.elements(a):
                    letter = letters[len(columns)]
                    if letter in "ron" and (letter != "n" or self.tables_in(a)):
                        x = self.lane_of(name, v)
                        condition = where(table) if where else None
                        x = x if condition is None else F.when(condition, x)
                        columns.append(self.ordered(order, x) if letter == "o" or (found and found.kind == "fold") else x)
                        if v.err is not None and name not in ("COUNT", "COUNTA", "COUNTBLANK"):
                            errors.append(F.min(v.err if condition is None else F.when(condition, v.err)))
                    else:
                        columns.append(coerced(v, letter) if letter != "a" or v.type != "array" else v.col)
                        if isinstance(a, fx.Array):
                            columns[-1].__dict__["_known"] = sum(map(len, a.rows))
            if name == "AVEDEV" and inline and where is None and self.ctx.means is not None and len(columns) == 1:
                mean = f"_mean{len(self.ctx.means)}"
                self.ctx.means[mean] = columns[0]
                out = F.avg(F.abs(columns[0] - F.col(mean)))
            else:
                out = self.counted(name, columns) if name in ("COUNTA", "COUNTBLANK") else found.build(*columns)
        finally:
            self.ctx.scope, self.ctx.grouped = saved, grouped
        returns = "num" if found is None else found.returns
        err = F.coalesce(*errors) if errors else F.lit(None).cast("string")
        own = F.when(out.isNull(), F.lit(found.err if found else "#VALUE!"))
        if inline:
            return Value(out, returns, F.coalesce(err, own))
        one = self.rows_of(table).select(F.struct(out.alias("v"), F.coalesce(err, own).alias("e")).alias("b")).scalar()
        # What takes an array apart does so inside the subquery.
        return Value(one["v"], returns, one["e"], frame=self.rows_of(table).select(out.alias("v")) if returns == "array" else None)

    def order_statistic(self, name: str, args: tuple[fx.Node, ...], table: Table) -> Value | None:
        """A statistic of order over a whole column without gathering it; None where the general form is needed.

        LARGE and SMALL are a top-k, AVEDEV two aggregations; the rest find their places by running counts of the
        distinct numbers, so a number that fills a third of the rows is one row of them.
        """
        x, *rest = self.elements(args[0])
        more = [self.value(a) for a in args[1:]]
        if rest or x.err is not None or not all(v.literal and isinstance(v.py, (int, float)) for v in more):
            return None
        rows = self.rows_of(table).select(self.lane_of(name, x).alias("x")).where("x is not null")
        if name == "AVEDEV":
            out = rows.select(F.avg(F.abs(F.col("x") - rows.select(F.avg("x")).scalar())).alias("v")).scalar()
            return Value(out, "num", F.when(out.isNull(), F.lit("#NUM!")))
        k = float(more[0].py)
        if name in ("LARGE", "SMALL"):
            n = math.ceil(k)
            if n < 1:
                return None
            chosen = rows.orderBy(F.desc("x") if name == "LARGE" else F.asc("x")).limit(n)
            out = chosen.select(F.when(F.count("x") == n, (F.min if name == "LARGE" else F.max)("x")).alias("v")).scalar()
            return Value(out, "num", F.when(out.isNull(), F.lit("#NUM!")))
        placed = running_total(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "n", "x", "before")
        n, upto = placed.select(F.sum("n")).scalar(), F.col("before") + F.col("n")
        if name == "TRIMMEAN":
            off = F.floor(n * k / 2)
            kept = F.greatest(F.least(upto, n - off) - F.greatest(F.col("before"), off), F.lit(0))
            out = F.when(F.lit(0 <= k < 1), F.try_divide(F.sum(F.col("x") * kept), F.sum(kept)))
        else:
            if name == "QUARTILE.EXC":
                k = math.floor(k) / 4 if 1 <= math.floor(k) <= 3 else 0.0
            at = F.lit(k) * (n + 1)
            low = F.floor(at)
            a, b = (F.max(F.when((F.col("before") < i) & (i <= upto), F.col("x"))) for i in (low, low + 1))
            out = F.when((at >= 1) & (at <= n), F.when(at == low, a).otherwise(a + (at - low) * (b - a)))
        out = placed.select(out.alias("v")).scalar()
        return Value(out, "num", F.when(out.isNull(), F.lit("#NUM!")))

    def width(self, node: fx.Node) -> int:
        return len(self.range_of(node)[1]) if self.is_range(node) else 1

    def elements(self, node: fx.Node) -> list[Value]:
        """One value for each column of an argument."""
        if self.is_range(node):
            table, columns, rows = self.range_of(node)
            out = []
            for c in columns:
                x = F.col(f"`{c}`")
                out.append(Value(x if rows is None else F.when(rows, x), table.dtype(c)))
            return out
        return [self.value(node)]

    @staticmethod
    def lane_of(name: str, v: Value) -> Column:
        """What of a range's cells an aggregate sees: numbers, or all cells, or text as zero."""
        if name in ("COUNTA", "COUNTBLANK"):
            return v.col
        if name in _TEXT_AS_ZERO:
            zero = F.when(v.col.isNotNull(), F.lit(0.0))
            return {"text": zero, "bool": v.col.cast("double"), MIXED: F.coalesce(v.col.try_cast("double"), zero)}.get(v.type, as_number(v))
        if v.type in ("text", "bool"):
            return F.lit(None).cast("double")
        if v.type == MIXED:
            return v.col.try_cast("double")
        return as_number(v) if v.type != "array" else v.col

    @staticmethod
    def counted(name: str, columns: list[Column]) -> Column:
        each = [F.count(c) if name == "COUNTA" else F.count_if(c.isNull() | (c.cast("string") == "")) for c in columns]
        return sum(each[1:], each[0]).cast("double")

    def direct(self, name: str, values: list[Value]) -> Value:
        """An aggregate of typed-in values, where text and truth values are coerced."""
        if name not in _ARRAY_FORMS and name not in FUNCTIONS:
            raise CompileError(f"#NAME? {name}")
        if name in _ARRAY_FORMS:
            arrays = [v.col if v.type == "array" else F.array(as_number(v)) for v in values]
            joined = F.filter(F.concat(*arrays), lambda x: x.isNotNull())
            bad = [F.when(as_number(v).isNull() & v.col.isNotNull(), F.lit("#VALUE!")) for v in values if v.type == "text"]
            return Value(_ARRAY_FORMS[name](joined), "num", _first_error(values, F.coalesce(*bad) if bad and name != "COUNT" else None))
        found = FUNCTIONS[name]
        letters = found.letters(len(values))
        if found.kind == "fold" and set(letters) == {"r"}:
            return Value(found.build(F.concat(*(v.col if v.type == "array" else F.array(as_number(v)) for v in values))), found.returns, _first_error(values))
        columns = [(v.col if v.type == "array" else F.array(as_number(v))) if x in "ro" else coerced(v, x) for v, x in zip(values, letters, strict=True)]
        if found.kind == "fold" or "o" in letters:
            out = found.build(*columns)
            return Value(out, found.returns, _first_error(values, F.when(out.isNull(), F.lit(found.err))))
        raise CompileError(f"{name} of literal arrays: give it a table's columns")

    def truth(self, name: str, args: tuple[fx.Node, ...]) -> Value:
        tables = [t for a in args for t in self.tables_in(a)]
        saved, self.ctx.scope = self.ctx.scope, tables[0]
        try:
            columns = [as_bool(v) for a in args for v in self.elements(a)]
        finally:
            self.ctx.scope = saved
        each = [{"AND": F.bool_and, "OR": F.bool_or, "XOR": F.count_if}[name](c) for c in columns]
        out = each[0]
        for x in each[1:]:
            out = {"AND": out & x, "OR": out | x}.get(name, out + x)
        out = out % 2 == 1 if name == "XOR" else out
        return Value(tables[0].df.select(out.alias("v")).scalar(), "bool")

    # -- criteria --------------------------------------------------------------------------------

    def condition(self, pairs: list[tuple[fx.Node, fx.Node]]) -> Callable[[Table], Column]:
        def where(table: Table) -> Column:
            out = F.lit(True)
            for target, want in pairs:
                t, columns, rows = self.range_of(target)
                if t.name != table.name or len(columns) != 1:
                    raise CompileError("#VALUE! criteria ranges are columns of the table that is summed")
                x, dtype = F.col(f"`{columns[0]}`"), t.dtype(columns[0])
                v = self.value(want)
                out = out & (criterion(x, dtype, v.py) if v.literal else correlated(x, dtype, v.col))
                out = out if rows is None else out & rows
            return out

        return where

    def conditional(self, name: str, args: tuple[fx.Node, ...]) -> Value:
        if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
            target, pairs = (args[2] if len(args) > 2 else args[0]), [(args[0], args[1])]
        elif name == "COUNTIFS":
            target, pairs = args[0], list(zip(args[::2], args[1::2], strict=True))
        else:
            target, pairs = args[0], list(zip(args[1::2], args[2::2], strict=True))
        table = self.range_of(target)[0]
        fixed = [p for p in pairs if self.is_fixed(p[1])]
        loose = [p for p in pairs if p not in fixed]
        if self.ctx.grouped and self.ctx.current is not None and self.ctx.current.name == table.name:
            if _CONDITIONAL[name] == "COUNT":
                return Value(F.count_if(self.condition(pairs)(table)).cast("double"), "num")
            return self.aggregate(_CONDITIONAL[name], (target,), self.condition(pairs))
        saved, self.ctx.scope = self.ctx.scope, table
        try:
            chosen = self.rows_of(table)
            chosen = chosen.where(self.condition(fixed)(table)) if fixed else chosen
            # Equalities with another row's values are the subquery's correlation.
            chosen = chosen.where(self.condition(loose)(table)) if loose else chosen
        finally:
            self.ctx.scope = saved
        narrowed = self.narrowed(table, chosen)
        if _CONDITIONAL[name] == "COUNT":
            return Value(F.coalesce(chosen.select(F.count(F.lit(1)).cast("double").alias("v")).scalar(), F.lit(0.0)), "num")
        v = Compiler(narrowed).aggregate(_CONDITIONAL[name], (target,))
        # A correlated subquery without rows gives NULL, not the aggregate of nothing.
        return Value(F.coalesce(v.col, F.lit(0.0)), "num") if name[:3] in ("SUM", "MAX", "MIN") else Value(v.col, "num", F.when(v.col.isNull(), F.lit("#DIV/0!")))

    def rows_of(self, table: Table) -> DataFrame:
        """The table's rows for a subquery; of the current table a copy whose columns are not those of the row outside."""
        if table.whole is not None or self.ctx.current is None or self.ctx.current.name != table.name:
            return table.df
        return table.df.select(*(F.col(f"`{c}`").alias(c) for c in table.df.columns))

    def narrowed(self, table: Table, df: DataFrame) -> Context:
        return Context({**self.ctx.tables, table.name.lower(): replace(table, df=df, whole=table.shape)}, self.ctx.current, False, self.ctx.names, self.ctx.pivots, self.ctx.outer)

    def is_fixed(self, node: fx.Node) -> bool:
        return self.value(node).literal

    def database(self, name: str, args: tuple[fx.Node, ...], single: bool = False) -> Value:
        """D* functions: the criteria table's rows are alternatives, the cells of a row hold together."""
        table = self.range_of(args[0])[0]
        field = self.value(args[1])
        column = table.column(field.py) if isinstance(field.py, str) else table.visible[int(field.py) - 1]
        criteria = self.range_of(args[2])
        wanted = criteria[0].df if criteria[2] is None else criteria[0].df.where(criteria[2])
        chosen = table.df.where(database_predicate(table, wanted.select(*(F.col(f"`{c}`") for c in criteria[1]))))
        inner = Compiler(self.narrowed(table, chosen))
        target = fx.Structured(table.name, (column,))
        if single:
            n = chosen.select(F.count(F.lit(1))).scalar()
            return Value(chosen.select(F.first(F.col(f"`{column}`"))).scalar(), table.dtype(column), F.when(n == 0, F.lit("#VALUE!")).when(n > 1, F.lit("#NUM!")))
        return inner.aggregate(name, (target,))

    # -- lookups ---------------------------------------------------------------------------------

    def found(self, key: fx.Node, keys: fx.Node, result: fx.Node | None, mode: str, last: bool = False, at: int | None = None) -> Value:
        """The first (or last) match of a key: mode "=" exactly, "<=" the largest not above, ">=" the smallest not below.

        The result is a column of the keys' table, its ``at``-th column, or the position.
        """
        table, columns, rows = self.range_of(keys)
        x = f"`{columns[0]}`"
        target = self.range_of(result)[1][0] if result is not None else columns[at - 1] if at is not None else None
        want = self.value(key)
        outer, per_row = want.col, not want.literal and self.ctx.current is not None
        if mode == "=" and not want.literal:
            saved, self.ctx.scope = self.ctx.scope, table
            try:
                outer = self.value(key).col
            finally:
                self.ctx.scope = saved
        df = self.rows_of(table) if rows is None else self.rows_of(table).where(rows)
        order = F.struct(*(F.col(f"`{c}`") for c in table.order)) if table.order else F.lit(0)
        if target is None:
            if not table.order:
                raise CompileError(f"MATCH needs an order for {table.name}")
            if not per_row:
                return self.position(df, F.col(x), table.dtype(columns[0]), want, order, mode, last)
            df = numbered(df, table.order, "_pos", start=1).withColumn("_pos", F.col("_pos").cast("double"))
            target = "_pos"
        dtype = "num" if target == "_pos" else table.dtype(target)
        value = F.col(f"`{target}`")
        if mode == "=":
            left = F.col(x)
            same = left == outer if table.dtype(columns[0]) != "text" or want.type == "text" else left == F.lit(None)
            pick = (F.max_by if last else F.min_by)(F.struct(value.alias("v"), F.lit(1).alias("hit")), order)
            one = df.where(same).select(pick.alias("b")).scalar()
            return Value(one["v"], dtype, F.when(one["hit"].isNull(), F.lit("#N/A")))
        # Of sorted keys the nearest; equal keys give their last row below, their first above.
        if per_row:
            return self.nearest((key, keys, mode, target == "_pos"), want, df, F.col(x), table.dtype(columns[0]), value, dtype, order, mode)
        near = F.col(x) <= want.col if mode == "<=" else F.col(x) >= want.col
        key_order = F.struct(F.col(x).alias("k"), order.alias("o"))
        one = df.where(near).select((F.max_by if mode == "<=" else F.min_by)(F.struct(value.alias("v"), F.lit(1).alias("hit")), key_order).alias("b")).scalar()
        return Value(one["v"], dtype, F.when(one["hit"].isNull(), F.lit("#N/A")))

    @staticmethod
    def position(df: DataFrame, x: Column, kind: str, want: Value, order: Column, mode: str, last: bool) -> Value:
        """MATCH of one key: the hit's place in the order, then the rows up to it counted, so no task sees all rows."""
        if mode == "=":
            same = x == want.col if kind != "text" or want.type == "text" else F.lit(False)
            hit = df.where(same).select((F.max if last else F.min)(order).alias("b")).scalar()
        else:
            near = x <= want.col if mode == "<=" else x >= want.col
            hit = df.where(near).select((F.max_by if mode == "<=" else F.min_by)(order, F.struct(x.alias("k"), order.alias("o"))).alias("b")).scalar()
        place = df.where(order <= hit).select(F.count(F.lit(1)).cast("double").alias("v")).scalar()
        return Value(F.when(hit.isNotNull(), place), "num", F.when(hit.isNull(), F.lit("#N/A")))

    def nearest(self, asked: tuple, want: Value, df: DataFrame, x: Column, kind: str, value: Column, dtype: str, order: Column, mode: str) -> Value:
        """An approximate lookup with a key of each row: a column that Workbook.with_columns joins before its projection.

        Text is only near text.
        """
        if self.ctx.scope is not None or self.ctx.grouped:
            raise CompileError("approximate lookups by row inside an aggregate: define them as a column first")
        if (want.type in ("text", MIXED)) != (kind in ("text", MIXED)):
            return Value(F.lit(None).cast("double"), "num", _first_error([want], F.lit("#N/A")))
        if kind not in ("text", MIXED) and not kind == want.type == "date":
            x, want = as_number(Value(x, kind)), replace(want, col=as_number(want))
        near = self.ctx.near.setdefault(asked, Near(f"_near{len(self.ctx.near)}", want.col, df, x, order, mode == "<="))
        near.values.append(value)
        hit = F.col(near.name)
        return Value(hit[f"v{len(near.values) - 1}"], dtype, _first_error([want], F.when(hit.isNull(), F.lit("#N/A"))))


def bound_once(build: Callable[..., Column], columns: list[Column]) -> Column:
    """build(*columns), with each argument computed once: date functions use theirs many times over."""
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    return F.transform(F.array(row), lambda s: build(*(s[f"c{i}"] for i in range(len(columns)))))[0]


def database_predicate(table: Table, criteria: DataFrame) -> Column:
    """Rows of the table that meet one of the criteria's rows in all its cells; a column it has not meets nothing."""
    out = None
    for row in criteria.collect():  # a criteria range is typed in by hand
        cells = F.lit(True)
        for name, want in row.asDict().items():
            if want in (None, ""):
                continue
            if name.lower() not in [c.lower() for c in table.df.columns]:
                cells = F.lit(False)
                break
            c = table.column(name)
            cells = cells & criterion(F.col(f"`{c}`"), table.dtype(c), want if isinstance(want, (str, bool)) else float(want))
        out = cells if out is None else out | cells
    return F.lit(True) if out is None else out


_ARRAY_FORMS: dict[str, Callable[[Column], Column]] = {
    "SUM": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))),
    "COUNT": lambda a: F.size(F.filter(a, lambda x: x.isNotNull())).cast("double"),
    "AVERAGE": lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), F.size(F.filter(a, lambda x: x.isNotNull())).cast("double")),
    "MIN": lambda a: F.coalesce(F.array_min(a), F.lit(0.0)),
    "MAX": lambda a: F.coalesce(F.array_max(a), F.lit(0.0)),
    "PRODUCT": lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * F.coalesce(x, F.lit(1.0))),
    "SUMSQ": lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x),
    "MEDIAN": lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2,
}
#: Calls that make arrays of their ranges.
_ARRAY_CALLS = ("MAP", "SCAN", "BYROW", "BYCOL", "SLICE", "MAKEARRAY", "SEQUENCE", "RANDARRAY", "FREQUENCY", "LINEST", "MODE.MULT")
_FORMS: dict[str, Callable[..., Value]] = {}


def form(*names: str):
    def wrap(f):
        for n in names:
            _FORMS[n] = f
        return f

    return wrap


def choose(branches: list[tuple[Column, Value]], default: Value) -> Value:
    """The value of the first condition that holds; branches not taken are not evaluated."""
    values = [v for _, v in branches] + [default]
    kinds = {v.type for v in values if not (v.literal and v.py is None)}
    kind = kinds.pop() if len(kinds) == 1 else "text" if "text" in kinds else "num"
    cast = {"num": lambda v: as_number(v), "text": as_text, "bool": as_bool}.get(kind, lambda v: v.col)
    out, err = None, None
    for c, v in branches:
        e = v.err if v.err is not None else F.lit(None).cast("string")
        out = F.when(c, cast(v)) if out is None else out.when(c, cast(v))
        err = F.when(c, e) if err is None else err.when(c, e)
    e = default.err if default.err is not None else F.lit(None).cast("string")
    return Value(out.otherwise(cast(default)), kind, err.otherwise(e) if any(v.err is not None for v in values) else None)


@form("IF")
def _if(c: Compiler, test: fx.Node, then: fx.Node, other: fx.Node = fx.Literal(False)) -> Value:
    v = c.value(test)
    out = choose([(F.coalesce(as_bool(v), F.lit(False)), c.value(then))], c.value(other))
    return replace(out, err=_first_error([v, out])) if v.err is not None else out


def error_of(v: Value) -> Column:
    return v.err if v.err is not None else F.lit(None).cast("string")


@form("IFERROR")
def _iferror(c: Compiler, node: fx.Node, other: fx.Node) -> Value:
    v = c.value(node)
    return choose([(error_of(v).isNotNull(), c.value(other))], replace(v, err=None))


@form("IFNA")
def _ifna(c: Compiler, node: fx.Node, other: fx.Node) -> Value:
    v = c.value(node)
    return choose([(F.coalesce(error_of(v) == "#N/A", F.lit(False)), c.value(other))], v)


@form("IFS")
def _ifs(c: Compiler, *args: fx.Node) -> Value:
    pairs = [(F.coalesce(as_bool(c.value(a)), F.lit(False)), c.value(b)) for a, b in zip(args[::2], args[1::2], strict=True)]
    return choose(pairs, Value(F.lit(None).cast("double"), "num", F.lit("#N/A"), True))


@form("SWITCH")
def _switch(c: Compiler, subject: fx.Node, *args: fx.Node) -> Value:
    v = c.value(subject)
    default = c.value(args[-1]) if len(args) % 2 else Value(F.lit(None).cast("double"), "num", F.lit("#N/A"), True)
    pairs = [(F.coalesce(as_text(v) == as_text(c.value(a)), F.lit(False)), c.value(b)) for a, b in zip(args[: len(args) // 2 * 2 : 2], args[1::2], strict=True)]
    return choose(pairs, default)


@form("CHOOSE")
def _choose(c: Compiler, index: fx.Node, *args: fx.Node) -> Value:
    at = F.floor(as_number(c.value(index)))
    return choose([(at == i + 1, c.value(a)) for i, a in enumerate(args)], Value(F.lit(None).cast("double"), "num", F.lit("#VALUE!"), True))


def _test(name: str, f: Callable[[Value], Column]) -> None:
    form(name)(lambda c, node: Value(f(c.value(node)), "bool"))


_test("ISERROR", lambda v: error_of(v).isNotNull())
_test("ISERR", lambda v: F.coalesce(error_of(v) != "#N/A", F.lit(False)))
_test("ISNA", lambda v: F.coalesce(error_of(v) == "#N/A", F.lit(False)))
_test("ISBLANK", lambda v: v.col.isNull() & error_of(v).isNull())
_test("ISNUMBER", lambda v: v.col.isNotNull() & F.lit(v.type in ("num", "date")))
_test("ISTEXT", lambda v: v.col.isNotNull() & F.lit(v.type == "text"))
_test("ISNONTEXT", lambda v: ~(v.col.isNotNull() & F.lit(v.type == "text")))
_test("ISLOGICAL", lambda v: v.col.isNotNull() & F.lit(v.type == "bool"))
_test("ISOMITTED", lambda v: F.lit(v.literal and v.py is None))


@form("ISREF")
def _isref(c: Compiler, node: fx.Node) -> Value:
    return Value(F.lit(isinstance(node, (fx.CellRange, fx.Structured)) or c.is_range(node)), "bool")


@form("N")
def _n(c: Compiler, node: fx.Node) -> Value:
    v = c.value(node)
    return Value(F.coalesce(as_number(v), F.lit(0.0)) if v.type != "text" else F.lit(0.0), "num", v.err)


@form("T")
def _t(c: Compiler, node: fx.Node) -> Value:
    v = c.value(node)
    return Value(F.coalesce(v.col, F.lit("")) if v.type == "text" else F.lit(""), "text", v.err)


@form("TYPE")
def _type(c: Compiler, node: fx.Node) -> Value:
    v = c.value(node)
    code = 64.0 if c.is_range(node) and v.type == "array" else {"num": 1.0, "date": 1.0, "text": 2.0, MIXED: 2.0, "bool": 4.0, "array": 64.0}[v.type]
    return Value(F.when(error_of(v).isNotNull(), F.lit(16.0)).otherwise(F.lit(code)), "num")


@form("ERROR.TYPE")
def _error_type(c: Compiler, node: fx.Node) -> Value:
    e = error_of(c.value(node))
    out = F.array_position(F.array(*map(F.lit, ERRORS)), F.coalesce(e, F.lit(""))).cast("double")
    return Value(F.when(out > 0, out), "num", F.when(e.isNull(), F.lit("#N/A")))


@form("TEXT")
def _text(c: Compiler, node: fx.Node, shape: fx.Node) -> Value:
    v, f = c.value(node), c.value(shape)
    if not isinstance(f.py, str):
        raise CompileError("#VALUE! TEXT takes a literal format")
    moment = v.col.cast("timestamp") if v.type == "date" else moment_of(as_number(v))
    return Value(text_format(as_number(v), f.py, moment), "text", v.err)


@form("LET")
def _let(c: Compiler, *args: fx.Node) -> Value:
    names: dict[str, fx.Node] = {}
    for k, v in zip(args[:-1:2], args[1:-1:2], strict=True):
        if not isinstance(k, fx.Name) or k.name.lower() in names:
            raise CompileError("#VALUE! LET names are distinct names")
        names[k.name.lower()] = fx.substitute(v, names)
    return c.value(fx.substitute(args[-1], names))


@form("LAMBDA")
def _lambda(c: Compiler, *args: fx.Node) -> Value:
    return Value(F.lit(None).cast("double"), "num", F.lit("#CALC!"))


def _element(v: Value, x: Column) -> Value:
    return Value(x, "num")


@form("MAP")
def _map(c: Compiler, *args: fx.Node) -> Value:
    names, body = c.lambda_of(args[-1])
    arrays = [c.array_of(a) for a in args[:-1]]
    if len(arrays) == 1:
        return over(arrays[0], lambda a: F.transform(a, lambda x: c.bound(names, [_element(arrays[0], x)], body).col))
    frames = [a for a in arrays if a.frame is not None]
    if frames:
        spark = frames[0].frame.sparkSession
        row = spark.range(1).select(F.arrays_zip(*(a.col.alias(f"a{i}") for i, a in enumerate(arrays))).alias("v"))
        each = lambda s: c.bound(names, [_element(a, s[str(i)]) for i, a in enumerate(arrays)], body).col
        return over(in_frame(row), lambda v: F.transform(v, each))
    zipped = F.arrays_zip(*(a.col.alias(f"a{i}") for i, a in enumerate(arrays)))
    return Value(F.transform(zipped, lambda s: c.bound(names, [_element(a, s[str(i)]) for i, a in enumerate(arrays)], body).col), "array", _first_error(arrays))


@form("REDUCE")
def _reduce(c: Compiler, *args: fx.Node) -> Value:
    names, body = c.lambda_of(args[-1])
    array = c.array_of(args[-2])
    step = lambda a, x: c.bound(names, [Value(a, "num"), Value(x, "num")], body).col.cast("double")
    if len(args) == 3:
        start = coerced(c.value(args[0]), "n").cast("double")
        return over(array, lambda v: F.aggregate(v, start, step), "num")
    return over(array, lambda v: F.aggregate(F.slice(v, F.lit(2), F.size(v)), F.get(v, F.lit(0)).cast("double"), step), "num")


@form("SCAN")
def _scan(c: Compiler, *args: fx.Node) -> Value:
    names, body = c.lambda_of(args[-1])
    array = c.array_of(args[-2])
    start = coerced(c.value(args[0]), "n").cast("double") if len(args) == 3 else None
    empty = F.array().cast("array<double>")

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1) if start is None else F.coalesce(F.try_element_at(done, F.lit(-1)), start)
        new = c.bound(names, [Value(last, "num"), Value(x, "num")], body).col.cast("double")
        return F.concat(done, F.array(new))

    if start is None:
        return over(array, lambda v: F.aggregate(F.slice(v, F.lit(2), F.size(v)), F.slice(v, 1, 1).cast("array<double>"), step))
    return over(array, lambda v: F.aggregate(v, empty, step))


@form("BYROW")
def _byrow(c: Compiler, data: fx.Node, function: fx.Node) -> Value:
    names, body = c.lambda_of(function)
    table, columns, _ = c.range_of(data)
    row = F.array(*(F.col(f"`{x}`").cast("double") for x in columns))
    if c.ctx.current is not None and c.ctx.current.name == table.name:
        return c.bound(names, [Value(row, "array")], body)
    rows = in_frame(table.df.select(c.ordered(table, row).alias("v")))
    return over(rows, lambda v: F.transform(v, lambda r: c.bound(names, [Value(r, "array")], body).col))


@form("BYCOL")
def _bycol(c: Compiler, data: fx.Node, function: fx.Node) -> Value:
    names, body = c.lambda_of(function)
    table, columns, _ = c.range_of(data)
    each = [c.value(fx.substitute(body, {names[0]: fx.Structured(table.name, (x,))})) for x in columns]
    if table.df is c.ctx.scope or c.ctx.grouped:
        return Value(F.array(*(as_number(v) for v in each)), "array", _first_error(each))
    return in_frame(table.df.sparkSession.range(1).select(F.array(*(as_number(v) for v in each)).alias("v")))


@form("MAKEARRAY")
def _makearray(c: Compiler, rows: fx.Node, cols: fx.Node, function: fx.Node) -> Value:
    names, body = c.lambda_of(function)
    r, k = (as_number(c.value(x)).cast("int") for x in (rows, cols))
    cells = F.sequence(F.lit(0), r * k - 1)
    one = lambda i: c.bound(names, [Value((F.floor(i / k) + 1).cast("double"), "num"), Value((i % k + 1).cast("double"), "num")], body).col
    return Value(F.transform(cells, one), "array")


@form("VLOOKUP")
def _vlookup(c: Compiler, key: fx.Node, data: fx.Node, index: fx.Node, near: fx.Node = fx.Literal(True)) -> Value:
    at = int(c.value(index).py)
    return c.found(key, data, None, "<=" if c.value(near).py else "=", at=at)


@form("XLOOKUP")
def _xlookup(c: Compiler, key: fx.Node, keys: fx.Node, result: fx.Node, missing: fx.Node | None = None, mode: fx.Node = fx.Literal(0.0), search: fx.Node = fx.Literal(1.0)) -> Value:
    how = {0: "=", -1: "<=", 1: ">="}[int(c.value(mode).py or 0)]
    v = c.found(key, keys, result, how, last=c.value(search).py == -1)
    if missing is None or missing == fx.Literal(None):
        return v
    return choose([(error_of(v).isNotNull(), c.value(missing))], replace(v, err=None))


@form("LOOKUP")
def _lookup(c: Compiler, key: fx.Node, keys: fx.Node, result: fx.Node | None = None) -> Value:
    return c.found(key, keys, result or keys, "<=")


@form("MATCH")
def _match(c: Compiler, key: fx.Node, keys: fx.Node, mode: fx.Node = fx.Literal(1.0)) -> Value:
    return c.found(key, keys, None, {0: "=", 1: "<=", -1: ">="}[int(c.value(mode).py)])


@form("XMATCH")
def _xmatch(c: Compiler, key: fx.Node, keys: fx.Node, mode: fx.Node = fx.Literal(0.0), search: fx.Node = fx.Literal(1.0)) -> Value:
    return c.found(key, keys, None, {0: "=", -1: "<=", 1: ">="}[int(c.value(mode).py)], last=c.value(search).py == -1)


@form("INDEX")
def _index(c: Compiler, data: fx.Node, row: fx.Node, col: fx.Node = fx.Literal(1.0)) -> Value:
    at, across = as_number(c.value(row)).cast("int"), c.value(col)
    if not c.is_range(data):
        return Value(F.get(c.array_of(data).col, at - 1), "num")
    table, columns, rows = c.range_of(data)
    if isinstance(row, fx.Call) and row.name in ("MATCH", "XMATCH") and len(columns) >= 1:
        # INDEX of a MATCH is one lookup.
        mode = int(c.value(row.args[2]).py) if len(row.args) > 2 else (1 if row.name == "MATCH" else 0)
        how = {0: "="}.get(mode) or ("<=" if (mode == 1) == (row.name == "MATCH") else ">=")
        return c.found(row.args[0], row.args[1], fx.Structured(table.name, (columns[int(across.py) - 1],)), how)
    name = columns[int(across.py) - 1]
    values = c.ordered(table, F.struct(F.col(f"`{name}`").alias("v")))
    df = table.df if rows is None else table.df.where(rows)
    return Value(F.get(df.select(values.alias("v")).scalar(), F.when(at < 0, at + F.lit(0)).otherwise(at - 1))["v"], table.dtype(name))


@form("ROW")
def _row(c: Compiler, node: fx.Node | None = None) -> Value:
    if isinstance(node, fx.CellRange) and node.top is not None:
        return Value(F.lit(float(node.top + 1)), "num", literal=True, py=float(node.top + 1))
    return Value((F.col("_r") + 1).cast("double"), "num")


@form("ROWS")
def _rows(c: Compiler, node: fx.Node) -> Value:
    if isinstance(node, fx.CellRange) and node.top is not None:
        return Value(F.lit(float(node.bottom - node.top + 1)), "num")
    if not c.is_range(node):
        return Value(F.size(c.array_of(node).col).cast("double"), "num")
    return Value(c.range_of(node)[0].df.select(F.count(F.lit(1)).cast("double")).scalar(), "num")


@form("COLUMNS")
def _columns(c: Compiler, node: fx.Node) -> Value:
    return Value(F.lit(float(len(c.range_of(node)[1]))), "num")


@form("COLUMN")
def _column(c: Compiler, node: fx.Node) -> Value:
    table, columns, _ = c.range_of(node)
    return Value(F.lit(float(table.visible.index(columns[0]) + 1)), "num")


@form("SHEETS")
def _sheets(c: Compiler, node: fx.Node | None = None) -> Value:
    return Value(F.lit(float(len(c.ctx.tables))), "num")


@form("SHEET")
def _sheet(c: Compiler, node: fx.Node | None = None) -> Value:
    table = c.ctx.current if node is None else c.range_of(node)[0]
    return Value(F.lit(float(list(c.ctx.tables).index(table.name.lower()) + 1)), "num")


@form("INFO")
def _info(c: Compiler, what: fx.Node) -> Value:
    # What the environment reports.
    known = {"numfile": float(len(c.ctx.tables)), "release": "1.0", "system": "pcdos"}.get(str(c.value(what).py).lower())
    if known is None:
        return Value(F.lit(None).cast("double"), "num", F.lit("#VALUE!"))
    return Value(F.lit(known), "text" if isinstance(known, str) else "num")


@form("CELL")
def _cell(c: Compiler, what: fx.Node, node: fx.Node) -> Value:
    kind = str(c.value(what).py).lower()
    if not isinstance(node, fx.CellRange) or node.top is None:
        raise CompileError("#VALUE! CELL takes a cell")
    if kind == "contents":
        return c.value(replace(node, last=node.first, bottom=node.top))
    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(node.first)))
    found = {"row": float(node.top + 1), "col": float(at), "address": f"${node.first}${node.top + 1}"}.get(kind)
    if found is None:
        return Value(F.lit(None).cast("double"), "num", F.lit("#VALUE!"))
    return Value(F.lit(found), "text" if isinstance(found, str) else "num")


@form("INDIRECT")
def _indirect(c: Compiler, text: fx.Node, *_: fx.Node) -> Value:
    return c.value(indirect(c, text))


def indirect(c: Compiler, text: fx.Node) -> fx.Node:
    v = c.value(text)
    if not isinstance(v.py, str):
        raise CompileError("#REF! INDIRECT takes literal text")
    return fx.parse(v.py)


@form("OFFSET")
def _offset(c: Compiler, node: fx.Node, *args: fx.Node) -> Value:
    return c.value(offset(c, node, *args))


def offset(c: Compiler, node: fx.Node, rows: fx.Node, cols: fx.Node, height: fx.Node | None = None, width: fx.Node | None = None) -> fx.CellRange:
    if not isinstance(node, fx.CellRange) or node.top is None or node.first is None:
        raise CompileError("#REF! OFFSET takes a cell range")
    number = lambda s: sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(s)))

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    def literal(x: fx.Node) -> int:
        v = c.value(x)
        if isinstance(x, fx.Unary):
            return -int(c.value(x.arg).py)
        return int(v.py)

    top, left = node.top + literal(rows), number(node.first) + literal(cols)
    h = node.bottom - node.top + 1 if height is None else literal(height)
    w = number(node.last) - number(node.first) + 1 if width is None else literal(width)
    if top < 0 or left < 1 or h < 1 or w < 1:
        raise CompileError("#REF! OFFSET leaves the grid")
    return fx.CellRange(node.sheet, letters(left), top, letters(left + w - 1), top + h - 1)


@form("GET")
def _get(c: Compiler, *args: fx.Node) -> Value:
    """Cell by row and column from 0, of a sheet or the current table."""
    sheet = str(c.value(args[0]).py) if len(args) == 3 else None
    table = c.ctx.table(sheet)
    row, col = (int(c.value(a).py) for a in args[-2:])
    name = table.visible[col]
    return Value(F.get(table.df.select(c.ordered(table, F.struct(F.col(f"`{name}`").alias("v")))).scalar(), F.lit(row))["v"], table.dtype(name))


@form("GET_COL_IDX")
def _get_col_idx(c: Compiler, *args: fx.Node) -> Value:
    table = c.ctx.table(str(c.value(args[0]).py) if len(args) == 2 else None)
    return c.value(fx.Structured(table.name, (table.visible[int(c.value(args[-1]).py)],)))


@form("GETPIVOTDATA")
def _getpivotdata(c: Compiler, value: fx.Node, name: fx.Node, *items: fx.Node) -> Value:
    from quadrille.operators.pivot import get_pivot_data

    held = c.ctx.pivots.get(str(c.value(name).py if not isinstance(name, fx.Name) else name.name).lower())
    if held is None:
        return Value(F.lit(None).cast("double"), "num", F.lit("#REF!"))
    pairs = {str(c.value(a).py): c.value(b).py for a, b in zip(items[::2], items[1::2], strict=True)}
    pairs = {k: int(v) if isinstance(v, float) and v == int(v) else v for k, v in pairs.items()}
    one = get_pivot_data(held[0], held[1], str(c.value(value).py), **pairs).select(F.max("value")).scalar()
    return Value(one, "num", F.when(one.isNull(), F.lit("#REF!")))


# -- matrices --------------------------------------------------------------------------------------


def matrix_of(c: Compiler, node: fx.Node) -> Column:
    """Rows of numbers: of a literal, a range of a spreadsheet's size, or another matrix function."""
    if isinstance(node, fx.Array):
        return F.array(*(F.array(*(as_number(c.value(x)).cast("double") for x in row)) for row in node.rows))
    if c.is_range(node):
        table, columns, rows = c.range_of(node)
        df = table.df if rows is None else table.df.where(rows)
        row = F.array(*(as_number(Value(F.col(f"`{x}`"), table.dtype(x))).cast("double") for x in columns))
        return df.select(c.ordered(table, row)).scalar()
    v = c.value(node)
    return v.col


def _matrix(name: str, f: Callable, returns: str) -> None:
    from quadrille.functions.registry import arrow_udf

    def build(c: Compiler, *args: fx.Node) -> Value:
        out = arrow_udf(lambda *m: f(*([list(r) for r in x] for x in m)), returns)(*(matrix_of(c, a) for a in args))
        return Value(out, "num" if returns == "num" else "array", F.when(out.isNull(), F.lit("#VALUE!" if name == "MMULT" else "#NUM!")))

    _FORMS[name] = build


def _product(a: list, b: list) -> list:
    if len(a[0]) != len(b):
        raise ValueError("shapes differ")
    return [[float(sum(x * y for x, y in zip(r, k, strict=True))) for k in zip(*b, strict=True)] for r in a]


def _inverse(m: list) -> list:
    import numpy as np

    if abs(np.linalg.det(np.array(m))) < 1e-300:
        raise ValueError("singular")
    return np.linalg.inv(np.array(m)).tolist()


def _determinant(m: list) -> float:
    import numpy as np

    return float(np.linalg.det(np.array(m)))


_matrix("MMULT", _product, "matrix")
_matrix("MINVERSE", _inverse, "matrix")
_matrix("MDETERM", _determinant, "num")


def _days_off(c: Compiler, weekend: fx.Node | None, holidays: fx.Node | None):
    spec = c.value(weekend).py if weekend is not None else None
    days = None if holidays is None else F.transform(c.array_of(holidays).col, lambda x: from_serial(x))
    return spec, days


@form("NETWORKDAYS.INTL")
def _networkdays(c: Compiler, s: fx.Node, e: fx.Node, weekend: fx.Node | None = None, holidays: fx.Node | None = None) -> Value:
    return Value(networkdays(as_number(c.value(s)), as_number(c.value(e)), *_days_off(c, weekend, holidays)), "num")


@form("WORKDAY.INTL")
def _workday(c: Compiler, s: fx.Node, n: fx.Node, weekend: fx.Node | None = None, holidays: fx.Node | None = None) -> Value:
    return Value(workday(as_number(c.value(s)), as_number(c.value(n)), *_days_off(c, weekend, holidays)), "num")


@form("DGET")
def _dget(c: Compiler, *args: fx.Node) -> Value:
    return c.database("SUM", args, single=True)


@form("GET_COL")
def _get_col(c: Compiler, table: fx.Node, name: fx.Node) -> Value:
    return c.value(fx.Structured(str(c.value(table).py) if not isinstance(table, fx.Name) else table.name, (str(c.value(name).py),)))


@form("SLICE")
def _slice(c: Compiler, data: fx.Node, start: fx.Node, end: fx.Node) -> Value:
    v = c.array_of(data)
    a, b = (as_number(c.value(x)).cast("int") for x in (start, end))

    def part(x: Column) -> Column:
        stop = F.when(b < 0, F.size(x) + b + 1).otherwise(F.least(b, F.size(x)))
        return F.slice(x, a + 1, F.greatest(stop - a, F.lit(0)))

    return over(v, part)


@form("HLOOKUP")
def _hlookup(c: Compiler, key: fx.Node, data: fx.Node, index: fx.Node, near: fx.Node = fx.Literal(True)) -> Value:
    """The key is sought among the columns' names for a table, in the first row for a sheet."""
    table, columns, _ = c.range_of(data)
    at, want = int(c.value(index).py), as_text(c.value(key))
    values = [F.get(table.df.select(c.ordered(table, F.col(f"`{x}`")).alias("v")).scalar(), F.lit(at - 2 if not table.letters else at - 1)) for x in columns]
    heads = [F.lit(x) if not table.letters else F.get(table.df.select(c.ordered(table, F.col(f"`{x}`")).alias("v")).scalar(), F.lit(0)).cast("string") for x in columns]
    pairs = [(h == want, Value(v, table.dtype(x))) for h, v, x in zip(heads, values, columns, strict=True)]
    return choose(pairs, Value(F.lit(None).cast("double"), "num", F.lit("#N/A"), True))


def _regression(name: str) -> None:
    @form(name)
    def build(c: Compiler, ys: fx.Node, xs: fx.Node = fx.Literal(None), new: fx.Node = fx.Literal(None), *_: fx.Node) -> Value:
        """Left-out xs are the numbers' places 1, 2, …; a left-out new x is the first x."""
        left_out, predicts = fx.Literal(None), name in ("TREND", "GROWTH")
        if xs != left_out:
            if not predicts:
                return c.aggregate(name, (ys, xs))
            if new != left_out:
                return c.aggregate(name, (ys, xs, new))
            table, columns, rows = c.range_of(c.resolved(xs))
            if not table.order:
                raise CompileError(f"{name} without new x needs an order for {table.name}")
            x = c.lane_of(name, Value(F.col(f"`{columns[0]}`"), table.dtype(columns[0])))
            first = F.min_by(x if rows is None else F.when(rows, x), F.when(x.isNotNull() if rows is None else rows & x.isNotNull(), F.struct(*(F.col(f"`{o}`") for o in table.order))))
            inline = c.ctx.grouped and c.ctx.current is not None and c.ctx.current.name == table.name
            start = Value(first if inline else c.rows_of(table).select(first.alias("v")).scalar(), "num")
            return c.bound(["_first_x"], [start], fx.Call(name, (ys, xs, fx.Name("_first_x"))))
        if c.ctx.grouped:
            raise CompileError(f"{name} in a grouping takes its xs")
        if c.is_range(ys):
            table, columns, rows = c.range_of(ys)
            if not table.order:
                raise CompileError(f"{name} without xs needs an order for {table.name}")
            y = c.lane_of(name, Value(F.col(f"`{columns[0]}`"), table.dtype(columns[0])))
            df = c.rows_of(table) if rows is None else c.rows_of(table).where(rows)
            df = df.select(F.struct(*(F.col(f"`{o}`") for o in table.order)).alias("_o"), y.alias("_y"))
        else:
            df = SparkSession.active().range(1).select(F.posexplode(c.array_of(ys).col).alias("_o", "_y"))
        placed = numbered(df.where("_y is not null"), ["_o"], "_x", start=1).select("_y", F.col("_x").cast("double").alias("_x"))
        places = Context({**c.ctx.tables, "_placed": Table("_placed", placed)}, c.ctx.current, names=c.ctx.names, pivots=c.ctx.pivots, outer=c.ctx.outer, near=c.ctx.near)
        y, x = (fx.Structured("_placed", (n,)) for n in ("_y", "_x"))
        return Compiler(places).aggregate(name, (y, x, *([fx.Literal(1.0) if new == left_out else new] if predicts else [])))


for _name in ("LINEST", "LOGEST", "TREND", "GROWTH"):
    _regression(_name)


def formula_of(c: Compiler, node: fx.Node) -> str | None:
    """The text of the formula that a reference's first cell or column was defined by."""
    table, columns, _ = c.range_of(node)
    top = node.top if isinstance(node, fx.CellRange) else None
    return table.formulas.get((top, columns[0])) or table.formulas.get(columns[0])


@form("FORMULATEXT")
def _formulatext(c: Compiler, node: fx.Node) -> Value:
    text = formula_of(c, c.resolved(node))
    if text is None:
        return Value(F.lit(None).cast("string"), "text", F.lit("#N/A"))
    return Value(F.lit(text), "text", literal=True, py=text)


@form("ISFORMULA")
def _isformula(c: Compiler, node: fx.Node) -> Value:
    found = formula_of(c, c.resolved(node)) is not None
    return Value(F.lit(found), "bool", literal=True, py=found)
