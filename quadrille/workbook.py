"""A workbook: named tables, and formulas over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import joins
from quadrille.operators import relational as rel
from quadrille.operators.pivot import PivotSpec, grid, pivot
from quadrille.plans import formula as fx
from quadrille.plans.compiler import MIXED, CompileError, Compiler, Context, Table, Value, error_of, indirect, offset


class Workbook:
    """Tables by name (without regard to case), in order; formulas compile to plans over them.

    With ``errors="lane"`` a formula column ``x`` comes with ``x__err``, its error code or NULL; with "null"
    errors are NULLs.
    """

    def __init__(self, spark: SparkSession, errors: str = "null"):
        if errors not in ("null", "lane"):
            raise ValueError("errors is null or lane")
        self.spark, self.errors = spark, errors
        self.tables: dict[str, Table] = {}
        self.pivots: dict[str, tuple[str, PivotSpec]] = {}
        self.log: list[dict[str, object]] = []

    # -- catalogue -------------------------------------------------------------------------------

    def add(self, name: str, df: DataFrame, order_by: list[str] | str = (), letters: bool = False) -> Workbook:
        """Add or replace a table. ``order_by`` gives its rows an order; ``letters`` marks a sheet with columns A, B, …"""
        order = (order_by,) if isinstance(order_by, str) else tuple(order_by)
        if not order and "_r" in df.columns:
            order = ("_r",)
        self.tables[name.lower()] = Table(name, df, order, letters)
        self._note("add", name)
        return self

    def sheet(self, name: str, rows: list[list[object]], header: bool = False) -> Workbook:
        """Add a small grid; columns are A, B, … or the header row's names. A mixed column is kept as text whose numbers count as numbers."""
        names = [str(c) for c in rows[0]] if header else [_letters(i + 1) for i in range(max(map(len, rows)))]
        body = rows[1:] if header else rows
        cells = [[r[i] if i < len(r) else None for r in body] for i in range(len(names))]
        kinds = []
        for column in cells:
            found = {type(v) for v in column if v is not None}
            kinds.append("boolean" if found == {bool} else "double" if found and found <= {int, float} else "string")
        cast = {"boolean": bool, "double": float, "string": _shown}
        mixed = [k == "string" and {type(v) for v in column if v is not None} != {str} for k, column in zip(kinds, cells, strict=True)]
        data = [(i, *(None if v is None else cast[k](v) for v, k in zip(r, kinds, strict=True))) for i, r in enumerate(zip(*cells, strict=True))]
        schema = "_r bigint, " + ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
        df = self.spark.createDataFrame(data, schema)
        for n, m in zip(names, mixed, strict=True):
            df = df.withMetadata(n, {MIXED: True}) if m else df
        return self.add(name, df, "_r", letters=not header)

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise KeyError(name)
        return self.tables[name.lower()]

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name).df

    def rename_table(self, old: str, new: str) -> None:
        self.tables = {(new.lower() if k == old.lower() else k): (replace(t, name=new) if k == old.lower() else t) for k, t in self.tables.items()}
        self._note("rename_table", old, new)

    def rename_column(self, table: str, old: str, new: str) -> None:
        t = self.table(table)
        self.tables[table.lower()] = replace(t, df=t.df.withColumnRenamed(t.column(old), new), order=tuple(new if c == t.column(old) else c for c in t.order))
        self._note("rename_column", table, old, new)

    def delete(self, table: str) -> None:
        del self.tables[table.lower()]
        self._note("delete", table)

    def total(self, table: str, column: str, formula: str) -> None:
        """Give a column a totals-row formula, which [#Totals] refers to."""
        t = self.table(table)
        self.tables[table.lower()] = replace(t, totals=t.totals | {t.column(column): formula})

    def insert_rows(self, table: str, at: int, n: int) -> None:
        """Make room for n rows at a position: ordinals from there on move."""
        t = self.table(table)
        self.tables[table.lower()] = replace(t, df=t.df.withColumn("_r", F.when(F.col("_r") >= at, F.col("_r") + n).otherwise(F.col("_r"))))
        self._note("insert_rows", table, at, n)

    def delete_rows(self, table: str, at: int, n: int) -> None:
        t = self.table(table)
        df = t.df.where(~F.col("_r").between(at, at + n - 1))
        self.tables[table.lower()] = replace(t, df=df.withColumn("_r", F.when(F.col("_r") >= at + n, F.col("_r") - n).otherwise(F.col("_r"))))
        self._note("delete_rows", table, at, n)

    def _note(self, action: str, *args: object) -> None:
        self.log.append({"seq": len(self.log), "action": action, "args": [str(a) for a in args]})

    def changes(self) -> DataFrame:
        """The edit log as rows."""
        return self.spark.createDataFrame([(x["seq"], x["action"], x["args"]) for x in self.log], "seq int, action string, args array<string>")

    # -- formulas --------------------------------------------------------------------------------

    def compiler(self, table: str | None = None, grouped: bool = False) -> Compiler:
        cells = {k.lower(): (self.pivot(k), spec) for k, (_, spec) in self.pivots.items()}
        current = self.table(table) if table else None
        return Compiler(Context(self.tables, current, grouped, pivots=cells, means=_means(current) if grouped else None))

    def _lanes(self, name: str, v: Value) -> list[Column]:
        out = [v.col.alias(name)]
        return [*out, error_of(v).alias(f"{name}__err")] if self.errors == "lane" else out

    def with_columns(self, table: str, formulas: dict[str, str]) -> DataFrame:
        """The table with formula columns, filled down. A formula may use columns defined with it; a cycle is an error."""
        t = self.table(table)
        trees = {name: fx.parse(text) for name, text in formulas.items()}
        own = {name.lower(): name for name in trees}

        def needs(node: fx.Node) -> set[str]:
            return {own[c.lower()] for r in fx.references(node) if isinstance(r, fx.Structured) and (r.table is None or r.table.lower() == table.lower()) for c in r.columns if c.lower() in own}

        left = {n: needs(x) - ({n} if n in t.df.columns else set()) for n, x in trees.items()}
        df = t.df
        while left:
            ready = [n for n, d in left.items() if not d & set(left)]
            if not ready:
                raise CompileError(f"circular formulas: {', '.join(left)}")
            here = replace(t, df=df)
            compiler = Compiler(Context({**self.tables, table.lower(): here}, here))
            # Columns of one step are added in one projection.
            added = [c for n in ready for c in self._lanes(n, compiler.value(trees[n]))]
            gone = {n.lower() for n in ready}
            kept = [c for c in df.columns if c.lower() not in gone]
            outer = {f"_outer_{c}": F.col(f"`{c}`") for c in compiler.ctx.outer}
            df = df.withColumns(outer) if outer else df
            for near in compiler.ctx.near.values():
                df = joins.with_nearest(df, near.name, near.key, near.right(), near.below)
            df = df.select(*(F.col(f"`{c}`") for c in kept), *added)
            for n in ready:
                del left[n]
        return df

    def define(self, table: str, formulas: dict[str, str]) -> None:
        """Like with_columns, and keep the columns."""
        t = self.table(table)
        texts = {n: f if f.startswith("=") else f"={f}" for n, f in formulas.items()}
        self.tables[table.lower()] = replace(t, df=self.with_columns(table, formulas), formulas=t.formulas | texts)

    def group(self, table: str, by: list[str], formulas: dict[str, str]) -> DataFrame:
        """One row a group, formulas being aggregates of the table's columns."""
        t = self.table(table)
        compiler = self.compiler(table, grouped=True)
        out = [c for n, f in formulas.items() for c in self._lanes(n, compiler.value(fx.parse(f)))]
        df = joins.with_means(t.df, by, compiler.ctx.means or {})
        return df.groupBy(*by).agg(*out) if by else df.agg(*out)

    def value(self, formula: str) -> object:
        """The one value of a formula; its error code if it has one."""
        v = self.compiler().value(fx.parse(formula))
        row = self.spark.range(1).select(v.col.alias("v"), error_of(v).alias("e")).first()
        return row.e if row.e is not None else row.v

    def evaluate(self, formula: str, table: str | None = None) -> DataFrame:
        """A formula's result as a frame: rows for array operators on tables, else one row with column ``value``."""
        node = fx.parse(formula)
        if isinstance(node, fx.Call) and (node.name in _ARRAYS or node.name in ("INDIRECT", "OFFSET")) or self.compiler(table).is_range(node):
            return self._frame(node, table)[0]
        v = self.compiler(table).value(node)
        return self.spark.range(1).select(*self._lanes("value", v))

    def _frame(self, node: fx.Node, table: str | None) -> tuple[DataFrame, list[str], Table | None]:
        """Rows of an array expression, their order, and the table they are rows of, if they are."""
        c = self.compiler(table)
        if isinstance(node, fx.Call) and node.name == "INDIRECT":
            return self._frame(indirect(c, node.args[0]), table)
        if isinstance(node, fx.Call) and node.name == "OFFSET":
            return self._frame(offset(c, *node.args), table)
        if isinstance(node, fx.Call) and node.name in _ARRAYS:
            return _ARRAYS[node.name](self, table, *node.args)
        if c.is_range(node):
            t, columns, rows = c.range_of(node)
            df = t.df if rows is None else t.df.where(rows)
            return df.select(*dict.fromkeys([*columns, *t.order])), list(t.order), t
        v = c.array_of(node)
        df = self.spark.range(1).select(F.posexplode(v.col).alias("_r", "value"))
        return df, ["_r"], None

    def predicate(self, node: fx.Node, t: Table) -> Column:
        """A condition on a table's ranges, row by row; NULL counts as false."""
        return Compiler(Context(self.tables, t, False)).filter_condition(node)

    # -- pivots ----------------------------------------------------------------------------------

    def add_pivot(self, name: str, table: str, spec: PivotSpec) -> None:
        self.table(table)
        self.pivots[name] = table, spec

    def pivot(self, name: str) -> DataFrame:
        table, spec = self.pivots[name]
        return pivot(self[table], spec, list(self.table(table).order) or None)

    def pivot_grid(self, name: str) -> list[list[object]]:
        table, spec = self.pivots[name]
        return grid(self[table], spec, list(self.table(table).order) or None)


def _means(t: Table) -> dict[str, Column] | None:
    """Where the means of a table's groups are noted to be joined; a stream is not joined with its own aggregate."""
    return None if t.df.isStreaming else {}


def _shown(v: object) -> str:
    """A cell of a mixed column as text."""
    if isinstance(v, bool):
        return str(v).upper()
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _number(wb: Workbook, node: fx.Node, default: float | None = None) -> float | None:
    if node == fx.Literal(None):
        return default
    if isinstance(node, fx.Unary):
        return -_number(wb, node.arg)
    return wb.compiler().value(node).py


_ARRAYS = {}


def _array(name: str):
    def wrap(f):
        _ARRAYS[name] = f
        return f

    return wrap


@_array("FILTER")
def _filter(wb: Workbook, table: str | None, data: fx.Node, include: fx.Node, empty: fx.Node | None = None):
    c = wb.compiler(table)
    t, columns, rows = c.range_of(data)
    df = t.df.where(wb.predicate(include, t))
    df = df if rows is None else df.where(rows)
    return df.select(*dict.fromkeys([*columns, *t.order])), list(t.order), t


@_array("SORT")
def _sort(wb: Workbook, table: str | None, data: fx.Node, index: fx.Node = fx.Literal(1.0), direction: fx.Node = fx.Literal(1.0), *_: fx.Node):
    df, order, t = wb._frame(data, table)
    at, up = int(_number(wb, index, 1)), _number(wb, direction, 1) > 0
    return rel.sort(df, [(df.columns[at - 1], up)], [o for o in order if o in df.columns]), order, t


@_array("SORTBY")
def _sortby(wb: Workbook, table: str | None, data: fx.Node, *keys: fx.Node):
    df, order, t = wb._frame(data, table)
    c = wb.compiler(table)
    pairs = [(c.range_of(k)[1][0], _number(wb, d, 1) > 0) for k, d in zip(keys[::2], [*keys[1::2], fx.Literal(1.0)], strict=False)]
    full = t.df.select(*dict.fromkeys([*df.columns, *(k for k, _ in pairs)]))
    return rel.sort(full, pairs, order).select(*df.columns), order, t


@_array("UNIQUE")
def _unique(wb: Workbook, table: str | None, data: fx.Node, by_col: fx.Node = fx.Literal(False), once: fx.Node = fx.Literal(False)):
    df, order, t = wb._frame(data, table)
    c = wb.compiler(table)
    columns = c.range_of(data)[1] if c.is_range(data) else [x for x in df.columns if x not in order]
    return rel.unique(df.select(*columns), bool(_number(wb, once, False))), [], None


@_array("TAKE")
def _take(wb: Workbook, table: str | None, data: fx.Node, rows: fx.Node, cols: fx.Node = fx.Literal(None)):
    df, order, t = wb._frame(data, table)
    if isinstance(data, fx.Call) and data.name in ("SORT", "SORTBY"):
        n = int(_number(wb, rows))
        out = df.limit(n) if n >= 0 else None
        if out is None:
            raise CompileError("#VALUE! take from the end of a sort by sorting the other way")
        return out, order, t
    out = df if rows == fx.Literal(None) else rel.take(df, int(_number(wb, rows)), order)
    k = _number(wb, cols)
    if k:
        out = out.select(*(out.columns[: int(k)] if k > 0 else out.columns[int(k) :]))
    return out, order, t


@_array("DROP")
def _drop(wb: Workbook, table: str | None, data: fx.Node, rows: fx.Node, cols: fx.Node = fx.Literal(None)):
    df, order, t = wb._frame(data, table)
    out = df if rows == fx.Literal(None) else rel.drop(df, int(_number(wb, rows)), order)
    k = _number(wb, cols)
    if k:
        out = out.select(*(out.columns[int(k) :] if k > 0 else out.columns[: int(k)]))
    return out, order, t


@_array("CHOOSECOLS")
def _choosecols(wb: Workbook, table: str | None, data: fx.Node, *indexes: fx.Node):
    df, order, t = wb._frame(data, table)
    return rel.choose_columns(df, *(int(_number(wb, i)) for i in indexes)), [], t


@_array("CHOOSEROWS")
def _chooserows(wb: Workbook, table: str | None, data: fx.Node, *indexes: fx.Node):
    df, order, t = wb._frame(data, table)
    return rel.choose_rows(df, order, *(int(_number(wb, i)) for i in indexes)), order, t


@_array("VSTACK")
def _vstack(wb: Workbook, table: str | None, *data: fx.Node):
    return rel.vstack(*(wb._frame(d, table)[0] for d in data)), [], None


@_array("HSTACK")
def _hstack(wb: Workbook, table: str | None, *data: fx.Node):
    (a, ao, _), *rest = (wb._frame(d, table) for d in data)
    for b, bo, _ in rest:
        a = rel.hstack(a, b, ao, bo)
    return a, ao, None


@_array("EXPAND")
def _expand(wb: Workbook, table: str | None, data: fx.Node, rows: fx.Node, cols: fx.Node = fx.Literal(None), pad: fx.Node = fx.Literal(None)):
    df, order, _ = wb._frame(data, table)
    return rel.expand(df, int(_number(wb, rows)), order, _number(wb, pad)), ["_p"], None


@_array("TOCOL")
def _tocol(wb: Workbook, table: str | None, data: fx.Node, ignore: fx.Node = fx.Literal(0.0), *_: fx.Node):
    df, order, _ = wb._frame(data, table)
    return rel.to_column(df, order, _number(wb, ignore, 0) in (1.0, 3.0)), [*order, "_c"], None


@_array("TOROW")
def _torow(wb: Workbook, table: str | None, data: fx.Node, ignore: fx.Node = fx.Literal(0.0), *_: fx.Node):
    """All cells as one row c1, c2, …; like a sheet's row it holds 16,384 cells and no more."""
    df, order, _ = wb._frame(data, table)
    return rel.to_row(df, order, _number(wb, ignore, 0) in (1.0, 3.0)), [], None


@_array("WRAPROWS")
def _wraprows(wb: Workbook, table: str | None, data: fx.Node, width: fx.Node, *_: fx.Node):
    df, order, _ = wb._frame(data, table)
    name = next(c for c in df.columns if c not in order) if len(df.columns) > len(order) else df.columns[0]
    return rel.wrap_rows(df, name, int(_number(wb, width)), order), ["_row"], None


@_array("WRAPCOLS")
def _wrapcols(wb: Workbook, table: str | None, data: fx.Node, height: fx.Node, *_: fx.Node):
    df, order, _ = wb._frame(data, table)
    name = next(c for c in df.columns if c not in order) if len(df.columns) > len(order) else df.columns[0]
    return rel.wrap_columns(df, name, int(_number(wb, height)), order), ["_row"], None


@_array("TRANSPOSE")
def _transpose(wb: Workbook, table: str | None, data: fx.Node):
    df, order, _ = wb._frame(data, table)
    return rel.transpose(df, order[0] if order else df.columns[0]), [], None


@_array("TRIMRANGE")
def _trimrange(wb: Workbook, table: str | None, data: fx.Node, *_: fx.Node):
    df, order, t = wb._frame(data, table)
    return rel.trim_range(df, order), order, t


@_array("GROUPBY")
def _groupby(wb: Workbook, table: str | None, keys: fx.Node, values: fx.Node, function: fx.Node, *_: fx.Node):
    c = wb.compiler(table)
    t, key, _rows = c.range_of(keys)
    value = c.range_of(values)[1][0]
    grouped = Compiler(Context(wb.tables, t, True, means=_means(t)))
    target = fx.Structured(t.name, (value,))
    if isinstance(function, fx.Call):
        names, body = grouped.lambda_of(function)
        v = grouped.value(fx.substitute(body, {names[0]: target}))
    else:
        v = grouped.value(fx.Call(function.name.upper(), (target,)))
    return rel.group_by(joins.with_means(t.df, key, grouped.ctx.means or {}), key, {"value": v.col}), key, None


@_array("PIVOTBY")
def _pivotby(wb: Workbook, table: str | None, rows: fx.Node, cols: fx.Node, values: fx.Node, function: fx.Node, *_: fx.Node):
    c = wb.compiler(table)
    t, key, _r = c.range_of(rows)
    column, value = c.range_of(cols)[1][0], c.range_of(values)[1][0]
    grouped = Compiler(Context(wb.tables, t, True, means=_means(t)))
    v = grouped.value(fx.Call(function.name.upper(), (fx.Structured(t.name, (value,)),)))
    items = [r[0] for r in t.df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return rel.pivot_by(joins.with_means(t.df, [*key, column], grouped.ctx.means or {}), key, column, v.col, items), key, None
