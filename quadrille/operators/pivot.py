"""Pivot tables: one grouping-sets aggregation, and a display grid made from its rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.registry import round15

BLANK = "(blank)"


@dataclass(frozen=True)
class ValueField:
    column: str
    how: str = "sum"
    caption: str | None = None


@dataclass(frozen=True)
class PivotSpec:
    """Rows and columns from outer to inner; filters keep a field's items (by their text, without case)."""

    rows: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    values: tuple[ValueField, ...] = ()
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    subtotals: bool = True
    row_total: bool = True
    column_total: bool = True

    def add(self, axis: str, *fields: str | ValueField) -> PivotSpec:
        return replace(self, **{axis: (*getattr(self, axis), *fields)})

    def remove(self, name: str) -> PivotSpec:
        return replace(self, rows=tuple(r for r in self.rows if r != name), columns=tuple(c for c in self.columns if c != name), values=tuple(v for v in self.values if v.column != name), filters={k: v for k, v in self.filters.items() if k != name})

    def where(self, name: str, *items: str) -> PivotSpec:
        return replace(self, filters=self.filters | {name: items} if items else {k: v for k, v in self.filters.items() if k != name})

    def captions(self) -> list[str]:
        """Names of the value fields: "Sum of x", made distinct by a number."""
        word = {"sum": "Sum", "count": "Count", "countnumbers": "Count", "average": "Average", "max": "Max", "min": "Min"}
        out: list[str] = []
        for v in self.values:
            name = v.caption or f"{word[v.how]} of {v.column}"
            taken = {x.lower() for x in [*out, *self.rows, *self.columns]}
            k, base = 2, name
            while name.lower() in taken:
                name, k = f"{base}{k}", k + 1
            out.append(name)
        return out


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.upper(c.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _aggregate(df: DataFrame, v: ValueField) -> Column:
    kind = df.schema[v.column].dataType
    numeric = isinstance(kind, T.NumericType)
    number = F.col(v.column).cast("double") if numeric else F.lit(None).cast("double")
    filled = F.col(v.column).isNotNull() if not isinstance(kind, T.StringType) else F.col(v.column).isNotNull() & (F.col(v.column) != "")
    return {
        "sum": round15(F.coalesce(F.sum(number), F.lit(0.0))),
        "count": F.count(F.when(filled, 1)).cast("double"),
        "countnumbers": F.count(number).cast("double"),
        "average": round15(F.avg(number)),
        "max": F.max(number),
        "min": F.min(number),
    }[v.how]


def pivot(df: DataFrame, spec: PivotSpec, order: list[str] | None = None) -> DataFrame:
    """All cells of a pivot in long form: the axis fields' captions, _level, and one column a value field.

    Items merge without regard to case; their caption is the spelling met first in the unfiltered source (in
    ``order``; without one, the least). Blank items read "(blank)". ``_level`` is the grouping id over rows then
    columns: 0 for leaves, a field's bit set where it is totalled. One scan aggregates all levels.
    """
    axis = [*spec.rows, *spec.columns]
    if not spec.values:
        raise ValueError("a pivot needs a value field")
    text = {a: F.coalesce(_text(df, a), F.lit("")) for a in axis}
    kept = df
    for name, items in spec.filters.items():
        kept = kept.where(F.lower(F.coalesce(F.when(_text(df, name) == "", None).otherwise(_text(df, name)), F.lit(BLANK))).isin([i.lower() for i in items]))
    keyed = kept.select("*", *(F.lower(text[a]).alias(f"_k{i}") for i, a in enumerate(axis)))
    keys = [f"_k{i}" for i in range(len(axis))]
    r, names = len(spec.rows), list(zip(spec.captions(), spec.values, strict=True))
    row_sets = [spec.rows[:n] for n in range(r + 1) if n == r or (n == 0 and spec.column_total) or (0 < n < r and spec.subtotals)]
    col_sets = [spec.columns[:n] for n in range(len(spec.columns) + 1) if n == len(spec.columns) or (n == 0 and spec.row_total) or (0 < n < len(spec.columns) and spec.subtotals)]
    at = {a: F.col(f"_k{i}") for i, a in enumerate(axis)}
    sets = [[at[a] for a in (*x, *y)] for x in row_sets for y in col_sets]
    values = [_aggregate(df, v).alias(c) for c, v in names]
    if axis:
        out = keyed.groupingSets(sets, *keys).agg(F.grouping_id().alias("_level"), *values)
    else:
        out = keyed.agg(F.lit(0).cast("bigint").alias("_level"), *values)
    for i, a in enumerate(axis):
        seen = df.select(F.lower(text[a]).alias("_c"), text[a].alias("_t"), *(order or []))
        first = F.min_by("_t", F.struct(*order)) if order else F.min("_t")
        caption = seen.groupBy("_c").agg(first.alias("_cap"))
        out = out.join(caption, F.col(f"_k{i}") == F.col("_c"), "left").drop("_c").withColumn(f"_c{i}", F.when(F.col(f"_k{i}") == "", F.lit(BLANK)).otherwise(F.col("_cap"))).drop("_cap")
    return out.select(*(F.col(f"_c{i}").alias(a) for i, a in enumerate(axis)), "_level", *(F.col(f"`{c}`") for c, _ in names))


def get_pivot_data(cells: DataFrame, spec: PivotSpec, value: str, **items: object) -> DataFrame:
    """GETPIVOTDATA: the one cell of a value field at the given items; fields left out are totalled."""
    axis = [*spec.rows, *spec.columns]
    named = {k.lower(): str(v).lower() for k, v in items.items()}
    level = sum(1 << (len(axis) - 1 - i) for i, a in enumerate(axis) if a.lower() not in named)
    out = cells.where(F.col("_level") == level)
    for a in axis:
        if a.lower() in named:
            out = out.where(F.lower(F.col(a)) == named[a.lower()])
    return out.select(F.col(f"`{value}`").alias("value"))


def _order_key(items: list[str]) -> list[str]:
    """Numbers by value if all are; else text, lower-cased, without a sign before a digit; (blank) last."""
    known = [i for i in items if i != BLANK]
    try:
        known.sort(key=float)
    except ValueError:
        known.sort(key=lambda s: s.lower()[1:] if len(s) > 1 and s[0] == "-" and s[1].isdigit() else s.lower())
    return known + [BLANK] * (BLANK in items)


def grid(df: DataFrame, spec: PivotSpec, order: list[str] | None = None) -> list[list[object]]:
    """The pivot as it is displayed, header rows first. The result of the aggregation, a grid for people to read, is collected."""
    cells = [r.asDict() for r in pivot(df, spec, order).collect()]
    axis, captions = [*spec.rows, *spec.columns], spec.captions()
    bit = {a: 1 << (len(axis) - 1 - i) for i, a in enumerate(axis)}
    key = lambda c, names: tuple(None if c["_level"] & bit[a] else c[a] for a in names)
    found = {(key(c, spec.rows), key(c, spec.columns)): c for c in cells}
    ranks = {a: {v: i for i, v in enumerate(_order_key(sorted({c[a] for c in cells if not c["_level"] & bit[a]})))} for a in axis}

    def sorted_keys(which: int, names: tuple[str, ...]) -> list[tuple]:
        return sorted({k[which] for k in found}, key=lambda t: tuple((1, 0) if v is None else (0, ranks[a][v]) for a, v in zip(names, t, strict=True)))

    def label(t: tuple, names: tuple[str, ...]) -> str:
        held = [v for v in t if v is not None]
        if not held:
            return "Grand Total" if names else ""
        return held[-1] if len(held) == len(t) else f"{held[-1]} Total"

    columns = sorted_keys(1, spec.columns)
    out: list[list[object]] = []
    for i, a in enumerate(spec.columns):
        out.append([a, *["" for _ in spec.rows[1:]], *(x for t in columns for x in [(t[i] if t[i] is not None else (label(t, spec.columns) if i == 0 or t[i - 1] is not None else "")), *[""] * (len(captions) - 1)])])
    out.append([*(spec.rows or ("",)), *(c if len(captions) > 1 or not spec.columns else "" for _ in columns for c in captions)])
    for t in sorted_keys(0, spec.rows):
        head: list[object] = [v if v is not None else "" for v in t] if all(v is not None for v in t) and t else [label(t, spec.rows), *["" for _ in spec.rows[1:]]]
        line = head
        for u in columns:
            c = found.get((t, u))
            line = [*line, *((c[x] if c else None) for x in captions)]
        out.append(line)
    return out
