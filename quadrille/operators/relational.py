"""Dynamic-array operators on whole DataFrames: sorting, filtering, stacking, reshaping.

``order`` names the columns that give a frame its row order; positions are counted in it. Global positions
need one sorted pass; operators that take only a few rows use a top-k instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = list[str] | tuple[str, ...]


def _keys(order: Order, reverse: bool = False) -> list[Column]:
    return [F.desc(c) if reverse else F.asc(c) for c in order]


def positions(df: DataFrame, order: Order, name: str = "_r", start: int = 0) -> DataFrame:
    """Row numbers in the given order, without gathering the rows in one task.

    Rows are range-partitioned and numbered inside their partition; the partitions' sizes, one number each,
    give the offsets.
    """
    from quadrille.operators.ordinals import numbered

    return numbered(df, order, name, start)


def sort(df: DataFrame, by: list[tuple[str, bool]], order: Order = ()) -> DataFrame:
    """Stable sort by (column, ascending) pairs; blanks come last both ways."""
    keys = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in by]
    return df.orderBy(*keys, *_keys(order))


def filter_rows(df: DataFrame, include: Column) -> DataFrame:
    return df.where(F.coalesce(include.cast("boolean"), F.lit(False)))


def unique(df: DataFrame, once: bool = False) -> DataFrame:
    """Distinct rows, or rows that occur exactly once."""
    if once:
        return df.groupBy(*df.columns).count().where("count = 1").drop("count")
    return df.distinct()


def take(df: DataFrame, n: int, order: Order) -> DataFrame:
    """The first n rows, or for a negative n the last ones: a top-k, not a sort."""
    return df.orderBy(*_keys(order, n < 0)).limit(abs(n))


def drop(df: DataFrame, n: int, order: Order) -> DataFrame:
    """All but the first n rows, or for a negative n the last ones."""
    gone = take(df, n, order).select(*order)
    return df.join(gone, list(order), "left_anti")


def choose_columns(df: DataFrame, *indexes: int) -> DataFrame:
    names = df.columns
    return df.select(*(names[i - 1] if i > 0 else names[i] for i in indexes))


def choose_rows(df: DataFrame, order: Order, *indexes: int) -> DataFrame:
    """Rows by position from 1, negative from the end, in the order asked for (repeats allowed)."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, i) for k, i in enumerate(indexes)], "_k int, _at long")
    placed = positions(df, order, "_p", 1)
    if any(i < 0 for i in indexes):
        n = df.count()
        wanted = wanted.withColumn("_at", F.when(F.col("_at") < 0, F.col("_at") + n + 1).otherwise(F.col("_at")))
    return placed.join(wanted, F.col("_p") == F.col("_at")).orderBy("_k").drop("_p", "_at", "_k")


def vstack(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are blank (#N/A)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def hstack(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order) -> DataFrame:
    """Columns side by side by position; the shorter frame is blank below its end."""
    a, b = positions(left, left_order, "_p"), positions(right, right_order, "_p")
    clash = {c: f"{c}_2" for c in right.columns if c in left.columns}
    return a.join(b.withColumnsRenamed(clash), "_p", "full").drop("_p")


def expand(df: DataFrame, rows: int, order: Order, pad: object = None) -> DataFrame:
    """The frame with ``rows`` rows, new ones holding ``pad``."""
    placed = positions(df, order, "_p").withColumn("_here", F.lit(True))
    full = df.sparkSession.range(rows).withColumnRenamed("id", "_p").join(placed, "_p", "left")
    return full.select("_p", *(F.when(F.col("_here"), F.col(c)).otherwise(F.lit(pad)).alias(c) for c in df.columns))


def to_column(df: DataFrame, order: Order, ignore_blank: bool = False) -> DataFrame:
    """All cells in row order as (order…, _c, value)."""
    rest = [c for c in df.columns if c not in order]
    cells = df.select(*order, F.posexplode(F.array(*(F.col(c).cast("string" if len({t for n, t in df.dtypes if n in rest}) > 1 else dict(df.dtypes)[c]) for c in rest))).alias("_c", "value"))
    return cells.where("value is not null") if ignore_blank else cells


#: Cells of one row of a sheet, a fixed value of the file format.
WIDEST = 16384


def to_row(df: DataFrame, order: Order, ignore_blank: bool = False) -> DataFrame:
    """All cells in row order as one row c1, c2, …; more than a sheet's row holds is an error."""
    cells = to_column(df, order, ignore_blank)
    n = cells.limit(WIDEST + 1).count()
    if n > WIDEST:
        raise ValueError(f"#NUM! a row holds {WIDEST} cells")
    row = F.array_sort(F.collect_list(F.struct(*order, "_c", "value")))
    return cells.select(row.alias("r")).select(*(F.get("r", F.lit(i))["value"].alias(f"c{i + 1}") for i in range(n)))


def wrap_rows(df: DataFrame, column: str, width: int, order: Order) -> DataFrame:
    """A vector as rows of ``width`` values: (_row, c1, …)."""
    placed = positions(df.select(*dict.fromkeys([*order, column])), order, "_p")
    row, at = F.floor(F.col("_p") / width).alias("_row"), F.col("_p") % width
    return placed.groupBy(row).agg(*(F.max(F.when(at == i, F.col(column))).alias(f"c{i + 1}") for i in range(width)))


def wrap_columns(df: DataFrame, column: str, height: int, order: Order) -> DataFrame:
    """A vector as columns of ``height`` values; the number of columns follows from the row count."""
    n = df.count()
    placed = positions(df.select(*dict.fromkeys([*order, column])), order, "_p")
    row, at = (F.col("_p") % height).alias("_row"), F.floor(F.col("_p") / height)
    return placed.groupBy(row).agg(*(F.max(F.when(at == i, F.col(column))).alias(f"c{i + 1}") for i in range(-(-n // height))))


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Rows become columns named by ``key``'s values; for frames of a sheet's size."""
    return df.transpose(F.col(key))


def trim_range(df: DataFrame, order: Order) -> DataFrame:
    """Without the blank rows at both ends."""
    rest = [c for c in df.columns if c not in order]
    full = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(1)) for c in rest)).isNotNull()
    placed = positions(df, order, "_p")
    ends = placed.where(full).agg(F.min("_p").alias("a"), F.max("_p").alias("b")).first()
    return placed.where(F.col("_p").between(F.lit(ends.a), F.lit(ends.b))).drop("_p")


def intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose key is in b, repeats kept."""
    return a.join(b.select(*on).distinct(), on, "left_semi")


def except_(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def group_by(df: DataFrame, keys: list[str], values: dict[str, Column], total: bool = False) -> DataFrame:
    """GROUPBY: aggregates by key, with a grand total row (keys blank) if asked for."""
    if not total:
        return df.groupBy(*keys).agg(*(v.alias(k) for k, v in values.items()))
    sets = [[F.col(k) for k in keys], []]
    return df.groupingSets(sets, *keys).agg(*(v.alias(k) for k, v in values.items()))


def pivot_by(df: DataFrame, rows: list[str], column: str, value: Column, items: list) -> DataFrame:
    """PIVOTBY with given column items, which keeps it one aggregation."""
    return df.groupBy(*rows).pivot(column, items).agg(value)


# -- windows ---------------------------------------------------------------------------------------


def rank(df: DataFrame, column: str, name: str = "rank", by: list[str] = (), ascending: bool = False, average: bool = False) -> DataFrame:
    """RANK.EQ or RANK.AVG; with ``by``, in each group."""
    if not by:
        # Ranks among all rows come from the counts of distinct values, not from one task's window.
        counts = df.groupBy(column).agg(F.count("*").alias("_n"))
        ordered = positions(counts, [column], "_p").alias("o")
        below = _running(ordered, "_n", "_p")
        total = df.agg(F.count(F.col(column)).alias("t"))
        placed = below.withColumn("_t", total.scalar())
        first = F.col("_before") + 1 if ascending else F.col("_t") - F.col("_before") - F.col("_n") + 1
        value = (first + (F.col("_n") - 1) / 2 if average else first).cast("double")
        return df.join(placed.select(column, value.alias(name)), column, "left")
    key = F.col(column).asc() if ascending else F.col(column).desc()
    w = Window.partitionBy(*by).orderBy(key)
    base = F.rank().over(w).cast("double")
    if average:
        base = base + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2
    return df.withColumn(name, base)


def _running(df: DataFrame, value: str, order: str) -> DataFrame:
    from quadrille.operators.ordinals import running_total

    return running_total(df, value, order, "_before")


def running(df: DataFrame, value: Column, by: list[str], order: Order, rows: tuple[int | None, int] = (None, 0)) -> Column:
    """The Window of an expanding (None) or sliding range of rows, for any aggregate: ``F.sum(x).over(...)``."""
    low = Window.unboundedPreceding if rows[0] is None else rows[0]
    return value.over(Window.partitionBy(*by).orderBy(*order).rowsBetween(low, rows[1]))


def neighbour(column: str, by: list[str], order: Order, offset: int) -> Column:
    """OFFSET to a row above (negative) or below in the same column."""
    w = Window.partitionBy(*by).orderBy(*order)
    return F.lead(column, offset).over(w) if offset > 0 else F.lag(column, -offset).over(w)
