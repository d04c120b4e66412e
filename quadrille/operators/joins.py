"""Lookups as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.operators.ordinals import fixed
from quadrille.plans.criteria import criterion


def lookup(left: DataFrame, right: DataFrame, on: dict[str, str], take: dict[str, str], order: list[str], last: bool = False, missing: dict[str, object] | None = None) -> DataFrame:
    """VLOOKUP/XLOOKUP: adds columns of the first (last) row of ``right`` with the key.

    ``on`` maps left to right key columns, ``take`` new names to right columns. All columns come from one join.
    The right side is reduced to one row a key first; whether it is broadcast is left to its measured size.
    """
    pick = F.max_by if last else F.min_by
    row = F.struct(*(F.col(c).alias(n) for n, c in take.items()))
    firsts = right.groupBy(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values()))).agg(pick(row, F.struct(*order)).alias("_row"))
    joined = left.join(firsts, [left[k] == F.col(f"_k{i}") for i, k in enumerate(on)], "left")
    fill = missing or {}
    out = [F.coalesce(F.col(f"_row.{n}"), F.lit(fill[n])).alias(n) if n in fill else F.col(f"_row.{n}").alias(n) for n in take]
    return joined.select(*(left[c] for c in left.columns), *out)


def asof_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, take: dict[str, str], by: dict[str, str] | None = None, below: bool = True) -> DataFrame:
    """Approximate MATCH: the nearest right row whose key is not above (or, with below=False, not below) the left's.

    Both sides are united and one window carries the last right row forward, so it is a sort, not a range join; with
    below=False it runs down the keys, as a frame of all rows that follow would be read anew for each row.
    With ``by`` (left to right columns) windows are per group. Without, rows are dealt by ranges of the key and
    each range starts from the last right row of the ranges before it, so no task sees all rows.
    """
    names = [f"_t{i}" for i in range(len(take))]
    row = F.struct(*(F.col(c).alias(n) for n, c in zip(names, take.values(), strict=True)))
    groups = list((by or {}).items())
    key = F.col(left_key)
    a = left.select(F.struct(*left.columns).alias("_left"), key.alias("_k"), F.lit(1 if below else 0).alias("_side"), F.lit(None).cast("string").alias("_n"), *(F.col(c).alias(f"_g{i}") for i, (c, _) in enumerate(groups)))
    b = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("_k"), F.lit(0 if below else 1).alias("_side"), row.alias("_right"), *(F.col(c).alias(f"_g{i}") for i, (_, c) in enumerate(groups)))
    both = a.drop("_n").unionByName(b, allowMissingColumns=True)
    groups_ = [f"_g{i}" for i in range(len(groups))]
    along = lambda *names: [F.col(n).asc_nulls_first() if below else F.col(n).desc_nulls_first() for n in names]
    if groups_:
        w = Window.partitionBy(*groups_).orderBy(*along("_k", "_side")).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    else:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parted = fixed(both.repartitionByRange(parts, "_k").withColumn("_part", F.spark_partition_id()))
        edge = F.max_by("_right", F.struct("_k", "_side")) if below else F.min_by("_right", F.struct("_k", "_side"))
        edges = parted.where("_right is not null").groupBy("_part").agg(edge.alias("_e"))
        every = left.sparkSession.range(parts).select(F.col("id").cast("int").alias("_part")).join(edges, "_part", "left")
        carried = every.select("_part", F.last("_e", ignorenulls=True).over(Window.orderBy(*along("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
        w = Window.partitionBy("_part").orderBy(*along("_k", "_side")).rowsBetween(Window.unboundedPreceding, 0)
        hit = F.when(F.col("_k").isNotNull(), F.coalesce("_in", "_carried"))
        found = parted.withColumn("_in", F.last("_right", ignorenulls=True).over(w)).join(F.broadcast(carried), "_part", "left").withColumn("_hit", hit)
    return found.where("_left is not null").select("_left.*", *(F.col(f"_hit.{n}").alias(k) for n, k in zip(names, take, strict=True)))


def with_nearest(left: DataFrame, name: str, key: Column, right: DataFrame, below: bool) -> DataFrame:
    """``left`` with ``_hit`` of the nearest ``_key`` of ``right`` as a column; NULL where none is near, or the key is NULL.

    The as-of step sees each distinct key once and none of left's other columns; a key that many rows hold is a
    skewed key of an equality join, which adaptive execution splits.
    """
    keyed = left.withColumn(f"{name}_k", key)
    wanted = keyed.select(F.col(f"{name}_k").alias("_want")).where("_want is not null").distinct()
    hits = asof_lookup(wanted, right, "_want", "_key", {name: "_hit"}, below=below).withColumnRenamed("_want", f"{name}_w")
    return keyed.join(hits, F.col(f"{name}_k") == F.col(f"{name}_w"), "left").drop(f"{name}_k", f"{name}_w")


def with_means(df: DataFrame, by: list[str], means: dict[str, Column]) -> DataFrame:
    """``df`` with the means of its groups as columns: an aggregation and a join, so no group is gathered."""
    if not means:
        return df
    keys = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    found = df.groupBy(*keys).agg(*(F.avg(x).alias(n) for n, x in means.items()))
    if not by:
        return df.crossJoin(found)
    return df.join(found, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])


def semi(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows with COUNTIF(right, key) > 0."""
    keys = right.select(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values()))).distinct()
    return left.join(keys, [left[k] == F.col(f"_k{i}") for i, k in enumerate(on)], "left_semi")


def anti(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows with COUNTIF(right, key) = 0."""
    keys = right.select(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values()))).distinct()
    return left.join(keys, [left[k] == F.col(f"_k{i}") for i, k in enumerate(on)], "left_anti")


def per_row(left: DataFrame, right: DataFrame, on: dict[str, str], aggregates: dict[str, Column], defaults: dict[str, object] | None = None) -> DataFrame:
    """SUMIFS and its kin with keys of each row: one aggregation and one join."""
    totals = right.groupBy(*(F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values()))).agg(*(v.alias(k) for k, v in aggregates.items()))
    joined = left.join(totals, [left[k] == F.col(f"_k{i}") for i, k in enumerate(on)], "left")
    fill = defaults or {}
    return joined.select(*(left[c] for c in left.columns), *(F.coalesce(k, F.lit(fill[k])).alias(k) if k in fill else F.col(k) for k in aggregates))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """MMULT of long matrices (i, k, v) and (k, j, v): (i, j, v)."""
    left, right = a.select("i", "k", F.col("v").alias("x")), b.select("k", "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def database(df: DataFrame, criteria: list[dict[str, object]]) -> DataFrame:
    """Rows that meet one of the criteria in all its cells; unknown columns meet nothing, blank cells everything."""
    from quadrille.plans.compiler import type_of

    names = {c.lower(): c for c in df.columns}
    out = F.lit(False)
    for row in criteria:
        cells = F.lit(True)
        for name, want in row.items():
            if want in (None, ""):
                continue
            c = names.get(name.lower())
            cells = cells & (criterion(F.col(c), type_of(df.schema[c].dataType), want) if c else F.lit(False))
        out = out | cells
    return df.where(out)
