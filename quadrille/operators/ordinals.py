"""Global row numbers and running totals that no single task has to see all rows for."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed(df: DataFrame) -> DataFrame:
    """Materialised in the folder that all executors share: the session's checkpoint folder, else a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quadrille-')}")
    return df.checkpoint(eager=True)


def _parted(df: DataFrame, order: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows dealt by ranges, once: ranges come from samples, which differ from run to run."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fixed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str] | tuple[str, ...], name: str = "_r", start: int = 0) -> DataFrame:
    """Adds 0, 1, … (from ``start``) in the order of the columns; ties in ``order`` are numbered arbitrarily.

    The range-partitioned rows feed both the offsets and the numbering.
    """
    parted = _parted(df, order)
    sizes = parted.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_in") - 1 + start).drop("_part", "_in", "_offset")


def running_total(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of a column without repeats."""
    parted = _parted(df, [order])
    sums = parted.groupBy("_part").agg(F.sum(value).alias("s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_in")).drop("_part", "_in", "_offset")
