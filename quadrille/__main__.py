"""Command line: python -m quadrille FILE.xlsx|TABLE.parquet… [--eval FORMULA] [--read TABLE] [--export TABLE --to PATH --format csv|tsv|json]."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from quadrille.sources import delimited, xlsx
from quadrille.workbook import Workbook


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quadrille", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("--eval", action="append", default=[], metavar="FORMULA")
    p.add_argument("--read", action="append", default=[], metavar="TABLE")
    p.add_argument("--info", action="store_true")
    p.add_argument("--export", metavar="TABLE")
    p.add_argument("--to", metavar="PATH")
    p.add_argument("--format", choices=("csv", "tsv", "json"), default="csv")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    wb = Workbook(spark)
    for f in a.files:
        if f.endswith(".xlsx"):
            wb.tables |= xlsx.load(spark, f).tables
        else:
            wb.add(Path(f).name.split(".")[0], delimited.read_parquet(spark, f))
    if a.info:
        for t in wb.tables.values():
            print(t.name, ", ".join(f"{n} {k}" for n, k in t.df.dtypes))
    for f in a.eval:
        wb.evaluate(f).show(truncate=False)
    for t in a.read:
        wb[t].show(truncate=False)
    if a.export:
        if not a.to:
            p.error("--export needs --to")
        df = wb[a.export]
        delimited.write_json(df, a.to) if a.format == "json" else delimited.write_csv(df, a.to, a.format == "tsv")


if __name__ == "__main__":
    main()
