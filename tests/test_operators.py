"""Pivots, joins, ordinals, files and streams against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrille.operators import joins, ordinals, relational
from quadrille.operators.pivot import PivotSpec, ValueField, grid, pivot
from quadrille.sources import delimited, xlsx
from quadrille.streaming import start, tumbling
from quadrille.workbook import Workbook


@pytest.fixture(scope="module")
def fuzz(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice(["East", "east", "WEST", "west", "North"]), r.choice(["10", "9", "x", ""]), float(r.randint(-100, 100)) if r.random() < 0.9 else None) for i in range(300)]
    return rows, spark.createDataFrame(rows, "_r long, Cat string, Mixed string, NumStr string, Amount double")


def test_pivot_levels(fuzz):
    rows, df = fuzz
    spec = PivotSpec(("Cat",), ("Mixed",), (ValueField("Amount"), ValueField("Amount", "count"), ValueField("Amount", "average"), ValueField("Amount", "max")))
    want = defaultdict(list)
    first = {}
    for _, cat, mixed, _, amount in rows:
        first.setdefault(mixed.lower(), mixed)
        for a in (cat or "(blank)", None):
            for b in (mixed.lower(), None):
                want[a, b].append(amount)
    got = {(r["Cat"], r["Mixed"]): r for r in pivot(df, spec, ["_r"]).collect()}
    assert len(got) == len(want)
    for (a, b), v in want.items():
        r, v = got[a, first.get(b)], [x for x in v if x is not None]
        assert (r["Sum of Amount"], r["Count of Amount"], r["Max of Amount"]) == (sum(v), len(v), max(v, default=None))
        assert r["Average of Amount"] == pytest.approx(sum(v) / len(v))


def test_pivot_grid(fuzz):
    _, df = fuzz
    spec = PivotSpec(("NumStr",), (), (ValueField("Amount"),)).where("Mixed", "EAST")
    lines = grid(df, spec, ["_r"])
    assert [x[0] for x in lines] == ["NumStr", "10", "9", "x", "(blank)", "Grand Total"]
    assert lines[-1][1] == sum(x[1] for x in lines[1:-1])
    assert spec.add("values", ValueField("Amount")).captions() == ["Sum of Amount", "Sum of Amount2"]
    assert spec.remove("NumStr").rows == ()


def test_empty_pivot(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert pivot(df, PivotSpec(("k",), (), (ValueField("v"),))).count() <= 1


def test_ordinals_and_asof(spark):
    r = random.Random(3)
    keys = r.sample(range(10000), 500)
    df = spark.createDataFrame([(k, f"n{k}") for k in keys], "k long, s string").repartition(7)
    got = {x["k"]: x["_r"] for x in ordinals.numbered(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    total = {x["k"]: x["t"] for x in ordinals.running_total(df, "k", "k", "t").collect()}
    assert all(total[k] == sum(x for x in keys if x < k) for k in keys[:40])
    left = spark.createDataFrame([(i, r.randint(-50, 11000)) for i in range(300)], "id long, v long")
    for below in (True, False):
        for row in joins.asof_lookup(left, df, "v", "k", {"near": "k"}, below=below).collect():
            side = [k for k in keys if (k <= row["v"] if below else k >= row["v"])]
            assert row["near"] == ((max(side) if below else min(side)) if side else None)


def test_asof_runs_one_way(spark):
    """No frame of all rows that follow, which is read anew for each row; blank keys are near nothing, and nothing is near them."""
    left = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate([("a", 1), ("a", 4), ("a", 9), ("b", 4), ("c", 4), ("b", None), (None, 4)])], "id int, g string, v int")
    right = spark.createDataFrame([("a", 4), ("a", 6), ("b", 5), ("b", 2), ("b", None), ("a", None)], "h string, k int")
    want = {
        (False, True): [None, 4, 6, 2, None, None, None], (False, False): [4, 4, None, 5, None, None, None],
        (True, True): [None, 4, 6, 4, 4, None, 4], (True, False): [2, 4, None, 4, 4, None, 4],
    }
    for (whole, below), near in want.items():
        out = joins.asof_lookup(left, right, "v", "k", {"near": "k"}, None if whole else {"g": "h"}, below)
        assert [r["near"] for r in out.orderBy("id").collect()] == near, (whole, below)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_lookup_ties_and_missing(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, None, "c")], "_r int, k int, v string")
    out = {x["k"]: x["v"] for x in joins.lookup(left, right, {"k": "k"}, {"v": "v"}, ["_r"], missing={"v": "-"}).collect()}
    assert out == {1: "a", 2: "-", None: "-"}
    out = {x["k"]: x["v"] for x in joins.lookup(left, right, {"k": "k"}, {"v": "v"}, ["_r"], last=True).collect()}
    assert out == {1: "b", 2: None, None: None}


def test_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 3, 5, 1]], "x double")
    assert sorted((r["x"], r["rank"]) for r in relational.rank(df, "x").collect()) == [(1, 4), (3, 3), (5, 1), (5, 1)]
    assert sorted((r["x"], r["rank"]) for r in relational.rank(df, "x", ascending=True, average=True).collect()) == [(1, 1), (3, 2), (5, 3.5), (5, 3.5)]


def test_xlsx_round_trip(spark, tmp_path):
    wb = Workbook(spark).sheet("Data", [["name", "n", "ok"], ["a<b", 1.5, True], ["é", -2, False]], header=True)
    path = tmp_path / "book.xlsx"
    path.write_bytes(xlsx.save(wb))
    back = xlsx.load(spark, str(path))
    assert [tuple(r)[1:] for r in back["Data"].orderBy("_r").collect()] == [("name", "n", "ok"), ("a<b", "1.5", "TRUE"), ("é", "-2", "FALSE")]
    sheet = xlsx.read_sheets(path.read_bytes())[0]
    assert sheet.cells[1, 1] == 1.5 and sheet.cells[2, 2] is False


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y"), (2, "z")], "a int, b string")
    for tab in (False, True):
        delimited.write_csv(df, str(tmp_path / f"c{tab}"), tab)
        assert sorted(map(tuple, delimited.read_csv(spark, str(tmp_path / f"c{tab}"), "a int, b string", tab).collect())) == [(1, "x,y"), (2, "z")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 3}", i * 40) for i in range(60)], "v long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    cells = lambda d: tumbling(d, "ts", "10 minutes", ["k"], {"n": F.count("*"), "v": F.sum("v")})
    q = start(cells(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "stream_test", str(tmp_path / "ck"), "complete")
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from stream_test").collect())) == sorted(map(tuple, cells(df).collect()))


def test_set_operators(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2, 3], [1, 3, 4]))
    assert sorted(r.x for r in relational.intersect(a, b, ["x"]).collect()) == [1, 1, 3]
    assert sorted(r.x for r in relational.except_(a, b, ["x"]).collect()) == [2]
    assert sorted(r.x for r in relational.unique(a, once=True).collect()) == [2, 3]


def test_filters_reach_the_scan(spark, tmp_path):
    from quadrille.plans import formula as fx
    from quadrille.workbook import Workbook

    spark.createDataFrame([(1, 5.0, "promo"), (2, 60.0, "PROMO"), (3, None, None), (4, 70.0, "Kilo")], "k int, x double, t string").write.parquet(str(tmp_path / "t"))
    wb = Workbook(spark)
    wb.add("t", spark.read.parquet(str(tmp_path / "t")), "k")
    for formula, keys, pushed in (
        ('FILTER(t,(t[x]>50)*(t[t]="promo"))', {2}, ["GreaterThan(x,50.0)", "In(t"]),
        ('FILTER(t,(t[x]<50)+(t[t]="kilo"))', {1, 3, 4}, ["Or("]),
        ('FILTER(t,AND(t[x]<>60,t[t]<>"PROMO"))', {3, 4}, ["Or("]),
        ("FILTER(t,t[x]=0)", {3}, ["Or("]),
        ("FILTER(t,70<=t[x])", {4}, ["GreaterThanOrEqual(x,70.0)"]),
    ):
        df = wb.evaluate(formula)
        assert {r.k for r in df.collect()} == keys, formula
        plan = df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert all(p in plan for p in pushed), (formula, plan)
    c = wb.compiler()
    cell = spark.range(1).select(c.value(fx.parse('SUMIFS(t[x],t[t],"PROMO",t[x],">50")')).col.alias("v"))
    assert cell.first().v == 60.0
    assert "GreaterThan(x,50.0)" in cell._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_batteries_against_sql(spark):
    """Every formula of the batteries against the SQL that computes its value another way."""
    import duckdb

    from quadrille.batteries import BATTERIES, battery_sql, value_rows

    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    try:
        for name, cells in BATTERIES.items():
            want = {r[0]: r[1:] for r in duckdb.sql(battery_sql(cells)).fetchall()}
            got = {r.formula: (r.number, r.text) for r in value_rows(spark, list(cells)).collect()}
            assert got == want, (name, {f: (got[f], want[f]) for f in want if got.get(f) != want[f]})
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
        spark.conf.unset("spark.sql.codegen.factoryMode")
