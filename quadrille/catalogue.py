"""Queries over the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.batteries import BATTERIES, battery_sql, value_rows
from quadrille.functions import fn
from quadrille.operators import joins, relational
from quadrille.operators.pivot import PivotSpec, ValueField, get_pivot_data, pivot
from quadrille.streaming import sessions, tumbling
from quadrille.workbook import Workbook

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Columns that give each table's rows an order.
ORDERS = {"orders": "o_orderkey", "events": "event_id", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}


def workbook(spark: SparkSession, sf_dir: str, *names: str) -> Workbook:
    wb = Workbook(spark)
    for n in names:
        wb.add(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), ORDERS.get(n, ()))
    return wb


def query(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return wrap


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def grouped(name: str, table: str, by: list[str], cells: dict[str, tuple[str, str]], digits: int = 4, where: str = "") -> None:
    """A query of aggregate formulas by group; cells map a name to its formula and SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(workbook(spark, sf_dir, table).group(table, by, {k: f for k, (f, _) in cells.items()}), digits)

    out = ", ".join([*by, *(f"round(({s})::DOUBLE, {digits}) + 0.0 AS {k}" for k, (_, s) in cells.items())])
    query(name, f"SELECT {out} FROM {table} {where} {'GROUP BY ' + ', '.join(by) if by else ''}")(run)


def filled(name: str, table: str, key: str, cells: dict[str, tuple[str, str]], digits: int = 4, more: tuple[str, ...] = ()) -> None:
    """A query of filled-down formulas."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = workbook(spark, sf_dir, table, *more).with_columns(table, {k: f for k, (f, _) in cells.items()})
        return rounded(df.select(key, *cells), digits)

    def shown(k: str, s: str) -> str:
        return f"{s[1:]} AS {k}" if s.startswith("~") else f"round(({s})::DOUBLE, {digits}) + 0.0 AS {k}"

    query(name, f"SELECT {key}, {', '.join(shown(k, s) for k, (_, s) in cells.items())} FROM {table}")(run)


def single(name: str, tables: tuple[str, ...], cells: dict[str, tuple[str, str]], digits: int = 4) -> None:
    """A query of one row of formula cells over whole tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quadrille.plans import formula as fx

        c = workbook(spark, sf_dir, *tables).compiler()
        return rounded(spark.range(1).select(*(c.value(fx.parse(f)).col.alias(k) for k, (f, _) in cells.items())), digits)

    query(name, f"SELECT {', '.join(f'round(({s})::DOUBLE, {digits}) + 0.0 AS {k}' for k, (_, s) in cells.items())}")(run)


# -- batteries ---------------------------------------------------------------------------------------


def battery(name: str, cells: dict[str, str]) -> None:
    query(name, battery_sql(cells))(lambda spark, sf_dir: value_rows(spark, list(cells)))


for _name, _cells in BATTERIES.items():
    battery(_name, _cells)

# -- aggregates --------------------------------------------------------------------------------------

_L = "lineitem"
grouped("agg_basic", _L, ["l_returnflag"], {
    "total": ("SUM([@l_quantity])", "sum(l_quantity)"), "mean": ("AVERAGE([@l_extendedprice])", "avg(l_extendedprice)"), "n": ("COUNT([@l_quantity])", "count(l_quantity)"),
    "filled_cells": ("COUNTA([@l_shipdate])", "count(l_shipdate)"), "least": ("MIN([@l_tax])", "min(l_tax)"), "most": ("MAX([@l_extendedprice])", "max(l_extendedprice)"), "blank": ("COUNTBLANK([@l_linestatus])", "count(*) FILTER (l_linestatus IS NULL OR l_linestatus = '')"),
})
grouped("agg_conditional", _L, ["l_linestatus"], {
    "sumifs": ('SUMIFS([@l_quantity],[@l_returnflag],"r",[@l_discount],">0.05")'.replace("[@", "lineitem["), "coalesce(sum(l_quantity) FILTER (lower(l_returnflag) = 'r' AND l_discount > 0.05), 0)"),
    "countifs": ('COUNTIFS(lineitem[l_tax],"<=0.02",lineitem[l_quantity],">25")', "count(*) FILTER (l_tax <= 0.02 AND l_quantity > 25)"),
    "averageifs": ('AVERAGEIFS(lineitem[l_extendedprice],lineitem[l_returnflag],"<>N")', "avg(l_extendedprice) FILTER (lower(l_returnflag) <> 'n')"),
    "maxifs": ('MAXIFS(lineitem[l_extendedprice],lineitem[l_quantity],10)', "coalesce(max(l_extendedprice) FILTER (l_quantity = 10), 0)"),
    "minifs": ('MINIFS(lineitem[l_extendedprice],lineitem[l_quantity],">=40")', "coalesce(min(l_extendedprice) FILTER (l_quantity >= 40), 0)"),
    "sumif": ('SUMIF(lineitem[l_returnflag],"A",lineitem[l_quantity])', "coalesce(sum(l_quantity) FILTER (lower(l_returnflag) = 'a'), 0)"),
    "countif": ('COUNTIF(lineitem[l_quantity],">45")', "count(*) FILTER (l_quantity > 45)"),
    "averageif": ('AVERAGEIF(lineitem[l_quantity],"<5")', "avg(l_quantity) FILTER (l_quantity < 5)"),
})
single("sumifs_cells", (_L, "part"), {
    "revenue": ('SUMIFS(lineitem[l_extendedprice],lineitem[l_returnflag],"R",lineitem[l_discount],">0.05")', "(SELECT coalesce(sum(l_extendedprice), 0) FROM lineitem WHERE lower(l_returnflag) = 'r' AND l_discount > 0.05)"),
    "share": ('SUM(lineitem[l_quantity])/COUNT(part[p_size])', "(SELECT sum(l_quantity) FROM lineitem) / (SELECT count(p_size) FROM part)"),
    "product": ("SUMPRODUCT(lineitem[l_extendedprice],1-lineitem[l_discount])", "(SELECT sum(l_extendedprice * (1 - l_discount)) FROM lineitem)"),
    "none": ('SUMIF(part[p_brand],"nothing",part[p_size])', "0"),
    "widgets": ('COUNTIF(part[p_name],"*widget")', "(SELECT count(*) FROM part WHERE p_name ILIKE '%widget')"),
    "olds": ('COUNTIF(part[p_name],"?old*")', "(SELECT count(*) FROM part WHERE p_name ILIKE '_old%')"),
    "not_promo": ('COUNTIF(part[p_type],"<>promo")', "(SELECT count(*) FROM part WHERE lower(p_type) <> 'promo')"),
})
grouped("agg_products", "part", ["p_brand"], {
    "squares": ("SUMSQ([@p_size])", "sum(p_size * p_size)"), "product_sum": ("SUMPRODUCT([@p_size],[@p_retailprice])", "sum(p_size * p_retailprice)"),
    "x2my2": ("SUMX2MY2([@p_retailprice],[@p_size])", "sum(p_retailprice * p_retailprice - p_size * p_size)"), "x2py2": ("SUMX2PY2([@p_retailprice],[@p_size])", "sum(p_retailprice * p_retailprice + p_size * p_size)"),
    "xmy2": ("SUMXMY2([@p_retailprice],[@p_size])", "sum((p_retailprice - p_size) * (p_retailprice - p_size))"), "share": ("PERCENTOF([@p_size],[@p_retailprice])", "sum(p_size) / sum(p_retailprice)"),
}, digits=2)
grouped("agg_subtotal", "supplier", ["s_nationkey"], {
    **{f"f{n}": (f"SUBTOTAL({n},[@s_acctbal])", s) for n, s in enumerate(("avg(s_acctbal)", "count(s_acctbal)", "count(s_acctbal)", "max(s_acctbal)", "min(s_acctbal)"), 1)},
    "f109": ("SUBTOTAL(109,[@s_acctbal])", "sum(s_acctbal)"), "f7": ("SUBTOTAL(7,[@s_acctbal])", "stddev_samp(s_acctbal)"), "f8": ("SUBTOTAL(8,[@s_acctbal])", "stddev_pop(s_acctbal)"),
    "f10": ("SUBTOTAL(10,[@s_acctbal])", "var_samp(s_acctbal)"), "f11": ("SUBTOTAL(11,[@s_acctbal])", "var_pop(s_acctbal)"), "a12": ("AGGREGATE(12,6,[@s_acctbal])", "median(s_acctbal)"),
    "a14": ("AGGREGATE(14,6,[@s_acctbal],1)", "max(s_acctbal)"), "a16": ("AGGREGATE(16,6,[@s_acctbal],0.25)", "quantile_cont(s_acctbal, 0.25)"),
}, digits=4)

# -- statistics ---------------------------------------------------------------------------------------

_PLACED = "(SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem)"


def _exc(k: float) -> str:
    return f"(SELECT max(x) FILTER (i = floor({k} * (n + 1))) + max({k} * (n + 1) - floor({k} * (n + 1))) * (max(x) FILTER (i = floor({k} * (n + 1)) + 1) - max(x) FILTER (i = floor({k} * (n + 1)))) FROM {_PLACED})"


single("order_stats", ("lineitem",), {
    "large10": ("LARGE(lineitem[l_extendedprice],10)", f"(SELECT max(x) FILTER (i = n - 9) FROM {_PLACED})"), "small5": ("SMALL(lineitem[l_extendedprice],5)", f"(SELECT max(x) FILTER (i = 5) FROM {_PLACED})"),
    "avedev": ("AVEDEV(lineitem[l_extendedprice])", "(SELECT avg(abs(l_extendedprice - m)) FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem))"),
    "p_exc": ("PERCENTILE.EXC(lineitem[l_extendedprice],0.9)", _exc(0.9)), "q_exc": ("QUARTILE.EXC(lineitem[l_extendedprice],1)", _exc(0.25)),
    "trim": ("TRIMMEAN(lineitem[l_extendedprice],0.1)", f"(SELECT avg(x) FILTER (i > floor(n * 0.1 / 2) AND i <= n - floor(n * 0.1 / 2)) FROM {_PLACED})"),
    "tied": ("PERCENTILE.EXC(lineitem[l_quantity],0.5)", "(SELECT median(l_quantity) FROM lineitem)"), "freq": ("INDEX(FREQUENCY(lineitem[l_quantity],{10,20}),2)", "(SELECT count(*) FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20)"),
}, digits=3)
_AT = "(SELECT p_retailprice AS y, p_size AS x, p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS i FROM part)"
single("regression_defaults", ("part",), {
    "slope": ("INDEX(LINEST(part[p_retailprice]),1)", f"(SELECT regr_slope(y, i) FROM {_AT})"), "base": ("INDEX(LOGEST(part[p_retailprice]),1)", f"(SELECT exp(regr_slope(ln(y), i)) FROM {_AT})"),
    "next": ("TREND(part[p_retailprice],,3000)", f"(SELECT regr_intercept(y, i) + regr_slope(y, i) * 3000 FROM {_AT})"), "start": ("TREND(part[p_retailprice])", f"(SELECT regr_intercept(y, i) + regr_slope(y, i) FROM {_AT})"),
    "first": ("GROWTH(part[p_retailprice],part[p_size])", f"(SELECT exp(regr_intercept(ln(y), x) + regr_slope(ln(y), x) * arg_min(x, k)) FROM {_AT})"),
}, digits=5)

_P = "p_retailprice"
grouped("stats_descriptive", "part", ["p_type"], {
    "var_s": (f"VAR.S([@{_P}])", f"var_samp({_P})"), "var_p": (f"VAR.P([@{_P}])", f"var_pop({_P})"), "sd_s": (f"STDEV.S([@{_P}])", f"stddev_samp({_P})"), "sd_p": (f"STDEV.P([@{_P}])", f"stddev_pop({_P})"),
    "skewness": (f"SKEW([@{_P}])", f"skewness({_P})"), "kurt": (f"KURT([@{_P}])", f"kurtosis({_P})"), "middle": (f"MEDIAN([@{_P}])", f"median({_P})"),
    "p_inc": (f"PERCENTILE.INC([@{_P}],0.9)", f"quantile_cont({_P}, 0.9)"), "q_inc": (f"QUARTILE.INC([@{_P}],3)", f"quantile_cont({_P}, 0.75)"),
    "devsq": (f"DEVSQ([@{_P}])", f"var_pop({_P}) * count({_P})"), "geo": (f"GEOMEAN([@{_P}])", f"exp(avg(ln({_P})))"), "har": (f"HARMEAN([@{_P}])", f"count({_P}) / sum(1 / {_P})"),
}, digits=3)
_SORTED = f"list_sort(list({_P}))"
grouped("stats_order", "part", ["p_brand"], {
    "large3": (f"LARGE([@{_P}],3)", f"list_reverse_sort(list({_P}))[3]"), "small2": (f"SMALL([@{_P}],2)", f"{_SORTED}[2]"),
    "p_exc": (f"PERCENTILE.EXC([@{_P}],0.5)", f"median({_P})"),
    "trim": (f"TRIMMEAN([@{_P}],0.2)", f"list_avg({_SORTED}[1 + floor(count({_P}) * 0.2 / 2)::INT : count({_P})::INT - floor(count({_P}) * 0.2 / 2)::INT])"),
    "rank_of_1000": (f"COUNTIF(part[{_P}],\">1000\")", f"count(*) FILTER ({_P} > 1000)"),
}, digits=3)


@query("stats_avedev", f"SELECT p_brand, round(avg(abs({_P} - m)), 4) AS avedev FROM (SELECT *, avg({_P}) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY p_brand")
def _avedev(spark, sf_dir):
    return rounded(workbook(spark, sf_dir, "part").group("part", ["p_brand"], {"avedev": f"AVEDEV([@{_P}])"}))


@query("stats_mode", "SELECT p_brand, p_size::DOUBLE AS mode FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS k FROM (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand, p_size)) WHERE k = 1 AND n > 1")
def _mode(spark, sf_dir):
    return workbook(spark, sf_dir, "part").group("part", ["p_brand"], {"mode": "MODE.SNGL([@p_size])"}).where("mode is not null")


grouped("stats_pairs", "part", ["p_type"], {
    "correl": ("CORREL([@p_size],[@p_retailprice])", "corr(p_size, p_retailprice)"), "cov_p": ("COVARIANCE.P([@p_size],[@p_retailprice])", "covar_pop(p_size, p_retailprice)"), "cov_s": ("COVARIANCE.S([@p_size],[@p_retailprice])", "covar_samp(p_size, p_retailprice)"),
    "slope": ("SLOPE([@p_retailprice],[@p_size])", "regr_slope(p_retailprice, p_size)"), "intercept": ("INTERCEPT([@p_retailprice],[@p_size])", "regr_intercept(p_retailprice, p_size)"), "rsq": ("RSQ([@p_retailprice],[@p_size])", "regr_r2(p_retailprice, p_size)"),
    "steyx": ("STEYX([@p_retailprice],[@p_size])", "sqrt((regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) ** 2 / regr_sxx(p_retailprice, p_size)) / (count(*) - 2))"),
    "forecast": ("FORECAST.LINEAR(30,[@p_retailprice],[@p_size])", "regr_intercept(p_retailprice, p_size) + regr_slope(p_retailprice, p_size) * 30"),
    "trend": ("TREND([@p_retailprice],[@p_size],12)", "regr_intercept(p_retailprice, p_size) + regr_slope(p_retailprice, p_size) * 12"),
    "growth": ("GROWTH([@p_retailprice],[@p_size],12)", "exp(regr_intercept(ln(p_retailprice), p_size) + regr_slope(ln(p_retailprice), p_size) * 12)"),
}, digits=3)


@query("stats_frequency", f"SELECT b::INT AS bin, count(*)::BIGINT AS n FROM (SELECT CASE WHEN {_P} <= 500 THEN 0 WHEN {_P} <= 1000 THEN 1 WHEN {_P} <= 1500 THEN 2 ELSE 3 END AS b FROM part) GROUP BY b")
def _frequency(spark, sf_dir):
    bounds = [500.0, 1000.0, 1500.0]
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    bin_ = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        bin_ = F.when(F.col(_P) <= b, i).otherwise(bin_)
    return df.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("stats_tests")
def _tests(spark, sf_dir):
    wb = workbook(spark, sf_dir, "part")
    return rounded(wb.group("part", ["p_brand"], {"t": "T.TEST([@p_size],[@p_retailprice],2,3)", "f": "F.TEST([@p_size],[@p_retailprice])", "z": "Z.TEST([@p_size],25)"}), 6)


@query("forecast_ets")
def _ets(spark, sf_dir):
    daily = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("v")).withColumn("t", F.datediff("day", F.lit("2024-01-01")).cast("double"))
    wb = Workbook(spark).add("daily", daily, "t")
    return rounded(wb.group("daily", ["event_type"], {"next": "FORECAST.ETS(40,[@v],[@t],7)", "season": "FORECAST.ETS.SEASONALITY([@v],[@t])", "alpha": "FORECAST.ETS.STAT([@v],[@t],1,7)"}))


# -- lookups and joins -----------------------------------------------------------------------------------


@query("vlookup_exact", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _vlookup(spark, sf_dir):
    wb = workbook(spark, sf_dir, "customer", "nation")
    return wb.with_columns("customer", {"n_name": "VLOOKUP([@c_nationkey],nation,2,FALSE)"}).select("c_custkey", "n_name")


@query("index_match", "SELECT s_suppkey, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def _index_match(spark, sf_dir):
    wb = workbook(spark, sf_dir, "supplier", "nation", "region")
    wb.define("supplier", {"rk": "INDEX(nation[n_regionkey],MATCH([@s_nationkey],nation[n_nationkey],0))"})
    return wb.with_columns("supplier", {"r_name": 'XLOOKUP([@rk],region[r_regionkey],region[r_name],"none")'}).select("s_suppkey", "r_name")


@query("xlookup_last", "SELECT c_custkey, (SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS priority FROM customer")
def _xlookup_last(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders"))
    return joins.lookup(c, o, {"c_custkey": "o_custkey"}, {"priority": "o_orderpriority"}, ["o_orderkey"], last=True).select("c_custkey", "priority")


@query("match_asof", "SELECT o_orderkey, (SELECT max(p_partkey) FROM part WHERE p_partkey <= o_custkey * 3) AS band FROM orders")
def _asof(spark, sf_dir):
    o, p = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "part"))
    return joins.asof_lookup(o.select("o_orderkey", (F.col("o_custkey") * 3).alias("k")), p, "k", "p_partkey", {"band": "p_partkey"}).select("o_orderkey", "band")


filled("lookups_near", "orders", "o_orderkey", {
    "size": ("VLOOKUP([@o_custkey]*3,part,5)", "(SELECT arg_max(p_size, p_partkey) FROM part WHERE p_partkey <= o_custkey * 3)"),
    "above": ("XLOOKUP([@o_custkey]*3,part[p_partkey],part[p_retailprice],-1,1)", "(SELECT coalesce(arg_min(p_retailprice, p_partkey), -1) FROM part WHERE p_partkey >= o_custkey * 3)"),
    "place": ("MATCH([@o_totalprice]/100,part[p_partkey])", "(SELECT CASE WHEN count(*) > 0 THEN count(*) END FROM part WHERE p_partkey <= o_totalprice / 100)"),
    "price": ("INDEX(part[p_retailprice],MATCH([@o_custkey]*3,part[p_partkey],1))", "(SELECT arg_max(p_retailprice, p_partkey) FROM part WHERE p_partkey <= o_custkey * 3)"),
    "before": ("LOOKUP([@o_custkey],supplier[s_suppkey],supplier[s_acctbal])", "(SELECT arg_max(s_acctbal, s_suppkey) FROM supplier WHERE s_suppkey <= o_custkey)"),
}, more=("part", "supplier"))
single("match_places", ("part", "orders"), {
    "first": ("MATCH(20,part[p_size],0)", "(SELECT count(*) FROM part WHERE p_partkey <= (SELECT min(p_partkey) FROM part WHERE p_size = 20))"),
    "last": ("XMATCH(20,part[p_size],0,-1)", "(SELECT count(*) FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE p_size = 20))"),
    "below": ("MATCH(700.5,orders[o_orderkey])", "(SELECT count(*) FROM orders WHERE o_orderkey <= 700.5)"),
    "above": ("MATCH(700.5,orders[o_orderkey],-1)", "(SELECT count(*) FROM orders WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 700.5))"),
    "missing": ("IFNA(MATCH(-1,orders[o_orderkey],0),-5)", "-5"),
})
filled("match_rows", "supplier", "s_suppkey", {"place": ("MATCH([@s_nationkey],nation[n_nationkey],0)", "(SELECT i FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) WHERE n_nationkey = s_nationkey)")}, more=("nation",))


@query("asof_by_group", "SELECT event_id, prev FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, arg_max(event_id, ts) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev FROM events) WHERE event_type = 'click'")
def _asof_group(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    buys = e.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"), F.col("event_id").alias("prev"))
    return joins.asof_lookup(e.where("event_type = 'click'"), buys, "ts", "t", {"prev": "prev"}, {"user_id": "u"}).select("event_id", "prev")


@query("semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _semi(spark, sf_dir):
    o, li = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem"))
    return joins.semi(o, li, {"o_orderkey": "l_orderkey"}).select("o_orderkey")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _anti(spark, sf_dir):
    o, li = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem"))
    return joins.anti(o, li, {"o_orderkey": "l_orderkey"}).select("o_orderkey")


@query("per_row_sumifs", "SELECT o_orderkey, round(coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), 0), 4) + 0.0 AS qty, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::DOUBLE AS n FROM orders")
def _per_row(spark, sf_dir):
    wb = workbook(spark, sf_dir, "orders", "lineitem")
    out = wb.with_columns("orders", {"qty": "SUMIFS(lineitem[l_quantity],lineitem[l_orderkey],[@o_orderkey])", "n": "COUNTIFS(lineitem[l_orderkey],[@o_orderkey])"})
    return rounded(out.select("o_orderkey", "qty", "n"))


@query("per_row_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total FROM orders")
def _per_row_total(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = joins.per_row(o, o, {"o_custkey": "o_custkey"}, {"customer_total": F.sum("o_totalprice")}, {"customer_total": 0.0})
    return rounded(out.select("o_orderkey", "customer_total"), 2)


@query("database_dsum", "SELECT round(sum(s_acctbal), 2) AS dsum, count(s_acctbal)::DOUBLE AS dcount, round(avg(s_acctbal), 4) AS daverage, max(s_acctbal) AS dmax FROM supplier WHERE (s_nationkey = 3 AND s_acctbal > 0) OR s_nationkey = 7")
def _database(spark, sf_dir):
    wb = workbook(spark, sf_dir, "supplier").sheet("want", [["s_nationkey", "s_acctbal"], ["3", ">0"], ["7", None]], header=True)
    cells = {k: f'{k.upper()}(supplier,"s_acctbal",want)' for k in ("dsum", "dcount", "daverage", "dmax")}
    c = wb.compiler()
    from quadrille.plans import formula as fx

    out = spark.range(1).select(*(c.value(fx.parse(f)).col.alias(k) for k, f in cells.items()))
    return out.select(F.round("dsum", 2).alias("dsum"), "dcount", F.round("daverage", 4).alias("daverage"), "dmax")


@query("mmult", "SELECT a.label AS i, b.label AS j, round(sum(a.s * b.s), 3) AS v FROM (SELECT label, k, sum(embedding[k]::DOUBLE) AS s FROM embeddings, range(1, 65) t(k) GROUP BY label, k) a JOIN (SELECT label, k, sum(embedding[k]::DOUBLE) AS s FROM embeddings, range(1, 65) t(k) GROUP BY label, k) b ON a.k = b.k GROUP BY a.label, b.label")
def _mmult(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("k", "x"))
    s = e.groupBy("label", "k").agg(F.sum(F.col("x").cast("double")).alias("v"))
    out = joins.matrix_product(s.withColumnRenamed("label", "i"), s.withColumnRenamed("label", "j"))
    return rounded(out, 3)


# -- pivots ------------------------------------------------------------------------------------------------

_SALES = PivotSpec(("l_returnflag", "l_linestatus"), (), (ValueField("l_quantity"), ValueField("l_extendedprice", "average"), ValueField("l_extendedprice", "count")))
_PIVOT_SQL = """SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS _level, round(sum(l_quantity), 2) AS "Sum of l_quantity", round(avg(l_extendedprice), 4) AS "Average of l_extendedprice",
count(l_extendedprice)::DOUBLE AS "Count of l_extendedprice" FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"""


@query("flagship_pivot", _PIVOT_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivot(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _SALES))


_CROSS = PivotSpec(("o_orderstatus",), ("o_orderpriority",), (ValueField("o_totalprice"), ValueField("o_orderkey", "countnumbers", "Orders")))


@query("pivot_crosstab", """SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS _level, round(sum(o_totalprice), 2) AS "Sum of o_totalprice", count(o_orderkey)::DOUBLE AS "Orders" FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def _crosstab(spark, sf_dir):
    return rounded(pivot(spark.read.parquet(f"{sf_dir}/orders.parquet"), _CROSS), 2)


@query("pivot_filter", """SELECT o_orderstatus, grouping(o_orderstatus)::BIGINT AS _level, max(o_totalprice) AS "Max of o_totalprice", min(o_totalprice) AS "Min of o_totalprice" FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ROLLUP (o_orderstatus)""")
def _pivot_filter(spark, sf_dir):
    spec = PivotSpec(("o_orderstatus",), (), (ValueField("o_totalprice", "max"), ValueField("o_totalprice", "min"))).where("o_orderpriority", "1-urgent", "2-High")
    return pivot(spark.read.parquet(f"{sf_dir}/orders.parquet"), spec)


@query("pivot_case_insensitive", """SELECT min(k) AS kind, 0::BIGINT AS _level, round(sum(value), 3) AS "Sum of value" FROM (SELECT value, lower(event_type) AS l, event_id, first_value(CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END) OVER (PARTITION BY lower(event_type) ORDER BY event_id) AS k FROM events) GROUP BY l""")
def _pivot_case(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return rounded(pivot(e, PivotSpec(("kind",), (), (ValueField("value"),), column_total=False), ["event_id"]), 3)


@query("getpivotdata", """SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'F'""")
def _getpivot(spark, sf_dir):
    cells = pivot(spark.read.parquet(f"{sf_dir}/orders.parquet"), _CROSS)
    return rounded(get_pivot_data(cells, _CROSS, "Sum of o_totalprice", o_orderstatus="f"), 2)


@query("groupby_fn", "SELECT p_brand, round(avg(p_size), 4) AS value FROM part GROUP BY p_brand")
def _groupby(spark, sf_dir):
    return rounded(workbook(spark, sf_dir, "part").evaluate("GROUPBY(part[p_brand],part[p_size],AVERAGE)"))


@query("pivotby_fn", "SELECT o_orderstatus, round(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 2) AS \"1-URGENT\", round(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 2) AS \"2-HIGH\" FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderstatus")
def _pivotby(spark, sf_dir):
    wb = workbook(spark, sf_dir, "orders")
    wb.add("orders", wb["orders"].where("o_orderpriority in ('1-URGENT', '2-HIGH')"), "o_orderkey")
    return rounded(wb.evaluate("PIVOTBY(orders[o_orderstatus],orders[o_orderpriority],orders[o_totalprice],SUM)"), 2)


# -- arrays --------------------------------------------------------------------------------------------------


@query("filter_fn", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def _filter(spark, sf_dir):
    return workbook(spark, sf_dir, "orders").evaluate('FILTER(orders[[o_orderkey]:[o_totalprice]],(orders[o_totalprice]>300000)*(orders[o_orderstatus]="f"))').select("o_orderkey", "o_totalprice")


@query("sort_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _sort_take(spark, sf_dir):
    return workbook(spark, sf_dir, "orders").evaluate("TAKE(SORTBY(orders[[o_orderkey]:[o_totalprice]],orders[o_totalprice],-1),25)").select("o_orderkey", "o_totalprice")


@query("take_last", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 7")
def _take_last(spark, sf_dir):
    return workbook(spark, sf_dir, "customer").evaluate("TAKE(customer[c_custkey],-7)")


@query("drop_first", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def _drop(spark, sf_dir):
    return workbook(spark, sf_dir, "customer").evaluate("DROP(customer[c_custkey],100)")


@query("choose_rows", "SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r IN (1, 3) OR r = n")
def _choose_rows(spark, sf_dir):
    return workbook(spark, sf_dir, "customer").evaluate("CHOOSEROWS(customer[[c_custkey]:[c_name]],1,3,-1)").select("c_custkey", "c_name")


@query("choose_cols", "SELECT n_regionkey, n_nationkey FROM nation")
def _choose_cols(spark, sf_dir):
    return workbook(spark, sf_dir, "nation").evaluate("CHOOSECOLS(nation,-1,1)")


@query("unique", "SELECT DISTINCT p_brand, p_type FROM part")
def _unique(spark, sf_dir):
    return workbook(spark, sf_dir, "part").evaluate("UNIQUE(part[[p_brand]:[p_type]])")


@query("unique_once", "SELECT p_retailprice FROM part GROUP BY p_retailprice HAVING count(*) = 1")
def _unique_once(spark, sf_dir):
    return workbook(spark, sf_dir, "part").evaluate("UNIQUE(part[p_retailprice],FALSE,TRUE)")


@query("vstack", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _vstack(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    return relational.vstack(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _union(spark, sf_dir):
    return relational.unique(_vstack(spark, sf_dir))


@query("set_intersect", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _intersect(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    return relational.intersect(c, s.where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"]).select("c_custkey")


@query("set_except", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _except(spark, sf_dir):
    c, s = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "supplier"))
    return relational.except_(c, s.where("s_acctbal > 5000").withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"]).select("c_custkey")


@query("hstack", "SELECT c.c_custkey, s.s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) c FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) s USING (r)")
def _hstack(spark, sf_dir):
    return workbook(spark, sf_dir, "customer", "supplier").evaluate("HSTACK(customer[c_custkey],supplier[s_suppkey])")


@query("wrap_rows", "SELECT (r // 3)::BIGINT AS _row, max(CASE WHEN r % 3 = 0 THEN p_partkey END) AS c1, max(CASE WHEN r % 3 = 1 THEN p_partkey END) AS c2, max(CASE WHEN r % 3 = 2 THEN p_partkey END) AS c3 FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY r // 3")
def _wrap(spark, sf_dir):
    return workbook(spark, sf_dir, "part").evaluate("WRAPROWS(part[p_partkey],3)")


@query("to_column", "SELECT n_nationkey, v AS value FROM (SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS v FROM nation)")
def _to_column(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return relational.to_column(n.select(F.col("n_nationkey").alias("k"), "n_nationkey", "n_regionkey"), ["k"]).select(F.col("k").alias("n_nationkey"), "value")


@query("expand", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, NULL FROM range(3)")
def _expand(spark, sf_dir):
    return workbook(spark, sf_dir, "region").evaluate("EXPAND(region,8)").select("r_regionkey", "r_name")


# -- windows ----------------------------------------------------------------------------------------------------


@query("rank_eq", "SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC)::DOUBLE AS r FROM part")
def _rank(spark, sf_dir):
    return relational.rank(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_retailprice", "r").select("p_partkey", "r")


@query("rank_avg", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r FROM part")
def _rank_avg(spark, sf_dir):
    return relational.rank(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_size", "r", ["p_brand"], ascending=True, average=True).select("p_partkey", "r")


@query("running_windows", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING), 3) AS moving, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS diff FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _running(spark, sf_dir):
    o, by, order = spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], ["o_orderkey"]
    run = relational.running(o, F.sum("o_totalprice"), by, order)
    move = relational.running(o, F.avg("o_totalprice"), by, order, (-2, 0))
    diff = F.col("o_totalprice") - relational.neighbour("o_totalprice", by, order, -1)
    return o.select("o_orderkey", F.round(run, 2).alias("running"), F.round(move, 3).alias("moving"), F.round(diff, 2).alias("diff"))


filled("percent_of_total", "supplier", "s_suppkey", {"share": ("[@s_acctbal]/SUM(supplier[s_acctbal])", "s_acctbal / (SELECT sum(s_acctbal) FROM supplier)")}, 6)

# -- scalars --------------------------------------------------------------------------------------------------------

_X, _B = "[@p_retailprice]", "[@p_size]"
filled("math_trig", "part", "p_partkey", {
    **{n.lower(): (f"{n}({_B}/60)", f"{n.lower()}(p_size / 60.0::DOUBLE)") for n in ("SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "SINH", "COSH", "TANH", "ASINH", "ATANH", "EXP", "DEGREES", "RADIANS")},
    "ln_": (f"LN({_X})", "ln(p_retailprice)"), "log10_": (f"LOG10({_X})", "log10(p_retailprice)"), "log2_": (f"LOG({_X},2)", "log2(p_retailprice)"), "sqrt_": (f"SQRT({_X})", "sqrt(p_retailprice)"), "power_": (f"{_B}^1.5", "p_size ** 1.5::DOUBLE"),
    "atan2_": (f"ATAN2({_B},{_X})", "atan2(p_retailprice, p_size)"), "sign_": (f"SIGN({_B}-25)", "sign(p_size - 25)"), "abs_": (f"ABS(25-{_B})", "abs(25 - p_size)"), "sec_": (f"SEC({_B}/60)", "1 / cos(p_size / 60.0::DOUBLE)"), "acot_": (f"ACOT({_B})", "atan(1.0::DOUBLE / p_size)"),
}, 5)
filled("math_rounding", "part", "p_partkey", {
    "round_": (f"ROUND({_X}/7,1)", "round(p_retailprice / 7, 1)"), "int_": (f"INT(-{_X}/7)", "floor(-p_retailprice / 7)"), "up": (f"ROUNDUP({_X}/7,0)", "ceil(p_retailprice / 7)"), "down": (f"ROUNDDOWN(-{_X}/7,0)", "ceil(-p_retailprice / 7)"),
    "trunc_": (f"TRUNC(-{_X}/7)", "trunc(-p_retailprice / 7)"), "ceiling_": (f"CEILING({_X},50)", "ceil(p_retailprice / 50) * 50"), "floor_": (f"FLOOR({_X},50)", "floor(p_retailprice / 50) * 50"), "mround_": (f"MROUND({_B},6)", "floor(p_size / 6.0::DOUBLE + 0.5) * 6"),
    "even_": (f"EVEN({_B})", "ceil(p_size / 2.0::DOUBLE) * 2"), "odd_": (f"ODD({_B})", "ceil((p_size - 1) / 2.0::DOUBLE) * 2 + 1"), "mod_": (f"MOD({_B},-7)", "p_size - (-7) * floor(p_size / -7.0::DOUBLE)"), "quotient_": (f"QUOTIENT({_B},7)", "p_size // 7"),
})
filled("math_counting", "part", "p_partkey", {
    "fact_": (f"FACT(MOD({_B},10))", "factorial((p_size % 10)::INT)"), "combin_": (f"COMBIN({_B},2)", "CASE WHEN p_size > 1 THEN p_size * (p_size - 1) / 2 END"), "permut_": (f"PERMUT({_B}+2,2)", "(p_size + 2) * (p_size + 1)"), "sumseries": ("SUM(SEQUENCE(10))", "55"),
    "bitand_": (f"BITAND({_B},12)", "p_size & 12"), "bitor_": (f"BITOR({_B},12)", "p_size | 12"), "bitxor_": (f"BITXOR({_B},12)", "xor(p_size, 12)"), "shift": (f"BITLSHIFT({_B},3)", "p_size << 3"), "delta_": (f"DELTA({_B},10)", "(p_size = 10)::INT"), "gestep_": (f"GESTEP({_B},10)", "(p_size >= 10)::INT"),
    "back": (f"BIN2DEC(DEC2BIN({_B}))", "p_size"), "hexed": (f"HEX2DEC(DEC2HEX(-{_B}))", "-p_size"), "based": (f"DECIMAL(BASE({_B},7),7)", "p_size"),
})
filled("text_battery", "part", "p_partkey", {
    "upper_": ("UPPER([@p_name])", "~upper(p_name)"), "left_": ("LEFT([@p_name],3)", "~left(p_name, 3)"), "right_": ("RIGHT([@p_name],4)", "~right(p_name, 4)"), "mid_": ("MID([@p_name],2,4)", "~substring(p_name, 2, 4)"), "len_": ("LEN([@p_name])", "length(p_name)"),
    "concat_": ('[@p_brand]&"-"&[@p_size]', "~p_brand || '-' || p_size"), "find_": ('FIND(" ",[@p_name])', "instr(p_name, ' ')"), "sub_": ('SUBSTITUTE([@p_name]," ","_")', "~replace(p_name, ' ', '_')"), "rept_": ('REPT("ab",MOD([@p_size],3))', "~repeat('ab', (p_size % 3)::INT)"),
    "after_": ('TEXTAFTER([@p_name]," ")', "~substring(p_name, instr(p_name, ' ') + 1)"), "before_": ('TEXTBEFORE([@p_name]," ")', "~left(p_name, instr(p_name, ' ') - 1)"), "test_": ('IF(REGEXTEST([@p_name],"wid"),1,0)', "regexp_matches(p_name, 'wid')::INT"), "value_": ('VALUE(MID([@p_brand],7,2))', "substring(p_brand, 7)::DOUBLE"),
    "exact_": ("IF(EXACT([@p_type],UPPER([@p_type])),1,0)", "(p_type = upper(p_type))::INT"), "search_": ('IFERROR(SEARCH("W?D",[@p_name]),0)', "CASE WHEN regexp_matches(lower(p_name), 'w.d') THEN instr(lower(p_name), regexp_extract(lower(p_name), 'w.d')) ELSE 0 END"), "join_": ('TEXTJOIN("|",TRUE,[@p_type],"",[@p_brand])', "~p_type || '|' || p_brand"),
    "replace_": ('REPLACE([@p_name],1,2,"XY")', "~'XY' || substring(p_name, 3)"), "proper_": ("PROPER([@p_name])", "~array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"), "fixed_": ("FIXED([@p_size]*1000,1)", "~format('{:,.1f}', p_size * 1000.0::DOUBLE)"),
})
_D = "[@o_orderdate]"
filled("date_battery", "orders", "o_orderkey", {
    "y": (f"YEAR({_D})", "year(o_orderdate)"), "m": (f"MONTH({_D})", "month(o_orderdate)"), "d": (f"DAY({_D})", "day(o_orderdate)"), "wd": (f"WEEKDAY({_D})", "dayofweek(o_orderdate) + 1"), "wd2": (f"WEEKDAY({_D},2)", "isodow(o_orderdate)"), "iso": (f"ISOWEEKNUM({_D})", "week(o_orderdate)"),
    "serial": (f"INT({_D})", "date_diff('day', DATE '1899-12-30', o_orderdate::DATE)"), "eom": (f"EOMONTH({_D},1)", "date_diff('day', DATE '1899-12-30', last_day(o_orderdate::DATE + INTERVAL 1 MONTH))"), "ed": (f"INT(EDATE({_D},-2))", "date_diff('day', DATE '1899-12-30', (o_orderdate::DATE - INTERVAL 2 MONTH)::DATE)"),
    "made": (f"DATE(YEAR({_D}),MONTH({_D})+1,1)", "date_diff('day', DATE '1899-12-30', (date_trunc('month', o_orderdate::DATE) + INTERVAL 1 MONTH)::DATE)"), "days": (f"DAYS({_D},DATE(1992,1,1))", "date_diff('day', DATE '1992-01-01', o_orderdate::DATE)"), "frac": (f"YEARFRAC(DATE(1992,1,1),{_D},3)", "date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 365.0::DOUBLE"),
    "week": (f"WEEKNUM({_D})", "ceil((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate))) / 7.0::DOUBLE)"), "months": (f'DATEDIF(DATE(1990,1,1),{_D},"M")', "date_diff('month', DATE '1990-01-01', o_orderdate::DATE)"),
    "work": (f"NETWORKDAYS({_D},{_D}+20)", "(SELECT count(*) FROM range(0, 21) t(i) WHERE isodow(o_orderdate::DATE + i::INT) < 6)"),
}, 5)
filled("logic_battery", "part", "p_partkey", {
    "if_": (f"IF({_B}>25,1,IF({_B}>10,2,3))", "CASE WHEN p_size > 25 THEN 1 WHEN p_size > 10 THEN 2 ELSE 3 END"), "ifs_": (f"IFS({_B}<10,1,{_B}<20,2,TRUE,3)", "CASE WHEN p_size < 10 THEN 1 WHEN p_size < 20 THEN 2 ELSE 3 END"),
    "switch_": ('SWITCH([@p_type],"PROMO",1,"ECONOMY",2,9)', "CASE p_type WHEN 'PROMO' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 9 END"), "choose_": (f"CHOOSE(MOD({_B},3)+1,10,20,30)", "(p_size % 3 + 1) * 10"), "xor_": (f"IF(XOR({_B}>25,{_X}>1000),1,0)", "((p_size > 25) <> (p_retailprice > 1000))::INT"),
    "and_": (f'IF(AND({_B}>25,[@p_type]="promo"),1,0)', "(p_size > 25 AND lower(p_type) = 'promo')::INT"), "or_": (f"IF(OR({_B}>40,{_X}<100),1,0)", "(p_size > 40 OR p_retailprice < 100)::INT"), "safe": (f"IFERROR(1/({_B}-10),-1)", "CASE WHEN p_size = 10 THEN -1 ELSE 1.0::DOUBLE / (p_size - 10) END"),
    "err": (f"IF(ISERROR(SQRT({_B}-20)),1,0)", "(p_size < 20)::INT"), "code": (f"IFERROR(ERROR.TYPE(1/({_B}-10)),0)", "CASE WHEN p_size = 10 THEN 2 ELSE 0 END"), "let_": (f"LET(a,{_B}*2,b,a+1,a*b)", "p_size * 2 * (p_size * 2 + 1)"), "even_": (f"IF(ISEVEN({_B}),1,0)", "(p_size % 2 = 0)::INT"),
})
_R, _N = "[@p_size]/1000", "12"
filled("finance_battery", "part", "p_partkey", {
    "pmt": (f"PMT({_R}+0.001,{_N},{_X})", "-p_retailprice * (p_size / 1000.0 + 0.001)::DOUBLE / (1 - (1 + (p_size / 1000.0 + 0.001)::DOUBLE) ** -12)"), "fv": (f"FV(0.01,{_N},-{_X})", "p_retailprice * (1.01::DOUBLE ** 12 - 1) / 0.01::DOUBLE"), "pv": (f"PV(0.01,{_N},-{_X})", "p_retailprice * (1 - 1.01::DOUBLE ** -12) / 0.01::DOUBLE"),
    "nper": (f"NPER(0.01,-{_X}/10,{_X})", "ln(0.1::DOUBLE / (0.1::DOUBLE - 0.01::DOUBLE)) / ln(1.01::DOUBLE)"), "sln": (f"SLN({_X},100,10)", "(p_retailprice - 100) / 10"), "syd": (f"SYD({_X},100,10,3)", "(p_retailprice - 100) * 8 / 55"), "effect": ("EFFECT(0.05,12)", "(1 + 0.05::DOUBLE / 12) ** 12 - 1"), "nominal": ("NOMINAL(0.05,12)", "12 * (1.05::DOUBLE ** (1 / 12.0::DOUBLE) - 1)"),
    "rri": (f"RRI(10,100,{_X})", "(p_retailprice / 100) ** 0.1::DOUBLE - 1"), "ispmt": (f"ISPMT(0.01,3,12,{_X})", "p_retailprice * 0.01::DOUBLE * 3 / 12 - p_retailprice * 0.01::DOUBLE"), "ipmt": (f"IPMT(0.01,1,12,{_X})", "-p_retailprice * 0.01::DOUBLE"), "tbill": ("TBILLPRICE(DATE(2008,3,31),DATE(2008,6,1),0.09)", "98.45"), "dollar": ("DOLLARDE(1.02,16)", "1.125"),
}, 6)


@query("finance_kernels")
def _finance(spark, sf_dir):
    cells = {
        "rate": f"RATE(12,-{_X}/10,{_X})", "ddb": f"DDB({_X},100,10,2)", "db": f"DB({_X}+200,100,10,2)", "vdb": f"VDB({_X},100,10,0,1.5)", "price": "PRICE(DATE(2008,2,15),DATE(2017,11,15),0.0575,0.065,100,2)", "yield": "YIELD(DATE(2008,2,15),DATE(2016,11,15),0.0575,95.04287,100,2)",
        "duration": "DURATION(DATE(2018,7,1),DATE(2048,1,1),0.08,0.09,2,1)", "coupnum": "COUPNUM(DATE(2007,1,25),DATE(2008,11,15),2,1)", "disc": "DISC(DATE(2018,7,1),DATE(2048,1,1),97.975,100,1)", "accrint": "ACCRINT(DATE(2008,3,1),DATE(2008,8,31),DATE(2008,5,1),0.1,1000,2,0)",
    }
    wb = workbook(spark, sf_dir, "part")
    return rounded(wb.with_columns("part", cells).select("p_partkey", *cells), 6)


@query("finance_series", "SELECT o_custkey, round(sum(o_totalprice / 1.1::DOUBLE ** i), 2) AS npv FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY o_custkey")
def _series(spark, sf_dir):
    return rounded(workbook(spark, sf_dir, "orders").group("orders", ["o_custkey"], {"npv": "NPV(0.1,[@o_totalprice])"}), 2)


@query("distributions")
def _distributions(spark, sf_dir):
    z = f"({_B}-25)/10"
    cells = {
        "norm": f"NORM.S.DIST({z},TRUE)", "inv": f"NORM.S.INV({_B}/100)", "t": f"T.DIST({z},5,TRUE)", "chi": f"CHISQ.DIST.RT({_B},10)", "f": f"F.DIST.RT({_B}/10,4,8)", "beta": f"BETA.DIST({_B}/100,2,3,TRUE)", "gamma": f"GAMMA.DIST({_B},3,4,TRUE)", "binom": f"BINOM.DIST(3,{_B},0.2,TRUE)", "poisson": f"POISSON.DIST(4,{_B}/10,FALSE)",
        "weibull": f"WEIBULL.DIST({_B},2,20,TRUE)", "expon": f"EXPON.DIST({_B},0.1,TRUE)", "lognorm": f"LOGNORM.DIST({_B},3,1,TRUE)", "hyp": "HYPGEOM.DIST(1,4,8,20,TRUE)", "erf": f"ERF({z})", "besselj": f"BESSELJ({_B}/5,2)", "im": f'IMABS(COMPLEX({_B},4))', "convert": f'CONVERT({_B},"mi","km")', "roman": f"ARABIC(ROMAN({_B}))",
    }
    return rounded(workbook(spark, sf_dir, "part").with_columns("part", cells).select("p_partkey", *cells), 6)


# -- lambdas, documents, streams -----------------------------------------------------------------------------------------


@query("lambda_map", "SELECT p_partkey, list_sum(list_transform(range(1, p_size + 1), lambda x: x * x))::DOUBLE AS squares, (p_size * (p_size + 1) / 2)::DOUBLE AS total, (p_size * (p_size + 1) / 2)::DOUBLE AS last_scan, (p_size % 4 + 1)::DOUBLE AS cells FROM part")
def _lambda(spark, sf_dir):
    cells = {
        "squares": f"SUM(MAP(SEQUENCE({_B}),LAMBDA(x,x*x)))", "total": f"REDUCE(0,SEQUENCE({_B}),LAMBDA(a,x,a+x))", "last_scan": f"MAX(SCAN(0,SEQUENCE({_B}),LAMBDA(a,x,a+x)))", "cells": f"COUNT(MAKEARRAY(1,MOD({_B},4)+1,LAMBDA(r,c,r*c)))",
    }
    return workbook(spark, sf_dir, "part").with_columns("part", cells).select("p_partkey", *cells)


@query("byrow", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity + l_extendedprice, 2) AS total FROM lineitem")
def _byrow(spark, sf_dir):
    out = workbook(spark, sf_dir, "lineitem").with_columns("lineitem", {"total": "BYROW(lineitem[[l_quantity]:[l_extendedprice]],LAMBDA(r,SUM(r)))"})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("total", 2).alias("total"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("filter_xml")
def _xml(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select("r_regionkey", fn("FILTERXML")(F.concat(F.lit("<a><b>"), "r_name", F.lit("</b></a>")), F.lit("/a/b")).alias("name"))


@query("tumbling_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def _tumbling(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(tumbling(e, "ts", "1 hour", ["event_type"], {"n": F.count("*"), "total": F.sum("value")}), 3)


@query("session_window", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, s FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def _session(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sessions(e, "ts", "6 hours", ["user_id"], {"k": F.count("*")}).groupBy("user_id").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
