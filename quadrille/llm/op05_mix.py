"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words; a document's expected number of copies is target / source size.
The whole part is certain. The fractional parts are rounded in pairs: mass, weighed in words, moves at random
from one document to another until one of the two is integral, so the source's total stays what it was and each
document's expectation is kept. Documents are dealt by hash into groups of about ``fan_in``; a fold over each
group, the longest documents first so that a short one is left, ends with one undecided, and those are dealt and folded again, level by level, until each source
has one, which is decided by its own probability. Randomness is a hash of ids and seed: reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import WORD_RE, cut

WEIGHTS = (5, 2, 1)
LIMIT = 3
FAN_IN = 256

_ITEM = "struct<size:bigint,doc_id:bigint,at:bigint,p:double>"
#: Rows that one step of numbering rows alike makes at most.
_ALIKE = 1 << 14


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n, target): all words shared by weight, no target above ``limit`` times its source.

    Sources in code point order, null last, take the weights in turn. The excess of a capped source is shared
    by the others by weight until none is above: with sources ordered by limit·size/weight, that caps a first
    part of them, and a running total finds where it ends. The table has one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count("*").alias("n"))
    turn = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)
    caps = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    # The level that holds is that of the first source, in the same order, that stays below its cap; later ones of
    # equal ratio have a level that leaves out its share.
    first = F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level")
    held = F.min(F.when(F.col("free"), first)).over(everything)["level"]
    return levels.select("source", "source_size", "n", F.coalesce(F.least(F.col("weight") * held, F.col("cap")), F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _item(x: Column, p: Column) -> Column:
    return F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["at"].alias("at"), p.alias("p")).cast(_ITEM)


def _transfer(old: Column, new: Column, seed: int) -> Column:
    """(old, new): the two probabilities after mass has moved; one of them is 0 or 1."""
    up = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])  # words that can move to the old one
    down = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
    draw = _uniform(F.lit(seed), old["doc_id"], new["doc_id"], old["size"], old["at"], new["at"])

    def moved(m: Column) -> Column:
        both = lambda a, b: F.struct(a.cast("double").alias("old"), b.cast("double").alias("new"))
        cast_up = m["draw"] * (m["up"] + m["down"]) < m["down"]
        return (
            F.when(cast_up & (m["up"] >= (1 - old["p"]) * old["size"]), both(F.lit(1.0), new["p"] - m["up"] / new["size"]))
            .when(cast_up, both(old["p"] + m["up"] / old["size"], F.lit(0.0)))
            .when(m["down"] >= old["p"] * old["size"], both(F.lit(0.0), new["p"] + m["down"] / new["size"]))
            .otherwise(both(old["p"] - m["down"] / old["size"], F.lit(1.0)))
        )

    return _let(F.struct(up.alias("up"), down.alias("down"), draw.alias("draw")), moved)


def _fold(items: Column, seed: int) -> Column:
    """Decided documents (done) and the one left (open), from an array of undecided ones."""

    def step(state: Column, new: Column) -> Column:
        old = state["open"]

        def settle(q: Column) -> Column:
            old_done = q["old"].isin(0.0, 1.0)
            done = F.when(old_done, F.struct(old["size"].alias("size"), old["doc_id"].alias("doc_id"), q["old"].cast("int").alias("copies")))
            done = done.otherwise(F.struct(new["size"].alias("size"), new["doc_id"].alias("doc_id"), q["new"].cast("int").alias("copies")))
            rest = F.when(old_done, _item(new, q["new"])).otherwise(_item(old, q["old"]))
            return F.struct(rest.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

        first = F.struct(_item(new, new["p"]).alias("open"), state["done"].alias("done"))
        return F.when(old["size"].isNull(), first).otherwise(_let(_transfer(old, new, seed), settle))

    empty = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast("array<struct<size:bigint,doc_id:bigint,copies:int>>").alias("done"))
    return F.aggregate(items, empty, step)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, which counts those alike from 0, by counting them and making them anew."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("alike"))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("alike") - 1, F.lit(_ALIKE).cast("bigint")))
    stretch = counted.select("*", first.alias("first"))
    return stretch.select(*rows.columns, F.explode(F.sequence(F.col("first"), F.least(F.col("first") + _ALIKE, F.col("alike")) - 1)).alias("at"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT, seed: int = 17, fan_in: int = FAN_IN, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Size is the number of words (null text: 0); taken = copies · size, copies at most ``limit``. Documents of
    size 0 take nothing. A null source is a source, the last. Rows that repeat an id, null included, and have
    one source and size are told apart by a number, so they are dealt into groups like any others. Texts of any
    length count whole; further columns are ignored, whatever their names. An empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD_RE)).cast("bigint")
    sizes = cut(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source")))
    targets = cut(source_targets(sizes, weights, limit))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.least(F.floor(rate + 1e-12), F.lit(limit)).cast("int"))
    targets = targets.withColumn("part", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    targets = targets.withColumn("part", F.when(F.col("part") > 1e-12, F.col("part")).otherwise(0.0))
    rows = sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    fixed = (F.col("part") == 0) | (F.col("size") == 0)
    out = rows.where(fixed).select("doc_id", "source", "size", F.lit(0).alias("copies"))
    left = _numbered(rows.where(~fixed).select("doc_id", "source", "size", F.col("part").alias("p"), "n"))
    most = targets.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 0:
        last = most <= fan_in
        groups = F.ceil(F.col("n") / F.lit(fan_in))
        deal = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "at"), groups)
        folded = cut(
            left.groupBy("source", deal.alias("deal"))
            .agg(F.max(groups).alias("n"), F.sort_array(F.collect_list(F.struct("size", "doc_id", "at", "p")), asc=False).alias("items"))
            .select("source", "n", _fold(F.col("items"), seed + level).alias("x"))
        )
        out = out.unionByName(folded.select("source", F.explode("x.done").alias("d")).select("d.doc_id", "source", "d.size", "d.copies"))
        left = folded.select(F.col("x.open.doc_id").alias("doc_id"), "source", F.col("x.open.size").alias("size"), F.col("x.open.at").alias("at"), F.col("x.open.p").alias("p"), "n")
        most, level = (0 if last else -(-most // fan_in)), level + 1
    final = F.when(_uniform(F.lit(seed), F.lit("last"), F.col("doc_id"), F.col("at")) < F.col("p"), 1).otherwise(0)
    out = out.unionByName(left.select("doc_id", "source", "size", final.alias("copies"))) if level else out
    joined = out.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.col("copies") + F.col("whole")).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"), copies.cast("int").alias("copies"))
