"""Benchmark decontamination with SimHash windows, in DataFrame operations only.

A document's word shingles are hashed in place. Those in the benchmark's bitmap are joined with the item sizes
that have them (an equality join), and every window of an item's size that begins with such a shingle and holds
as many as the similarity takes is looked at, in whatever order they stand. A window that begins with another
shingle is no better than the next one, and the last window of a text is looked at too. Each window gets a
64-bit SimHash. Fingerprints are cut into four blocks of 16 bits; two that differ in at most ``radius`` bits differ
in at most a quarter of that in one block at least. So the index holds each block of an item under all values
within a quarter of the radius, and joining on (item size, block, value) gives every item within the radius, and of
others about one in seven. Candidates are then compared exactly, by the weighted Jaccard similarity of their
shingles (weight: number of occurrences).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut, words_column

SHINGLE = 5
SIMILARITY = 0.8
#: Mean distance at similarity 0.8 is 9.7 of 64 bits with a deviation of 2.9; one in a thousand such pairs is beyond.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Bitmap bits for each benchmark shingle, and the most bits that ride along with each document's row.
BITS_PER_SHINGLE = 64
BITMAP_LIMIT = 1 << 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lowest bit of each lane, by the lane's bits; 16 hold the sums of up to 65,535 hashes.
_LANES = {16: 0x0001000100010001, 32: 0x0000000100000001}


def _hashes(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles of a word array, in order, with repeats."""
    return F.transform(
        F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(k))),
    )


def _tagged(hashes: Column) -> Column:
    """Distinct stand-ins for the members of a bag: equal hashes are numbered."""
    ordered = F.array_sort(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h)))


def _lane_sums(hashes: Column, lane: int = 16) -> Column:
    """Sums of lanes of so many bits: lane j of sum g counts the hashes with bit g + lane * j."""

    def one(g: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s + F.shiftrightunsigned(h, g).bitwiseAND(F.lit(_LANES[lane])))

    return F.array(*(one(g) for g in range(lane)))


def _simhash(sums: Column, n: Column, lane: int = 16) -> Column:
    """The 64 majority votes of n hashes, from their lane sums."""
    word = F.lit(0).cast("bigint")
    for bit in range(64):
        count = F.shiftrightunsigned(sums[bit % lane], lane * (bit // lane)).bitwiseAND(F.lit((1 << lane) - 1))
        word = word.bitwiseOR(F.when(count * 2 > n, F.shiftleft(F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")))
    return word


def _blocks(fingerprint: Column) -> Column:
    """The fingerprint's blocks, as (block, value) pairs."""
    value = lambda b: F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    return F.array(*(F.struct(F.lit(b).alias("block"), value(b).alias("value")) for b in range(BLOCKS)))


def _around(radius: int) -> Column:
    """Differences of a block's value from those within its part of the radius."""
    near = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius // BLOCKS]
    return F.from_json(F.lit(str(near)), "array<int>")


def _prints(windows: DataFrame, lane: int) -> DataFrame:
    """Adds the SimHash, computed once, and its blocks, one row each."""
    # An explode of one element keeps sums and fingerprint from being computed again for each use.
    summed = windows.withColumn("sums", F.explode(F.array(_lane_sums(F.col("hashes"), lane))))
    marked = summed.withColumn("print", F.explode(F.array(_simhash(F.col("sums"), F.size("hashes"), lane)))).drop("sums", "hashes")
    return marked.withColumn("b", F.explode(_blocks(F.col("print")))).select("*", "b.block", "b.value").drop("b")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per document and item with a similar window: doc_id, item_id, start_word, similarity (the best).

    A-Z are lower-cased; words are runs of non-space characters. Items of fewer than ``shingle`` words count as
    one shingle; wordless or null items and texts match nothing; a text shorter than an item matches as a whole
    window. Of equal best windows that begin with
    a shared shingle or end with the text, the first is reported. Windows of a passage are about a ninth of its
    length, so the work grows with the square of an item's words. Rows that repeat an id are one document here. Texts
    of any length are looked at whole; further columns of either table are ignored, whatever their names. Empty
    tables give an empty result.
    """
    lower = lambda c: words_column(F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), _UPPER, _LOWER))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), lower(item_text).alias("words")).where(F.size("words") > 0)
    items = cut(items.withColumn("len", F.size("words")).withColumn("k", F.least("len", F.lit(shingle))))
    widths = [r.k for r in items.select("k").distinct().orderBy("k").collect()]  # at most ``shingle`` numbers
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lower(text_col).alias("words"))
    parts = [_contaminated(texts, items.where(F.col("k") == k), k, similarity, radius) for k in widths]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start_word int, similarity double")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _contaminated(texts: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame:
    items = cut(items.select("item_id", "len", _hashes(F.col("words"), k).alias("hashes")))
    seeds = items.select("item_id", "len", F.posexplode("hashes").alias("at", "hash"))
    longest, n = items.agg(F.max(F.size("hashes")), F.sum(F.size("hashes"))).first()
    lane = 16 if longest < 1 << 16 else 32

    hashed = texts.select("doc_id", F.explode(F.array(_hashes(F.col("words"), k))).alias("hashes")).where(F.size("hashes") > 0)
    bits = 1 << max(10, (BITS_PER_SHINGLE * n - 1).bit_length())
    if bits <= BITMAP_LIMIT:
        # One row, of at most BITMAP_LIMIT bits, which says where a benchmark shingle may stand.
        places = seeds.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("h")).select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit"))
        words = places.groupBy(F.shiftrightunsigned("bit", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
        lookup = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
        bitmap = cut(lookup.select(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bits // 64 - 1).cast("bigint")), lambda w: F.coalesce(F.try_element_at(F.col("m"), w), F.lit(0).cast("bigint"))).alias("bitmap"))).first()[0]
        sheet = F.array(*(F.lit(v).cast("bigint") for v in bitmap)) if len(bitmap) <= 64 else F.from_json(F.lit(str(bitmap)), "array<bigint>")

        def there(h: Column) -> Column:
            at = h.bitwiseAND(F.lit(bits - 1))
            word = F.get(sheet, F.shiftrightunsigned(at, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        maybe = F.filter(F.transform(F.col("hashes"), lambda h, i: F.when(there(h) & there(F.shiftrightunsigned(h, 32)), i)), lambda i: i.isNotNull())
    else:  # a benchmark of that size is joined with every shingle instead
        maybe = F.transform(F.col("hashes"), lambda h, i: i)

    # Similarity s of n and m shingles takes s (n + m) / (1 + s) shared ones, and so s times the larger number at least.
    shingles = F.col("len") - k + 1
    fewest = items.agg(F.min(F.ceil(F.lit(similarity) * shingles - 1e-9))).first()[0]
    marked = hashed.select("doc_id", "hashes", F.explode(F.array(maybe)).alias("maybe")).where(F.size("maybe") >= fewest)
    marked = cut(marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", "hashes", "maybe"))
    hits = marked.select("row", F.size("hashes").alias("total"), F.explode(F.transform("maybe", lambda i: F.struct(i.alias("pos"), F.get("hashes", i).alias("hash")))).alias("h")).select("row", "total", "h.pos", "h.hash")
    shared = hits.join(seeds.select("hash", "len").distinct(), "hash").groupBy("row", "total", "len").agg(F.collect_list("pos").alias("at"))
    shared = shared.select("row", "total", "len", F.explode(F.array(F.array_sort("at"))).alias("at"))
    width = F.least("total", shingles)
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (width + shingles) - 1e-9).cast("int")

    def begins(pos: Column, i: Column) -> Column:
        """The window from a shared shingle on, or the text's last one, if it holds enough of them."""
        start = F.least(pos, F.col("total") - width)
        return F.when(F.get("at", i + F.col("need") - 1) < start + width, start)

    starts = shared.withColumn("need", need).select("row", "len", F.explode(F.array_distinct(F.filter(F.transform("at", begins), lambda x: x.isNotNull()))).alias("start"))
    windows = marked.select("row", "doc_id", "hashes").join(starts, "row").select("doc_id", "len", "start", F.slice("hashes", F.col("start") + 1, shingles).alias("hashes"))
    # Rows that repeat an id, or have none, keep a window each where their texts differ.
    windows = cut(windows.distinct())
    # Equal passages are fingerprinted and compared once, however many documents have them.
    passages = cut(windows.groupBy("len", "hashes").agg(F.count("*").alias("n")).withColumn("passage", F.xxhash64("len", "hashes")))
    a = _prints(passages.select("passage", "len", "hashes"), lane)
    b = cut(_prints(items, lane)).withColumnRenamed("print", "item_print")
    index = b.select("item_id", "len", "block", F.explode(F.transform(_around(radius), lambda m: m.bitwiseXOR(F.col("value")))).alias("value"), "item_print")
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    # The index is some thousand times the benchmark, which Spark does not see: it must not be broadcast.
    candidates = a.join(index.hint("merge"), ["len", "block", "value"]).where(within).select("passage", "item_id", "len").distinct()
    candidates = cut(candidates.join(passages.select("passage", "len", "hashes"), ["passage", "len"]).join(items.select("item_id", "len", F.col("hashes").alias("item_hashes")), ["item_id", "len"]))
    pair = candidates.select("passage", "item_id", "len", F.explode(F.array(F.struct(_tagged(F.col("hashes")).alias("x"), _tagged(F.col("item_hashes")).alias("y")))).alias("t"))
    shared = pair.select("passage", "item_id", "len", F.size(F.array_intersect("t.x", "t.y")).alias("both"), (F.size("t.x") + F.size("t.y")).alias("sum"))
    close = cut(shared.select("passage", "item_id", "len", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity))
    found = windows.select("doc_id", "len", "start", F.xxhash64("len", "hashes").alias("passage")).join(close, ["passage", "len"])
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("start_word"), F.col("m.similarity").alias("similarity"))
