"""MinHash near-dedup by tensored banding.

Two small collections of ``side`` part keys, each of ``width`` minhashes, stand in for ``side``² tables: table
(i, j) is keyed by part i of the first collection and part j of the second, so 2·side·width minhashes serve
side² tables of 2·width hashes. A pair of similarity s meets with probability (1 - (1 - s^width)^side)², which
is 1 - 2e-5 at s = 0.8 for the defaults. Documents with equal shingle sets are one class; candidates are the
pairs of classes that share a bucket of a table, and every candidate that could join what is apart is confirmed
on full shingle sets:

1. Each class is compared with one other: of the least classes of its buckets, that which it meets most often.
   Of a group of copies nearly all are joined by this, with one text sent for each class.
2. Buckets whose classes are all joined by then are done with. Classes of the others are dealt by part of the
   first collection (so 16 times at most instead of 256) and into blocks of bounded size; a task compares two
   blocks. There a pair counts only if it shares a bucket, is apart still, and the part is the first that it
   shares, so that no pair is compared twice. Links are sent on only if they join what was apart.

Nobody lists the pairs of a bucket, and no table depends on the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import CHUNK_BYTES, Words, cut, lean, mix64, row_chunks, stored, text_bytes
from quadrille.llm.components import components

WIDTH, SIDE = 3, 16
#: Shingles that a block of documents has together, about; two blocks are compared in one task. A group is cut into
#: blocks of the least size until it makes 64 of them, and into larger ones up to the greatest size from then on.
BLOCK_TOKENS = 1 << 16
MOST_TOKENS = 1 << 20
_GROUP_SALTS = 32
#: Classes that one task compares with one centre, about.
STAR_ROWS = 1 << 10


def _coefficients(width: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(977))
    n = 2 * side * width
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _set_hash(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles, and two sums of their hashes, of each row's set."""
    n = np.bincount(row, minlength=rows)
    some = np.flatnonzero(n)
    total = np.zeros((2, rows), np.uint64)
    if len(some):
        begin = np.searchsorted(row, some)
        for t, salt in enumerate((0x51ED270B, 0x2545F491)):
            total[t, some] = np.add.reduceat(mix64(h ^ np.uint64(salt)), begin)
    return n, total


def _signer(k: int, width: int, side: int):
    mult, add = _coefficients(width, side)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in row_chunks(offs):
                row, h = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower=True).shingles(k)
                n, total = _set_hash(row, h, hi - lo)
                some = np.flatnonzero(n)
                begin = np.searchsorted(row, some)
                mins = np.zeros((len(mult), len(some)), np.uint64)
                if len(some):
                    for t in range(len(mult)):
                        mins[t] = np.minimum.reduceat(h * mult[t] + add[t], begin)
                parts = np.zeros((hi - lo, 2 * side), np.uint64)
                joined = mins.reshape(2 * side, width, len(some))
                key = joined[:, 0]
                for w in range(1, width):
                    key = mix64(key * np.uint64(0x9FB21C651E98DF25) + joined[:, w])
                parts[some] = key.T
                flat = pa.array(parts[:, :side].reshape(-1).view(np.int64)), pa.array(parts[:, side:].reshape(-1).view(np.int64))
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * side)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(n.astype(np.int64)),
                        *(pa.array(x.view(np.int64)) for x in total),
                        *(pa.ListArray.from_arrays(at, x) for x in flat),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "c1", "c2"],
                )

    return sign


_SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, c1 array<bigint>, c2 array<bigint>"


def _packer(k: int):
    """Texts to their set's hash and the compressed text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in row_chunks(offs):
                row, h = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower=True).shingles(k)
                n, total = _set_hash(row, h, hi - lo)
                packed = [squeeze.compress(buf[a:b].tobytes()) for a, b in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in total), pa.array(n.astype(np.int64)), pa.array(packed, pa.binary())], ["h1", "h2", "n_shingles", "z"])

    return pack


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Packed texts as row ranges with the rows' begins (one more than rows) and sorted shingles."""
    expand, at = zstandard.ZstdDecompressor(), 0
    while at < len(column):
        raw, size = [], 0
        while at + len(raw) < len(column) and size < CHUNK_BYTES:
            x = column[at + len(raw)]
            raw.append(expand.decompress(x.as_py()) if x.is_valid else b"")
            size += len(raw[-1])
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        row, h = Words(np.frombuffer(b"".join(raw), np.uint8), offs, lower=True).shingles(k)
        yield at, at + len(raw), np.searchsorted(row, np.arange(len(raw) + 1)), h
        at += len(raw)


def _linked(shared: np.ndarray, n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + m - shared)


def _star(k: int, percent: int):
    """Rows (a, salt, side, node, z) in order of (a, salt, side), the centre being side 0, to links (a, node)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            of, side, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for lo, hi, p, h in _sets(batch.column(4), k):
                heads = np.unique(np.concatenate([[0], np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(np.diff(of[lo:hi])) + 1, [hi - lo]]))
                for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                    if side[lo + x] == 0:
                        centre, held, x = of[lo + x], h[p[x] : p[x + 1]], x + 1
                    if x == y or of[lo + x] != centre:
                        continue
                    mine = h[p[x] : p[y]]
                    found = held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine
                    shared = np.add.reduceat(found, p[x:y] - p[x], dtype=np.int64)
                    good = lo + x + np.flatnonzero(_linked(shared, np.diff(p[x : y + 1]), len(held), percent))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), centre, np.int64)), pa.array(node[good])], ["a", "b"])

    return compare


def _links_between(part: int, node: np.ndarray, side: np.ndarray, root: np.ndarray, c1: np.ndarray, c2: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between classes that are apart, of two blocks or inside one; each that is sent joins what was apart."""
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(size) - size
    seen = np.zeros(int(token.max()) + 1, bool)
    _, group, members = np.unique(root, return_inverse=True, return_counts=True)
    two = len(np.unique(side)) > 1
    # The largest group's classes are compared with the others' only, and so need no turn of their own.
    turn = np.flatnonzero(group != members.argmax())
    done = np.zeros(len(node), bool)
    for y in turn.tolist():
        ask = ~done & (group != group[y])
        done[y] = True
        if two:
            ask &= side != side[y]
        x = np.flatnonzero(ask)
        x = x[(c2[x] == c2[y]).any(axis=1)]
        x = x[(c1[x] == c1[y]).argmax(axis=1) == part]
        if not len(x):
            continue
        mine = token[begin[y] : begin[y] + size[y]]
        seen[mine] = True
        at = np.repeat(begin[x] - (np.cumsum(size[x]) - size[x]), size[x]) + np.arange(size[x].sum())
        shared = np.add.reduceat(seen[token[at]], np.cumsum(size[x]) - size[x], dtype=np.int64)
        seen[mine] = False
        for z in x[_linked(shared, size[x], size[y], percent)].tolist():
            if group[z] != group[y]:
                group[group == group[z]] = group[y]
                yield int(node[z]), int(node[y])


def _linker(k: int, percent: int):
    """Rows (g, part, lo, hi, side, node, root, c1, c2, z) in order of (g, lo, hi) to links."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                found = list(_links_between(key[1], *(np.concatenate(x) for x in zip(*held, strict=True)), sets, percent))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 4, 6)]
            parts = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1) for i in (7, 8)]
            for lo, hi, p, h in _sets(batch.column(9), k):
                heads = np.concatenate([[0], np.flatnonzero((keys[lo + 1 : hi] != keys[lo : hi - 1]).any(axis=1)) + 1, [hi - lo]])
                for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                    now = tuple(keys[lo + x].tolist())
                    if now != key:
                        yield from done()
                        key, held, sets = now, [], []
                    held.append([c[lo + x : lo + y] for c in (*plain, *parts)])
                    sets += [h[p[i] : p[i + 1]] for i in range(x, y)]
        yield from done()

    return link


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80, width: int = WIDTH, side: int = SIDE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of non-space bytes after lower-casing A-Z. Documents link when 100·|∩| >= percent·|∪| of
    their distinct shingles. A null or wordless text has an empty set and no links. A null id belongs to no
    component (component_id null) and is kept. Rows that repeat an id are each returned, with the component of
    their own text. Texts of any length count whole. An empty table gives an empty result; further columns are
    ignored, whatever their names.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(texts.mapInArrow(lean(_signer(shingle, width, side)), _SIGNED))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class; its signature is that of any of its rows.
    same = ["h1", "h2", "n_shingles"]
    classes = cut(usable.groupBy(*same).agg(F.min("doc_id").alias("rid"), F.first("c1").alias("c1"), F.first("c2").alias("c2")).withColumn("node", F.monotonically_increasing_id()))

    first = classes.select("node", F.posexplode("c1").alias("i", "k1"))
    shared = first.groupBy("i", "k1").count().where("count > 1").drop("count")
    keys = (
        first.join(shared, ["i", "k1"])
        .join(classes.select("node", "c2"), "node")
        .select("node", "i", "k1", F.posexplode("c2").alias("j", "k2"))
        .select(F.xxhash64("i", "k1", "j", "k2").alias("key"), F.xxhash64("i", "k1").alias("g"), "i", "node")
    )
    met = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    # Buckets of several classes: their rows, with the least class of each.
    keys = cut(keys.join(met, "key"))
    often = keys.where("a < node").groupBy("node", "a").agg(F.count("*").alias("n"))
    star = cut(often.groupBy("node").agg(F.max(F.struct("n", "a"))["a"].alias("a")))
    members = cut(keys.select("node").distinct())
    chosen = classes.join(members, "node").select("node", "rid", *same, "c1", "c2")
    # One text of each class; rows that repeat an id are told apart by their sets.
    wanted = stored(chosen.select(F.col("rid").alias("doc_id")).distinct())
    raw = texts.join(wanted, "doc_id", "left_semi").mapInArrow(lean(_packer(shingle)), "h1 bigint, h2 bigint, n_shingles bigint, z binary")
    packed = cut(chosen.drop("rid").join(raw.groupBy(*same).agg(F.first("z").alias("z")), same).select("node", "n_shingles", "c1", "c2", "z"))

    salts = star.groupBy("a").agg(F.ceil(F.count("*") / F.lit(STAR_ROWS)).alias("salts"))
    centres = salts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("node"))
    others = star.join(salts, "a").select("a", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), F.lit(1).alias("side"), "node")
    rows = centres.unionByName(others).join(packed.select("node", "z"), "node").select("a", "salt", "side", "node", "z")
    near = cut(rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "side").mapInArrow(lean(_star(shingle, percent)), "a bigint, b bigint"))
    joined = cut(components(near))

    # Buckets with classes that are apart still.
    placed = keys.join(joined, "node", "left").select("key", "g", "i", "node", F.coalesce("root", "node").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    left = cut(placed.join(apart, "key").select("g", "i", "node", "root").distinct().join(packed.select("node", "n_shingles"), "node"))
    # Only groups of several blocks are looked up, a part of their rows in each task.
    tokens = F.sum("n_shingles")
    sizes = left.groupBy("g").agg(F.ceil(tokens / F.greatest(F.lit(BLOCK_TOKENS), F.least(F.lit(MOST_TOKENS), tokens / 64))).alias("blocks")).where("blocks > 1")
    sizes = sizes.select("g", "blocks", F.explode(F.sequence(F.lit(0), F.lit(_GROUP_SALTS - 1))).alias("salt"))
    left = left.withColumn("salt", F.pmod(F.hash("node"), F.lit(_GROUP_SALTS))).join(sizes, ["g", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = left.select("g", "i", "node", "root", block.alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("g", "i", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root").join(packed.drop("n_shingles"), "node")
    late = cut(
        dealt.select("g", "i", "lo", "hi", "side", "node", "root", "c1", "c2", "z")
        .repartition(parts, "g", "lo", "hi")
        .sortWithinPartitions("g", "lo", "hi")
        .mapInArrow(lean(_linker(shingle, percent)), "a bigint, b bigint")
    )
    # What the second step links are the components of the first.
    of = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    wider = components(between).select(F.col("node").alias("root"), F.col("root").alias("wide"))
    whole = classes.select("node", "rid", *same).join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = cut(whole.join(wider, "root", "left").select(*same, "rid", F.coalesce("wide", "root").alias("root")))

    named = whole.groupBy("root").agg(F.min("rid").alias("least"))
    out = signed.select("doc_id", *same).join(whole.join(named, "root").select(*same, "least"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
