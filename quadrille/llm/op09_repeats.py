"""Exact removal of repeated passages with run-length compressed indexes (r-indexes).

A passage of ``length`` bytes is removed from a document when it also starts in a document of smaller id.
One index of the whole corpus would need one machine to hold it, so the corpus is dealt by content:

1. Documents are packed, and every window of ``length`` bytes is assigned its minimizer, the least of its
   24-byte grams by hash. Equal windows have equal minimizers wherever they stand.
2. Minimizers that only one document has cannot lie in a repeated window. Each pack sends its distinct
   minimizer hashes by bucket with their numbers of distinct stretches, and gets back which of them others
   have too, and which have more stretches than one index holds.
3. Only stretches of windows whose minimizer is repeated go on, dealt by minimizer, each distinct stretch
   once a pack. Those of the minimizers with too many are dealt by window instead, fifty bytes for each, so no
   index grows with the corpus.
4. In a bucket, a run-compressed Burrows-Wheeler transform of the distinct stretches is built: run heads,
   their LF images as samples, and the smallest document of each interval of suffixes that agree on
   ``length`` bytes. All stretches are streamed through it backwards, which gives for each window the
   smallest document that has it; windows with a smaller document than their own are marked.
5. Marks go back to the packs, where they are united and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import _BASE, _BYTE_VALUE, _INVERSE, _powers, CHUNK_BYTES, cut, mix64, row_chunks, text_bytes

GRAM = 24
PACK_BYTES = 1 << 21
#: Text bytes that make one bucket of step 2 or 3, and bytes of one index.
BUCKET_BYTES = 1 << 25
INDEX_BYTES = 1 << 20
#: A minimizer with more distinct stretches than this, summed over the packs, is dealt by window: about one index.
HOT_STRETCHES = 1 << 14
_LAST_ID = np.iinfo(np.int64).max
_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _z(a: np.ndarray) -> bytes:
    return _SQUEEZE.compress(np.ascontiguousarray(a).tobytes())


def _unz(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_EXPAND.decompress(b), kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, ids, sizes, z): some documents' ids, byte counts and joined, compressed text."""
    squeeze, at = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
    for batch in batches:
        buf, offs = text_bytes(batch.column(1))
        ids = batch.column(0).fill_null(_LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        for lo, hi in row_chunks(offs, PACK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([_z(ids[lo:hi])], pa.binary()), pa.array([_z(null[lo:hi])], pa.binary()), pa.array([_z(np.diff(offs[lo : hi + 1]))], pa.binary()), pa.array([squeeze.compress(buf[offs[lo] : offs[hi]].tobytes())], pa.binary()), pa.array([int(offs[hi] - offs[lo])])],
                ["g", "ids", "nulls", "sizes", "z", "bytes"],
            )
            at += 1


_PACKED = "g bigint, ids binary, nulls binary, sizes binary, z binary, bytes bigint"


def _stretches(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer hash of each run of windows that share a minimizer."""
    span, out = length - GRAM + 1, []
    valid = np.ones(len(buf), dtype=bool)
    tails = (offs[1:, None] - np.arange(1, length)).reshape(-1)
    valid[tails[tails >= 0]] = False
    for lo in range(0, max(len(buf) - length + 1, 0), CHUNK_BYTES):
        part = buf[lo : lo + CHUNK_BYTES + length - 1].astype(np.uint64)
        two = part[:-1] | part[1:] << np.uint64(8)
        four = two[:-2] | two[2:] << np.uint64(16)
        eight = four[:-4] | four[4:] << np.uint64(32)
        m = len(eight) - GRAM + 8
        h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
        for j in range(8, GRAM, 8):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + eight[j : j + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: -(span - reach)], least[span - reach :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        ok = valid[lo : lo + len(at)]
        head = ok.copy()
        head[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        tail = ok.copy()
        tail[:-1] &= (at[1:] != at[:-1]) | ~ok[1:]
        head, tail = np.flatnonzero(head), np.flatnonzero(tail)
        out.append((head + lo, tail - head + 1, h[at[head]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = _unz(row["sizes"], np.int64)
    return _unz(row["ids"], np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(_EXPAND.decompress(row["z"]), np.uint8)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(h) % np.uint64(buckets)).astype(np.int64)


def _distinct(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ordered by bucket and hash, the place of each element in them, and bounds of the buckets there are."""
    values, inverse = np.unique(h, return_inverse=True)
    bucket = _bucket_of(values, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket = bucket[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).astype(np.int64) if len(bucket) else np.zeros(1, np.int64)
    return values[order], place[inverse], bucket, bounds


def _send_hashes(length: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offs, buf = _opened(row)
                head, n, h = _stretches(buf, offs, length)
                doc = ids[np.searchsorted(offs, head, side="right") - 1]
                values, place, bucket, bounds = _distinct(h, buckets)
                low, high = np.full(len(values), _LAST_ID), np.full(len(values), -_LAST_ID)
                np.minimum.at(low, place, doc)
                np.maximum.at(high, place, doc)
                several = low != high
                weight = np.bincount(place, minlength=len(values))
                more = np.flatnonzero(weight[place] > 1)
                content = _content_hash(buf, head[more], n[more] + length - 1)
                _, one = np.unique(mix64(content) + place[more].astype(np.uint64), return_index=True)
                weight -= np.bincount(place[more], minlength=len(values)) - np.bincount(place[more[one]], minlength=len(values))
                weight = np.minimum(weight, 255).astype(np.uint8)
                cuts = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[bounds[:-1]]), pa.array(np.full(len(cuts), row["g"])), pa.array([values[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary()), pa.array([_z(weight[a:b]) for a, b in cuts], pa.binary())],
                    ["bucket", "g", "hashes", "several", "weights"],
                )

    return send


def _answer_hashes(found: pa.Table) -> pa.Table:
    """Which hashes several documents have. 32 bits tell a bucket's hashes apart; a rare mistake sends on a stretch in vain."""
    parts = [np.frombuffer(x, np.uint32) for x in found["hashes"].to_pylist()]
    sizes = [len(x) for x in parts]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(found["several"].to_pylist(), sizes, strict=True)])
    _, inverse, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = np.bincount(inverse, weights=several, minlength=len(count))
    stretches = np.bincount(inverse, weights=np.concatenate([_unz(x, np.uint8) for x in found["weights"].to_pylist()]), minlength=len(count))
    many, hot = ((count > 1) | (shared > 0))[inverse], (stretches > HOT_STRETCHES)[inverse]
    hot &= many
    at = np.concatenate([[0], np.cumsum(sizes)])
    cuts = list(zip(at[:-1], at[1:], strict=True))
    return pa.table({"bucket": found["bucket"], "g": found["g"], "many": pa.array([np.packbits(many[a:b]).tobytes() for a, b in cuts], pa.binary()), "hot": pa.array([np.packbits(hot[a:b]).tobytes() for a, b in cuts], pa.binary())})


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... of size[0] numbers, then the same for the next."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _content_hash(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the strings of the given begins and sizes (under 2 * length bytes), from sums up to each byte."""
    out = np.empty(len(begin), np.uint64)
    order = np.argsort(begin, kind="stable")
    begin, size = begin[order], size[order]
    reach, lo = int(size.max(initial=0)), 0
    while lo < len(begin):
        base = int(begin[lo])
        hi = int(np.searchsorted(begin, base + CHUNK_BYTES // 2))
        part = text[base : base + CHUNK_BYTES // 2 + reach]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * _powers(_BASE, len(part)), out=total[1:])
        a, n = begin[lo:hi] - base, size[lo:hi]
        out[order[lo:hi]] = mix64((total[a + n] - total[a]) * _powers(_INVERSE, len(part) + 1)[a] + n.astype(np.uint64))
        lo = hi
    return out


def _send_stretches(length: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offs, buf = _opened(row)
                head, n, h = _stretches(buf, offs, length)
                values, place, bucket, bounds = _distinct(h, buckets)
                many, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
                first = dict(zip(bucket[bounds[:-1]].tolist(), zip(bounds[:-1], bounds[1:], strict=True), strict=True))
                for x in row["flags"]:
                    a, b = first[x["bucket"]]
                    many[a:b] = np.unpackbits(np.frombuffer(x["many"], np.uint8), count=b - a).view(bool)
                    hot[a:b] = np.unpackbits(np.frombuffer(x["hot"], np.uint8), count=b - a).view(bool)
                plain, single = (many & ~hot)[place], hot[place]
                head, n, h = (
                    np.concatenate([head[plain], _ragged(head[single], n[single])]),
                    np.concatenate([n[plain], np.ones(n[single].sum(), np.int64)]),
                    np.concatenate([h[plain], np.zeros(n[single].sum(), np.uint64)]),
                )
                if not len(head):
                    continue
                alone, size = np.arange(len(head)) >= plain.sum(), n + length - 1
                content = _content_hash(buf, head, size)
                h = np.where(alone, content, h)
                _, one, inverse = np.unique(content, return_index=True, return_inverse=True)
                at = _bucket_of(h[one], buckets)
                order = np.argsort(at, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                one, at = one[order], at[order]
                places = np.argsort(rank[inverse], kind="stable")
                owner = rank[inverse][places]
                doc = ids[np.searchsorted(offs, head, side="right") - 1][places]
                cuts, columns = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]), []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    lo, hi = np.searchsorted(owner, [a, b])
                    columns.append([_z(x) for x in (h[one[a:b]].astype(np.uint32), size[one[a:b]].astype(np.uint32), buf[_ragged(head[one[a:b]], size[one[a:b]])], (owner[lo:hi] - a).astype(np.uint32), head[places[lo:hi]], doc[lo:hi])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[cuts[:-1]]), pa.array(np.full(len(columns), row["g"])), *(pa.array(x, pa.binary()) for x in zip(*columns, strict=True))],
                    ["bucket", "g", "keys", "sizes", "text", "owner", "place", "doc"],
                )

    return send


_STRETCHES = "bucket bigint, g bigint, keys binary, sizes binary, text binary, owner binary, place binary, doc binary"


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of distinct strings, each ended by a sentinel.

    Kept: first row and LF image of each run, first row of each interval of suffixes that agree on ``length``
    bytes, and the least of ``doc`` over each. The suffix array only exists while it is built.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int):
        self.length, self.size = length, size
        ends = np.cumsum(size + 1)
        self.total = total = int(ends[-1])
        symbol = np.zeros(total + 4, np.uint64)
        begin = ends - size - 1
        symbol[_ragged(begin, size)] = text.astype(np.uint64) + np.uint64(1)
        owner = np.repeat(np.arange(len(size)), size + 1)
        left = ends[owner] - np.arange(total)
        bits = np.uint64(max(total.bit_length(), 1))
        mask, here = np.uint64((1 << int(bits)) - 1), np.arange(total, dtype=np.uint64)
        key = np.zeros(total, np.uint64)
        for j in range(3):
            key = key << np.uint64(9) | np.where(left > j, symbol[j : j + total], np.uint64(0))
        order, rank = self._sorted(key << bits | here, bits, mask)
        depth, half = 3, None
        while depth < int(size.max()) + 1:
            if half is None and 2 * depth >= length:
                half = depth, rank
            near = left > depth
            after = np.zeros(total, np.uint64)
            after[near] = rank[np.flatnonzero(near) + depth] + np.uint64(1)
            order, rank = self._sorted((rank * np.uint64(total + 1) + after) << bits | here, bits, mask)
            depth *= 2
        if half is None:
            half = depth, rank
        reach = min(half[0], length)
        full = left > length
        first, second = half[1], np.zeros(total, np.uint64)
        second[full] = half[1][np.flatnonzero(full) + length - reach]
        same = full[order][1:] & full[order][:-1] & (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        self.interval = np.concatenate([[0], np.flatnonzero(~same) + 1])
        self.least = np.minimum.reduceat(doc[owner[order]], self.interval)
        before = symbol[order - 1]
        before[order == 0] = 0
        self.run = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        sizes, letter = np.diff(np.append(self.run, total)), before[self.run]
        by_letter = np.argsort(letter, kind="stable")
        self.image = np.empty(len(self.run), np.int64)
        self.image[by_letter] = np.cumsum(sizes[by_letter]) - sizes[by_letter]

    @staticmethod
    def _sorted(key: np.ndarray, bits: np.uint64, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(key)
        order = (key & mask).astype(np.int64)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key >> bits) != 0)]).astype(np.uint64)
        return order, rank

    def steps(self) -> np.ndarray:
        """The LF step of every row, from its run's image: rows of a run move alike."""
        sizes = np.diff(np.append(self.run, self.total))
        return (np.repeat(self.image - self.run, sizes) + np.arange(self.total)).astype(np.int32)

    def least_documents(self) -> np.ndarray:
        """For each window of the strings in turn, the least document that has it, by streaming all strings backwards."""
        windows = self.size - self.length + 1
        at = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), np.int64)
        turn = np.argsort(-self.size, kind="stable")
        row, size = turn.astype(np.int32), self.size[turn]
        step_of, interval = self.steps(), np.repeat(np.arange(len(self.interval), dtype=np.int32), np.diff(np.append(self.interval, self.total)))
        alive = np.searchsorted(-size, -np.arange(int(size.max()) + 1), side="right").tolist()
        last = at[turn] + size
        for step in range(1, int(size.max()) + 1):
            n = alive[step]
            row = step_of[row[:n]]
            if step >= self.length:
                out[last[:n] - step] = interval[row]
        return self.least[out]


def _mark(length: int):
    def mark(found: pa.Table) -> pa.Table:
        rows = found.select(["keys", "sizes", "text", "owner", "place", "doc"]).to_pylist()
        keys = np.concatenate([_unz(x["keys"], np.uint32) for x in rows])
        sizes = [_unz(x["sizes"], np.uint32).astype(np.int64) for x in rows]
        counts = [len(x) for x in sizes]
        size = np.concatenate(sizes)
        text = np.concatenate([_unz(x["text"], np.uint8) for x in rows])
        end = np.cumsum(size)
        content = _content_hash(text, end - size, size)
        _, one, inverse = np.unique(content, return_index=True, return_inverse=True)
        base = np.concatenate([[0], np.cumsum(counts)])
        owners = [_unz(x["owner"], np.uint32).astype(np.int64) + b for x, b in zip(rows, base, strict=False)]
        docs = [_unz(x["doc"], np.int64) for x in rows]
        least = np.full(len(one), _LAST_ID)
        np.minimum.at(least, inverse[np.concatenate(owners)], np.concatenate(docs))
        windows = size[one] - length + 1
        at = np.cumsum(windows) - windows
        smallest = np.empty(int(windows.sum()), np.int64)
        order = np.argsort(keys[one], kind="stable")
        lo = 0
        while lo < len(order):  # strings with one key stay in one index
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[one[order[lo:]]] + 1), INDEX_BYTES)))
            while hi < len(order) and keys[one[order[hi]]] == keys[one[order[hi - 1]]]:
                hi += 1
            some = order[lo:hi]
            pick = one[some]
            index = RunLengthIndex(text[_ragged(end[pick] - size[pick], size[pick])], size[pick], least[some], length)
            smallest[_ragged(at[some], windows[some])] = index.least_documents()
            lo = hi
        gs, starts, stops = [], [], []
        for g, own, doc, x in zip(found["g"].to_pylist(), owners, docs, rows, strict=True):
            place, s = _unz(x["place"], np.int64), inverse[own]
            hit = smallest[_ragged(at[s], windows[s])] < np.repeat(doc, windows[s])
            where = np.sort(_ragged(place, windows[s])[hit])
            if len(where):
                new = np.concatenate([[True], np.diff(where) > 1])
                gs.append(g)
                starts.append(_z(where[new]))
                stops.append(_z(where[np.append(new[1:], True)] + length))
        return pa.table({"g": pa.array(gs, pa.int64()), "starts": pa.array(starts, pa.binary()), "stops": pa.array(stops, pa.binary())})

    return mark


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, offs, buf = _opened(row)
            null = _unz(row["nulls"], bool)
            edge = np.zeros(len(buf) + 1, np.int64)
            for x in row["marks"] or ():
                np.add.at(edge, _unz(x["starts"], np.int64), 1)
                np.add.at(edge, _unz(x["stops"], np.int64), -1)
            gone = np.cumsum(edge)[:-1] > 0
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            heads = offs[:-1][offs[:-1] < len(buf)]
            new[heads] = gone[heads]
            removed, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offs]) for x in (gone, new))
            keep = ~gone
            left = [buf[a:b][keep[a:b]].tobytes() if r else buf[a:b].tobytes() for a, b, r in zip(offs[:-1], offs[1:], removed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Null text is empty. A null id counts as larger than any other, so such a document is cut by others but
    cuts none. Rows that repeat an id are one document for this purpose: none cuts another. ``length`` is
    at least 32 bytes.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = cut(texts.mapInArrow(_pack, _PACKED))
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(parts, -(-total // BUCKET_BYTES))
    flags = (
        packs.mapInArrow(_send_hashes(length, buckets), "bucket bigint, g bigint, hashes binary, several binary, weights binary")
        .groupBy("bucket")
        .applyInArrow(_answer_hashes, "bucket bigint, g bigint, many binary, hot binary")
        .groupBy("g")
        .agg(F.collect_list(F.struct("bucket", "many", "hot")).alias("flags"))
    )
    marks = (
        packs.join(flags, "g")
        .mapInArrow(_send_stretches(length, buckets), _STRETCHES)
        .groupBy("bucket")
        .applyInArrow(_mark(length), "g bigint, starts binary, stops binary")
        .groupBy("g")
        .agg(F.collect_list(F.struct("starts", "stops")).alias("marks"))
    )
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return packs.join(marks, "g", "left").mapInArrow(_remove, out)
