"""WARC archives, index first.

Writing: each task writes its records, one gzip member each, to an archive in the shared folder and returns an
index row per record: archive, offset, length, URL, payload digest. The index is itself a table, written before
anything is read. Reading: the index's rows that are wanted, in order of archive and offset, are cut into runs
whose gaps are small; one range read fetches a run, and its members are opened from it.

Archives are named by a random number per attempt, and only those of attempts that succeeded are in the index,
so tasks can be repeated. File access is by pyarrow's file systems, which take the URI of the shared folder.
Payloads are held a few megabytes (or one record) at a time, both when they are written and when they are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut, row_chunks, shared_dir

#: Two records this near are read together; one read spans at most RUN_BYTES and one record.
GAP_BYTES = 1 << 16
RUN_BYTES = 1 << 23
ARCHIVE_BYTES = 1 << 27
#: Payload bytes that a task turns into Python values or into one batch at once.
HELD_BYTES = 1 << 22
_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, archive string, offset bigint, length bigint, url string, digest string"


def payload_digest(payload: bytes | pa.Buffer) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that has the response's HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's header fields (names in lower case), its HTTP header fields and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in http.decode().split("\r\n")[1:])}, payload


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; s3a and s3n are Hadoop's names of what is s3 here."""
    scheme, sign, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if sign and scheme in ("s3a", "s3n") else uri)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of HELD_BYTES of a binary column, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in row_chunks(np.concatenate([[0], np.cumsum(size)]), HELD_BYTES):
        yield batch.slice(lo, hi - lo)


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        out, name, at = None, "", 0
        for batch in (x for whole in batches for x in _slices(whole, 2)):
            rows = []
            for x in batch.to_pylist():
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = _gzip(record(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"]))
                out.write(member)
                rows.append((x["page_id"], f"{folder}/{name}", at, len(member), x["url"], x["digest"]))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "archive", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write one record per row to archives in the shared folder; returns the index, already materialised.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest id is a response and
    the others revisit it; rows that repeat the largest id are responses too, and null ids revisit any other.
    Null html is an empty payload; pages of any length are written whole; further columns are ignored, whatever
    their names. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    shared = shared_dir(spark)
    if shared.startswith("file:"):
        shared = "file:///" + shared.removeprefix("file:").lstrip("/")
    folder = f"{shared}/warc-{uuid.uuid4().hex}"
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload_digest(x.as_buffer()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pc.binary_length(batch.column(1)).cast(pa.int64())], ["page_id", "digest", "bytes"])

    facts = cut(rows.select("page_id", "payload").mapInArrow(digests, "page_id bigint, digest string, bytes bigint"))
    # Only payloads that occur twice are looked up, so a payload's copies cost one small row each.
    last = facts.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").drop("n")
    old = cut(facts.join(last, "digest").where(F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))).select("page_id", "digest", "last").distinct())

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([payload_digest(x.as_buffer()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "digest"])

    full = rows.mapInArrow(with_digest, "page_id bigint, url string, payload binary, digest string")
    joined = full.join(old.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("last").alias("refers_to")), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return cut(joined.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writer(folder), INDEX))


def _runs(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """First row of each read, for rows of one archive by offset."""
    cut_at, begin, end = [], 0, -1
    for i, (a, n) in enumerate(zip(offset.tolist(), length.tolist(), strict=True)):
        if end < 0 or a - end > GAP_BYTES or a - begin > RUN_BYTES:
            cut_at.append(i)
            begin, end = a, a
        end = max(end, a + n)
    return np.array(cut_at, np.int64)


_READ = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, source, out, held = None, None, [], 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _READ.values(), strict=True)], list(_READ))

    for batch in batches:
        archive = np.array(batch.column(1).to_pylist(), dtype=object)
        offset, length = (batch.column(i).to_numpy() for i in (2, 3))
        page = batch.column(0).to_pylist()
        heads = np.flatnonzero(np.concatenate([[True], archive[1:] != archive[:-1]])) if len(archive) else []
        for lo, hi in zip(heads, [*heads[1:], len(archive)], strict=True):
            if archive[lo] != where:
                where = archive[lo]
                fs, path = file_system(where)
                source = fs.open_input_file(path)
            begins = _runs(offset[lo:hi], length[lo:hi]) + lo
            for a, b in zip(begins, [*begins[1:], hi], strict=True):
                start = int(offset[a])
                raw = memoryview(source.read_at(int((offset[a:b] + length[a:b]).max()) - start, start))
                for i in range(a, b):
                    fields, http, payload = parse(zlib.decompress(raw[int(offset[i]) - start : int(offset[i] + length[i]) - start], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"digest of {fields['warc-record-id']} does not match its payload")
                    refers = fields.get("warc-refers-to")
                    out.append((page[i], int(http["content-length"]), digest, kind, None if refers is None else int(refers[10:-1]), fields["warc-target-uri"], payload))
                    held += len(payload) + 200
                    if held > HELD_BYTES:
                        yield send()
                        out, held = [], 0
    if out:
        yield send()


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index's rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Rows are dealt by archive and stretch of RUN_BYTES, so an archive of any size is read by many tasks.
    A revisit's payload is empty; its size and digest are those of the full payload.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / F.lit(RUN_BYTES))
    placed = index.select("page_id", "archive", "offset", "length").repartition(parts, "archive", stretch).sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(_reader, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def drop_archives(spark: SparkSession, index: DataFrame) -> None:
    """Delete the archives of an index."""
    row = index.select("archive").first()
    if row is not None:
        fs, path = file_system(row.archive.rpartition("/")[0])
        fs.delete_dir(path)
