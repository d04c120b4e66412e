"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions near hits, then embedded checksums.

The automaton walks each whole text once (A-Z lower-cased) for all keywords. Only where one ends is an
expression tried, anchored at the keyword's start, so an expression never walks a text. Runs of hexadecimal
digits have no keyword; they are found from the byte classes of the whole batch. Tokens of forms that carry a
checksum must satisfy it:

- github: ``gh[pousr]_`` and 36 characters, the last 6 being the base-62 CRC-32 of the 30 before them;
- npm: ``npm_`` and 36 characters, alike;
- jwt: three base64url parts, the first two of which decode to JSON objects, from the start of a run of such characters;
- pem: a private key block, whose base64 body must decode to a DER sequence of the length it states.

Each character is looked at a bounded number of times, so a text's work is in proportion to its length, whatever
it holds. Spans are kind:start:end in code points, end exclusive, ordered by start, then kind as in ``KINDS``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import lean, row_chunks, text_bytes

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")
_RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
#: Keyword (lower case), kind, and how far before the keyword's start the expression begins.
KEYWORDS = (
    *((w, "assign") for w in ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("akia", "access"),
    *((w, "github") for w in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("npm_", "npm"),
    ("eyj", "jwt"),
    ("-----begin ", "pem"),
)
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


def checksum62(body: str) -> str:
    """The six base-62 digits of a text's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _is_object(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _is_der(body: str) -> bool:
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] == len(raw) - 2
    n = raw[1] & 0x7F
    return int.from_bytes(raw[2 : 2 + n], "big") == len(raw) - 2 - n


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS:
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def keyword_spans(text: str, hits: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) that begin at the hits (start, kind), leftmost first and apart by kind."""
    out, free = [], dict.fromkeys(KINDS, 0)
    for at, kind in sorted(hits):
        if at < free[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "github": _CHECKED, "npm": _CHECKED, "jwt": _JWT, "pem": _PEM}[kind].match(text, at)
        if not m:
            continue
        if kind in BASE_KINDS:  # a match that fails still takes its place
            free[kind] = m.end()
        good = {
            "assign": lambda m: len(m[2]) >= 8,
            "access": lambda m: len(m[0]) >= 16,
            "github": lambda m: checksum62(m[1]) == m[2],
            "npm": lambda m: checksum62(m[1]) == m[2],
            "jwt": lambda m: _is_object(m[1]) and _is_object(m[2]),
            "pem": lambda m: _is_der(m[2]),
        }[kind](m)
        if good:
            free[kind] = m.end()
            out.append((m.start(), m.end(), kind))
    return out


def _hex_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the runs of 32 or more lower-case hexadecimal digits, none across texts."""
    on = _HEX[buf]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    inner = offs[1:-1]
    cuts = np.unique(np.concatenate([[0], edge, inner[(inner > 0) & (inner < len(buf))], [len(buf)]]))
    long = np.flatnonzero((np.diff(cuts) >= 32) & on[cuts[:-1]])
    return cuts[long], cuts[long + 1]


def scan_batch(column: pa.Array, found: ahocorasick.Automaton) -> Iterator[list[tuple[int, int, str]]]:
    """All spans of each text of a string array, in order."""
    buf, offs = text_bytes(column)
    for lo, hi in row_chunks(offs):
        part, at = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        raw = part.tobytes()
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before each byte
        low = raw.lower()  # bytes: A-Z only, so positions stay
        starts, stops = _hex_runs(part, at) if len(part) else (np.zeros(0, int), np.zeros(0, int))
        owner = np.searchsorted(at, starts, side="right") - 1
        nearest = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            hits = [(end - n + 1, kind) for end, (n, kind) in found.iter(low[a:b].decode())]
            spans = keyword_spans(raw[a:b].decode(), hits) if hits else []
            for j in range(nearest[i], nearest[i + 1]):
                s = int(points[starts[j]] - points[a])
                spans.append((s, s + int(stops[j] - starts[j]), "hex"))
            spans.sort(key=lambda x: (x[0], _RANK[x[2]]))
            yield spans


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about a chunk of text each, so that few texts are Python strings at once."""
    for lo, hi in row_chunks(text_bytes(batch.column(column))[1]):
        yield batch.slice(lo, hi - lo)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text is empty. Rows that repeat an id are scanned each. Empty tables give an empty result. Further
    columns are ignored, whatever their names. Texts of any length are scanned whole, in linear time.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in (x for whole in batches for x in _pieces(whole, 1)):
            rows = list(scan_batch(batch.column(1), found))
            count = [pa.array([sum(k == kind for _, _, k in r) for r in rows], pa.int64()) for kind in BASE_KINDS]
            digest = [hashlib.sha256(_joined([x for x in r if x[2] in BASE_KINDS]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *count, pa.array(digest, pa.string()), pa.array([_joined(r) for r in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return texts.mapInArrow(lean(scan), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret (overlapping spans united) replaced by ``mark``; null texts stay null."""
    place = docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in (x for whole in batches for x in _pieces(whole, place)):
            texts = batch.column(place).to_pylist()
            for i, spans in enumerate(scan_batch(batch.column(place), found)):
                if spans:
                    out, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            out += [texts[i][at:a], mark]
                        at = max(at, b)
                    texts[i] = "".join([*out, texts[i][at:]])
            yield batch.set_column(place, batch.schema.names[place], pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(lean(mask), docs.schema)
