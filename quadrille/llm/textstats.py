"""Statistics of whole texts, computed in one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Words, lean, row_chunks, text_bytes

SYMBOLS = "#*$%&|<>"
#: Exact counts, then the shares and means of the statistic vector.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "upper", "digits", "marks", "dup_lines", "repeats", "pipes", "shouts", "mean_line", "non_ascii")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?\"'()-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])


def _dup_lines(buf: np.ndarray, offs: np.ndarray, words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text, by text; and lines with a word."""
    raw = buf.tobytes()
    out, lines = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        if words.count[i]:
            parts = [x for x in raw[a:b].split(b"\n") if x.strip()]
            lines[i] = len(parts)
            out[i] = len(parts) - len(set(parts))
    return out, lines


def _repeat_words(words: Words) -> np.ndarray:
    """Words inside three-word windows that their text has twice or more."""
    at, h = words.windows(3)
    if not len(at):
        return np.zeros(words.rows, np.int64)
    row = words.row[at]
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words.hash), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return np.bincount(words.row[covered], minlength=words.rows)


def chunk_stats(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """COUNTS as arrays, and the matrix of FEATURES, of the texts in a buffer."""
    words = Words(buf, offs)
    point = (buf & 0xC0) != 0x80  # bytes that begin a code point
    chars, in_words = _sums(point, offs), _sums(point & ~words.space, offs)
    symbols, upper, digits = _sums(_SYMBOL[buf], offs), _sums(_UPPER[buf], offs), _sums(_DIGIT[buf], offs)
    marks, letters, far = _sums(_MARK[buf], offs), _sums(_LETTER[buf] & point, offs), _sums((buf >= 0xC0), offs)
    pipes, shouts = _sums(buf == ord("|"), offs), _sums(buf == ord("!"), offs)
    dups, lines = _dup_lines(buf, offs, words)
    repeats = _repeat_words(words)
    n = words.count.astype(np.int64)
    share = lambda x, y: x / np.maximum(y, 1)
    root = lambda x, y: np.sqrt(share(x, y))
    features = np.stack(
        [np.log1p(n), share(in_words, n).clip(0, 60), root(symbols, chars), root(upper, letters), root(digits, chars), root(marks, chars), root(dups, lines), root(repeats, n), root(pipes, chars), root(shouts, chars), np.log1p(share(n, lines)), root(far, letters)],
        axis=1,
    )
    return [n, in_words, symbols, dups, repeats], features


def statistics(docs: DataFrame, id_col: str, text_col: str, *carry: str) -> DataFrame:
    """doc_id, the carried columns, the COUNTS and features (array of FEATURES) of each whole text."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_bytes(batch.column(0))
            for lo, hi in row_chunks(offs):
                counts, features = chunk_stats(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                at = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[1:]), *(pa.array(c) for c in counts), pa.ListArray.from_arrays(at, pa.array(features.reshape(-1)))],
                    [*batch.schema.names[1:], *COUNTS, "features"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:])
    return texts.mapInArrow(lean(run), f"{kept}, {', '.join(f'{c} bigint' for c in COUNTS)}, features array<double>")
