"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces of the vocabulary that end at each place of a string; dynamic
programming carries only the best score and its number of pieces. No segmentation is built.

The vocabulary is that of a SentencePiece model file: its normal pieces and their scores, taken as unigram log
probabilities, with its unknown and byte pieces. (The public files hold no unigram model; the one SentencePiece
file is a BPE model whose pieces and scores serve as the unigram's.) The rules are those of the unigram tokenizer in double precision:
a space becomes the mark U+2581, and a text that is not empty gets one in front; a place that no single-character
piece covers can be passed by one unknown character at the least score less 10, which counts as its UTF-8
bytes; of paths with equal scores into one place, that whose last piece starts first stays.

If no piece has a mark after another character, every segmentation is cut before each mark that follows one. Where
scores are whole numbers besides, their sums are exact in double precision, so sums and ties are the same from
whatever place a sum starts: runs of text between such cuts are then counted apart and remembered, which changes
no result. With other scores a text is walked in one piece.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Segments a task remembers at most.
REMEMBERED = 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces with scores; whether unknown characters become bytes; whether texts get a mark in front."""

    pieces: tuple[tuple[str, float], ...]
    bytes_for_unknown: bool = True
    prefix: bool = True
    least: float = field(init=False)
    apart: bool = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "least", min(s for _, s in self.pieces))
        object.__setattr__(self, "apart", not any(MARK in p.lstrip(MARK) or s != int(s) for p, s in self.pieces))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        pieces, fallback, prefix = [], False, True
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    one = dict(_fields(value))
                    if one.get(3, 1) == 1:
                        pieces.append((one[1].decode(), struct.unpack("<f", one[2])[0] if 2 in one else 0.0))
                    fallback |= one.get(3, 1) == 6
                elif number == 3:
                    norm = dict(_fields(value))
                    if norm.get(2):
                        raise ValueError("only vocabularies without character maps are supported")
                    prefix = bool(norm.get(3, 1))
        return cls(tuple(pieces), fallback, prefix)


class Counter:
    """Best score and number of pieces of strings over a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.least - UNKNOWN_PENALTY
        self.remembered: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and its piece count for an already marked string."""
        n = len(text)
        score, count = [0.0], [0]
        best, pieces, single, now = None, 0, False, 0

        def settle() -> None:
            nonlocal best, pieces
            if not single:
                s = score[now] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[now] + (len(text[now].encode()) if self.vocabulary.bytes_for_unknown else 1)
            score.append(best)
            count.append(pieces)

        # For each end the automaton reports the longest piece first, which is the one that starts first.
        for end, (size, worth) in self.automaton.iter(text):
            while now < end:
                settle()
                best, pieces, single, now = None, 0, False, now + 1
            s = score[end + 1 - size] + worth
            if best is None or s > best:
                best, pieces = s, count[end + 1 - size] + 1
            if size == 1:
                single = True
        while now < n:
            settle()
            best, pieces, single, now = None, 0, False, now + 1
        return score[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """Best score and piece count of a text; an empty one has none."""
        if not text:
            return 0.0, 0
        marked = text.replace(" ", MARK)
        if self.vocabulary.prefix:
            marked = MARK + marked
        # Every sum of whole scores stays below 2^53, and so exact, unless a text is millions of characters long.
        if not self.vocabulary.apart or len(marked) * -self.unknown >= 2**53:
            return self.viterbi(marked)
        total, pieces, held = 0.0, 0, self.remembered
        for part in self._parts(marked):
            found = held.get(part)
            if found is None:
                found = self.viterbi(part)
                if len(held) >= REMEMBERED:
                    held.clear()
                if len(part) <= 64:
                    held[part] = found
            total += found[0]
            pieces += found[1]
        return total, pieces

    @staticmethod
    def _parts(marked: str) -> Iterator[str]:
        """The string cut before each mark that follows another character."""
        marks = 0
        first = True
        for word in marked.split(MARK):
            if first:
                first = False
                if word:
                    yield word
                continue
            marks += 1
            if word:
                yield MARK * marks + word
                marks = 0
        if marks:
            yield MARK * marks


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, score.

    Null text counts as empty: no tokens, score 0. Rows that repeat an id are counted each. Texts of any length
    count whole; further columns are ignored, whatever their names. Empty tables give an empty result. The
    vocabulary is read once, on the driver.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(held.value)
        for batch in batches:
            found = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return texts.mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
