"""Language identification with bit-sliced Bloom filters of character n-grams.

A text's letters, lower-cased, with one blank for whatever lies between them, give overlapping trigrams, packed
exactly into 64 bits. Training counts trigrams by language over all training texts and keeps those that make up
``least_share`` or more of a language, so a language has at most 1 / least_share of them, whatever the corpus. One table holds a
mask of languages for each slot; a trigram sets its language's bit in ``probes`` slots. A look-up ands the
slots' masks, which returns all languages that contain the trigram at once. A text's popcount for a language,
less the false positives expected from that language's fill, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import cut, mix64

LEAST_SHARE = 1e-4
SLOTS = 1 << 19
PROBES = 3
_CHARS = 1 << 19


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter's code point, 0 for others."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: from, to, then row (from 0) and packed value of each trigram, repeats included."""
    table, lo = letters(), 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= _CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        size = np.array([len(t or "") + 2 for t in texts[lo:hi]])
        raw = np.frombuffer("".join(f" {t or ''} " for t in texts[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = table[raw]
        row = np.repeat(np.arange(hi - lo), size)
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0) | (row[1:] != row[:-1])
        low, row = low[keep].astype(np.uint64), row[keep]
        gram = low[:-2] << np.uint64(42) | low[1:-1] << np.uint64(21) | low[2:]
        # A trigram needs a letter in its middle and lies in one text.
        good = (low[1:-1] != 0) & (row[:-2] == row[2:])
        yield lo, hi, row[1:-1][good], gram[good]
        lo = hi


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    masks: np.ndarray  # (slices, slots) of uint64
    false_share: np.ndarray

    def slots(self, gram: np.ndarray) -> list[np.ndarray]:
        h = mix64(gram)
        return [((h >> np.uint64(20 * j)) & np.uint64(self.masks.shape[1] - 1)).astype(np.int64) for j in range(PROBES)]

    def counts(self, rows: int, row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams by row, and by row and language the corrected number that the language contains."""
        total = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.languages)))
        slots = self.slots(gram)
        for s in range(self.masks.shape[0]):
            mask = self.masks[s][slots[0]]
            for x in slots[1:]:
                mask &= self.masks[s][x]
            # The masks' bytes that hold languages, as a bit matrix; its rows are summed text by text.
            here = min(len(self.languages) - 64 * s, 64)
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-here // 8)], axis=1, bitorder="little")[:, :here]
            some = np.flatnonzero(total)
            if len(some):
                out[some, 64 * s : 64 * s + here] = np.add.reduceat(bits, (np.cumsum(total) - total)[some], axis=0, dtype=np.int64)
        return total, np.clip((out - self.false_share * total[:, None]) / (1 - self.false_share), 0, None)


def learn_languages(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> LanguageModel:
    """A model from all rows with a non-null language. Only the trigrams kept, 1 / least_share a language at most, reach the driver."""
    train = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for lo, hi, row, gram in trigrams(texts):
                for lang in set(langs[lo:hi]):
                    g, n = np.unique(gram[(langs[lo:hi] == lang)[row]], return_counts=True)
                    if lang in held:
                        both = np.concatenate([held[lang][0], g])
                        g, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = g, n.astype(np.int64)
            if sum(len(g) for g, _ in held.values()) > 1 << 20:
                yield from send()
        yield from send()

    counts = cut(train.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.lit(least_share) * F.col("total")).select("lang", "gram").collect()
    languages = tuple(sorted({r.lang for r in kept}))
    masks = np.zeros((-(-len(languages) // 64) or 1, SLOTS), np.uint64)
    model = LanguageModel(languages, masks, np.zeros(len(languages)))
    grams: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in kept:
        grams[r.lang].append(r.gram)
    for i, lang in enumerate(languages):
        gram = np.array(grams[lang], np.int64).view(np.uint64)
        for at in model.slots(gram):
            masks[i // 64][at] |= np.uint64(1 << (i % 64))
        fill = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()
        model.false_share[i] = fill**PROBES
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """doc_id, the carried columns, lang_pred and score of each whole text.

    ``und`` and 0 for a null text or one without a letter, or without a model. The score is the winner's share
    of the text's trigrams, less half of the runner-up's excess over none. Ties go to the first language by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), *carry)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            lang, score = [], []
            for lo, hi, row, gram in trigrams(batch.column(0).to_pylist()):
                total, hits = model.counts(hi - lo, row, gram)
                if not model.languages:
                    hits = np.zeros((hi - lo, 1))
                best = hits.argmax(axis=1)
                rest = hits.copy()
                rest[np.arange(hi - lo), best] = 0
                share = (hits.max(axis=1) - rest.max(axis=1) / 2) / np.maximum(total, 1)
                none = (total == 0) | (len(model.languages) == 0)
                lang += names[np.where(none, len(model.languages), best)].tolist()
                score += np.where(none, 0.0, share.clip(0, 1)).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[1:])
    return texts.mapInArrow(predict, f"{kept}, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents whose crc32(id) mod 3 is not 1.

    A null id is never held out. Repeated rows count each time. Languages with equal counts: the first by name.
    Texts of any length count whole; further columns are ignored, whatever their names. Empty tables give an
    empty result.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn_languages(docs.where(~out), text_col, lang_col)
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), out.alias("held_out"))
    return predict_language(marked, model, "id", "text", "held_out").select("doc_id", "held_out", "lang_pred", "score")
