"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram's vector binds
(multiplies) its letters' vectors, permuted by their distance from the end;
a text's vector bundles (adds) those of its n-grams; a language's prototype
bundles all texts of the language.  The prediction is the language whose
prototype has the largest cosine with the text's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw, small_batches

DIMENSIONS = 1024
SEED = 1009
UNKNOWN = "und"
#: n-gram vectors remembered by a Python worker; beyond that they are made anew.
MOST_GRAMS = 40_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, 0 if it is none."""
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(maxsize=4096)
def letter_vector(letter: int) -> np.ndarray:
    return np.random.default_rng([SEED, letter]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def gram_vector(gram: int) -> np.ndarray:
    """The bound vector of three letters (0: a word's border), 21 bits each."""
    a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class GramVectors:
    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((256, DIMENSIONS), np.int8)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the grams' vectors, each times its count."""
        out = np.zeros(DIMENSIONS)
        for a in range(0, len(grams), 4096):
            some = grams[a : a + 4096].tolist()
            if len(self.rows) + len(some) > MOST_GRAMS:
                self.clear()
            at = np.fromiter((self._row(g) for g in some), np.int64, len(some))
            out += counts[a : a + 4096].astype(np.float32) @ self.matrix[at].astype(np.float32)
        return out

    def _row(self, gram: int) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            if row == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[row] = gram_vector(gram)
        return row


_VECTORS = GramVectors()


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams of all texts, and their bounds; words are bordered by 0."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    table = _letters()
    letters = table[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        letters[i] = points[i] if chr(points[i]).isalpha() else 0
    # a border before each text, then runs of borders become one
    letters = np.insert(letters, starts[:-1], 0)
    starts = starts + np.arange(len(starts))
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0
    keep[starts[:-1]] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[starts]
    seq = np.append(letters[keep], 0).astype(np.uint64)
    # a window belongs to the text of its middle, which is a letter
    middle = np.flatnonzero(seq[1:-1] > 0) + 1 if len(seq) > 2 else np.zeros(0, np.int64)
    grams = (seq[middle - 1] << np.uint64(42)) | (seq[middle] << np.uint64(21)) | seq[middle + 1]
    return grams.astype(np.int64), np.searchsorted(middle, bounds)


def learn_languages(docs: DataFrame, learn: Column) -> dict[str, np.ndarray]:
    """Prototype of each non-null lang among the rows where ``learn`` holds, from all their texts.

    Collected to the driver: one vector for each language, whatever the number of rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table in chunks(batches):
            grams, bounds = text_grams(*raw(table["text"]))
            langs = table["lang"].to_pylist()
            for lang in sorted({*langs}):
                own = np.concatenate([grams[bounds[i] : bounds[i + 1]] for i, x in enumerate(langs) if x == lang])
                if len(own):
                    sums[lang] = sums.get(lang, 0) + _VECTORS.bundle(*np.unique(own, return_counts=True))
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()])], ["lang", "vector"])

    rows = docs.where(learn & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), "lang").mapInArrow(run, "lang string, vector array<double>")
    sums = rows.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, at, x in sums.collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[at] = x
    return dict(sorted(out.items()))


def predict_languages(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (cosine, from 0) of each row; ``und`` with score 0 if text is null or has no letter.

    Only text is used.  Without prototypes all are ``und``; equal cosines
    take the first language by name.  Repeated rows and null ids are kept,
    other columns dropped.  One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    names = [*prototypes, UNKNOWN]
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()]).reshape(-1, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            grams, bounds = text_grams(*raw(table["text"]))
            best, score = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if a == b or not len(unit):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                vector = _VECTORS.bundle(*np.unique(grams[a:b], return_counts=True))
                cosine = unit @ vector / max(np.linalg.norm(vector), 1e-12)
                at = int(cosine.argmax())
                best.append(names[at])
                score.append(float(min(1.0, max(0.0, cosine[at]))))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
