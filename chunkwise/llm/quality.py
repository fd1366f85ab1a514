"""Quality rules: counts of each text, and a calibrated classifier over hashed word and character n-grams.

A text passes if the base rule does not fail and the classifier's calibrated
probability of good quality reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import SPACE, U64, mix, prefix_hashes, span_hashes, word_spans
from .common import chunks, raw, small_batches

BUCKETS = 1 << 16
#: Weight of the mean over a text's n-grams in the logit.
SCALE = 12.0
#: Labelled rows that the classifier is fitted on; the first by a hash of doc_id.  A quarter of them calibrates.
FIT_ROWS = 4000
#: Bytes of text of the fitted rows, at most: later rows by the hash are left out, so the driver's features stay bounded.
FIT_BYTES = 16 << 20
#: The verdict is to keep at this calibrated probability of good quality or more.
KEEP_AT = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class QualityModel:
    """Mean weights of a text's word and character n-grams, and the calibration; without weights all texts pass."""

    words: np.ndarray | None = None
    letters: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


class Grams:
    """Hashed n-grams of a chunk of texts: of words (one and two) and of characters, that is code points (three and four)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.bounds = word_spans(data, offsets)
        self.sums = prefix_hashes(data)
        self.hashes = span_hashes(self.sums, self.starts, self.ends)
        self.char_offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets]

    def word_buckets(self) -> list[tuple[np.ndarray, int]]:
        one = (self.hashes >> U64(48)).astype(np.uint16)
        two = (mix(self.hashes[:-1] * U64(3) + self.hashes[1:]) >> U64(48)).astype(np.uint16)
        return [(one, 0), (two, 1)]

    def letter_buckets(self) -> list[tuple[np.ndarray, int]]:
        chars = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), "<u4").astype(U64)
        n = len(chars)
        three = chars[: n - 2] | (chars[1 : n - 1] << U64(21)) | (chars[2:] << U64(42)) if n > 2 else chars[:0]
        four = three[:-1] * U64(0x9E3779B97F4A7C15) + chars[3:] if n > 3 else chars[:0]
        return [((x * U64(m) >> U64(48)).astype(np.uint16), k) for x, m, k in ((three, 0x9FB21C651E98DF25, 2), (four, 0xD6E8FEB86659FD93, 3))]

    @staticmethod
    def means(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the slices; a slice that ends before it begins is empty."""
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        end = np.maximum(np.minimum(end, len(values)), begin)
        begin = np.minimum(begin, len(values))
        end = np.maximum(end, begin)
        return sums[end] - sums[begin], end - begin

    def logits(self, model: QualityModel) -> np.ndarray:
        out = np.full(len(self.offsets) - 1, model.bias)
        for weights, begin, end, groups in ((model.words, self.bounds[:-1], self.bounds[1:], self.word_buckets()), (model.letters, self.char_offsets[:-1], self.char_offsets[1:], self.letter_buckets())):
            total = np.zeros(len(out))
            count = np.zeros(len(out))
            for buckets, shorter in groups:
                s, c = self.means(weights[buckets], begin, end - shorter)
                total, count = total + s, count + c
            out += SCALE * total / np.maximum(count, 1)
        return out

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its buckets (characters' after the words') and their shares."""
        out = []
        words, letters = self.word_buckets(), self.letter_buckets()
        for i in range(len(self.offsets) - 1):
            index, share = [], []
            for base, groups, a, b in ((0, words, self.bounds[i], self.bounds[i + 1]), (BUCKETS, letters, self.char_offsets[i], self.char_offsets[i + 1])):
                parts = [x[a : max(a, b - k)] for x, k in groups]
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                index.append(found.astype(np.int32) + base)
                share.append((n / max(1, n.sum())).astype(np.float32))
            out.append((np.concatenate(index), np.concatenate(share)))
        return out

    def counts(self) -> dict[str, np.ndarray]:
        """The base counts of each text."""
        data, offsets, bounds = self.data, self.offsets, self.bounds
        n = len(offsets) - 1

        def within(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

        solid = ~SPACE[data]
        newline = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], newline + 1]))
        ends = np.sort(np.concatenate([newline, offsets[1:]]))
        of = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(newline, offsets)))
        filled = np.diff(np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])[np.stack([starts, ends])], axis=0)[0] > 0
        starts, ends, of = starts[filled], ends[filled], of[filled]
        lines = mix(span_hashes(self.sums, starts, ends) + mix(of.astype(U64) + U64(1)))
        order = np.lexsort((np.arange(len(lines)), lines))
        again = order[1:][lines[order][1:] == lines[order][:-1]]

        words_of = np.repeat(np.arange(n), np.diff(bounds))
        covered = np.zeros(len(words_of), bool)
        if len(words_of) >= 3:
            h = self.hashes
            three = mix((h[:-2] * U64(0x9FB21C651E98DF25) + h[1:-1]) * U64(0x9FB21C651E98DF25) + h[2:] + mix(words_of[:-2].astype(U64) + U64(7)))
            inside = np.flatnonzero(words_of[:-2] == words_of[2:])
            three = three[inside]
            order = np.argsort(three)
            same = three[order][1:] == three[order][:-1]
            twice = np.zeros(len(three), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            covered[at] = covered[at + 1] = covered[at + 2] = True
        n_words = np.diff(bounds)
        repeat = np.bincount(words_of[covered], minlength=n)
        return {
            "n_words": n_words.astype(np.int64),
            "word_chars": within(solid & ((data & 0xC0) != 0x80)),
            "n_symbols": within(SYMBOLS[data]),
            "n_dup_lines": np.bincount(of[again], minlength=n).astype(np.int64),
            "n_repeat_words": repeat.astype(np.int64),
            "base_failed": (n_words < 50) | (100 * repeat > 50 * n_words),
        }


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, epochs: int = 10, most_bytes: int = FIT_BYTES) -> QualityModel:
    """Logistic regression on ``rows`` labelled rows (quality 1 good, 0 bad), then Platt calibration on a quarter of them.

    Rows are taken by a hash of doc_id, as long as their texts have ``most_bytes`` in all; a text that is longer by itself is left out.  Null labels or ids are left out;
    of several labels for a doc_id the lowest counts, of several texts the
    first by hash.  If a class is missing, the model lets all texts pass.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sizes = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).alias("size")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("size").alias("size"), F.xxhash64("doc_id").alias("at"))
    found, total = [], 0
    for row in sorted(sizes.collect(), key=lambda r: (r["at"], r["doc_id"])):
        if total + (row["size"] or 0) <= most_bytes:
            total += row["size"] or 0
            found.append((row["doc_id"],))
    chosen = chosen.join(F.broadcast(docs.sparkSession.createDataFrame(found, chosen.select("doc_id").schema)), "doc_id", "left_semi")
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            features = Grams(*raw(table["text"])).features()
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks().cast(pa.int64()), table["quality"].combine_chunks(), pa.array([i.tobytes() for i, _ in features], pa.binary()), pa.array([s.tobytes() for _, s in features], pa.binary())],
                ["doc_id", "quality", "buckets", "shares"],
            )

    found = picked.mapInArrow(run, "doc_id long, quality int, buckets binary, shares binary").toPandas()
    found = found.sort_values(["doc_id", "buckets"], kind="stable").drop_duplicates("doc_id")
    y = found["quality"].to_numpy(np.float64)
    held = np.arange(len(y)) % 4 == 3
    if len({*y[~held].tolist()}) < 2 or len({*y[held].tolist()}) < 2:
        return QualityModel()
    index = [np.frombuffer(x, np.int32) for x in found["buckets"]]
    share = [np.frombuffer(x, np.float32) for x in found["shares"]]
    weights, bias = np.zeros(2 * BUCKETS), 0.0
    slots = np.zeros((2, 2 * BUCKETS + 1))
    random = np.random.default_rng(5)
    fitted, step = np.flatnonzero(~held), 0

    def logits(rows: np.ndarray) -> np.ndarray:
        return np.array([bias + SCALE * float(weights[index[r]] @ share[r]) for r in rows])

    for _ in range(epochs):
        for some in np.array_split(random.permutation(fitted), max(1, len(fitted) // 128)):
            error = _sigmoid(logits(some)) - y[some]
            slope = np.zeros(2 * BUCKETS + 1)
            slope[:-1] = np.bincount(np.concatenate([index[r] for r in some]), np.concatenate([e * SCALE * share[r] for e, r in zip(error, some, strict=True)]), 2 * BUCKETS) / len(some) + 1e-6 * weights
            slope[-1] = error.mean()
            step += 1
            slots[0] = 0.9 * slots[0] + 0.1 * slope
            slots[1] = 0.99 * slots[1] + 0.01 * slope**2
            move = 0.1 * (slots[0] / (1 - 0.9**step)) / (np.sqrt(slots[1] / (1 - 0.99**step)) + 1e-5)
            weights -= move[:-1]
            bias -= move[-1]
    z, target = logits(np.flatnonzero(held)), y[held]
    good = (target.sum() + 1) / (target.sum() + 2)
    bad = 1 / (len(target) - target.sum() + 2)
    target = np.where(target == 1, good, bad)
    ab = np.array([1.0, 0.0])

    def loss(x: np.ndarray) -> float:
        v = x[0] * z + x[1]
        return float((np.logaddexp(0, v) - target * v).sum() + 0.5 * (x[0] - 1) ** 2 + 0.005 * x[1] ** 2)

    for _ in range(30):  # Newton's steps, halved until they help; the penalty holds a separable sample's slope
        p = _sigmoid(ab[0] * z + ab[1])
        w = p * (1 - p)
        g = np.array([((p - target) * z).sum() + ab[0] - 1, (p - target).sum() + 0.01 * ab[1]])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        while np.abs(move).max() > 1e-9 and loss(ab - move) > loss(ab):
            move = move / 2
        ab = ab - move
    a, b = ab.tolist()
    return QualityModel(weights[:BUCKETS].astype(np.float32), weights[BUCKETS:].astype(np.float32), float(bias), float(a), float(b))


def judge(column: pa.ChunkedArray, model: QualityModel) -> dict[str, np.ndarray]:
    grams = Grams(*raw(column))
    out = grams.counts()
    n = len(out["n_words"])
    out["probability"] = np.ones(n) if model.words is None else _sigmoid(model.slope * grams.logits(model) + model.shift)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= KEEP_AT)
    return out


def quality_rules(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and probability of each row of ``docs`` (doc_id, text).

    Null or empty text has no words and so fails the base rule.  Repeated
    rows and null ids are kept; other columns, whatever their names, are
    dropped.  One pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            found = judge(table["text"], model)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), *map(pa.array, found.values())], ["doc_id", *found])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            yield from table.filter(pa.array(judge(table["text"], model)["kept"])).to_batches()

    return docs.mapInArrow(run, docs.schema)
