"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of shingles.  An item's sketch is the
bottom of its MinHash order: its ``n - ceil(t * n) + 1`` least shingle
hashes.  A document that holds at least ``t`` of the item's shingles misses
at most ``n - ceil(t * n)`` of them, so it holds one of the sketch: the search
loses nothing, however long the document is (a fixed number of independent
MinHash values would, as the Jaccard similarity of a short item and a long
document nears 0).  A partition is searched only by documents with enough
shingles for its smallest item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import LOWER, U64, shingle_sets, word_hashes
from .common import chunks, raw, small_batches

WORDS = 5
#: Containment of at least THRESHOLD hundredths of an item's shingles.
THRESHOLD = 80
#: Items are sent to every task while they have at most this many shingles (8 bytes each) in all.
MOST_SENT = 2_000_000
PAIRS = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def least_shared(n: int | np.ndarray, threshold: int = THRESHOLD):
    return -(-n * threshold // 100)


def sketch_size(n: int, threshold: int = THRESHOLD) -> int:
    return n - int(least_shared(n, threshold)) + 1


def text_sets(column: pa.ChunkedArray, k: int = WORDS) -> list[np.ndarray]:
    data, offsets = raw(column)
    hashes, _, _, bounds = word_hashes(LOWER[data], offsets)
    return shingle_sets(hashes, bounds, k)


def shingle_table(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, shingles array) of each row with a non-null key and at least one word."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            sets = text_sets(table["text"])
            some = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [table["key"].combine_chunks().take(pa.array(some, pa.int64())), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([sets[i].view(np.int64) for i in some], pa.list_(pa.int64()))],
                ["key", "n", "shingles"],
            )

    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long, shingles array<long>")


class ItemIndex:
    """Partitions of items by size (powers of two), each with the items of every sketch hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: int = THRESHOLD):
        self.threshold = threshold
        self.sets = [(key, np.sort(s.view(U64))) for key, s in sorted(items, key=lambda x: x[0])]
        self.partitions: dict[int, tuple[int, dict[int, list[int]]]] = {}
        for i, (_, s) in enumerate(self.sets):
            part = len(s).bit_length()
            least, sketch = self.partitions.get(part, (1 << 62, {}))
            for h in s[: sketch_size(len(s), threshold)].tolist():
                sketch.setdefault(h, []).append(i)
            self.partitions[part] = (min(least, int(least_shared(len(s), threshold))), sketch)
        every = np.array(sorted({h for _, sketch in self.partitions.values() for h in sketch}), U64)
        self.every = every
        self.low = np.zeros(1 << 20, bool)
        self.low[(every & U64(0xFFFFF)).astype(np.int64)] = True

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, shared shingles) of the items that ``doc``'s sorted shingles contain."""
        near = doc[self.low[(doc & U64(0xFFFFF)).astype(np.int64)]]
        if not len(near) or not len(self.every):
            return []
        at = np.minimum(np.searchsorted(self.every, near), len(self.every) - 1)
        near = near[self.every[at] == near].tolist()
        if not near:
            return []
        found = {i for least, sketch in self.partitions.values() if len(doc) >= least for h in near for i in sketch.get(h, ())}
        out = []
        for i in sorted(found):
            key, s = self.sets[i]
            at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
            shared = int((doc[at] == s).sum())
            if shared >= least_shared(len(s), self.threshold):
                out.append((key, len(s), shared))
        return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, most_sent: int = MOST_SENT) -> DataFrame:
    """Pairs of documents and the items whose shingles they contain: doc_id, item_id, n_item_shingles, n_shared, containment.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns
    are ignored.  Shingles are of five words, ASCII letters in lower case; a
    text of fewer words is one shingle; a text without words, or null, has
    none and is in no pair, nor is a row with a null id.  Of repeated ids
    each row is looked at, and equal pairs are one.  While the items are few
    they are sent to every task and no row is shuffled; beyond ``most_sent``
    shingles the same sketches are joined by hash.
    """
    sets = shingle_table(items.select("item_id", "text"), "item_id").dropDuplicates()
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > most_sent:
        return _contaminated_by_join(docs, sets, threshold)
    index = ItemIndex([(r["key"], np.array(r["shingles"], np.int64)) for r in sets.collect()], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            found = [(key, *x) for key, s in zip(table["doc_id"].to_pylist(), text_sets(table["text"]), strict=True) for x in index.search(s)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[3] / x[2] for x in found], pa.float64())], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    small_batches(docs.sparkSession)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, PAIRS).dropDuplicates()


def _contaminated_by_join(docs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    need = f"cast(-floor(-n * {threshold} / 100D) as long)"
    order = F.transform("shingles", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))  # unsigned order
    items = sets.select(F.col("key").alias("item_id"), F.col("n").alias("n_item"), F.expr(need).alias("need"), F.col("shingles"), F.array_sort(order).alias("o"))
    sketch = items.select("item_id", "n_item", "need", F.explode(F.expr("slice(o, 1, cast(n_item - need + 1 as int))")).alias("h")).withColumn("h", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    rows = shingle_table(docs.select("doc_id", "text"), "doc_id").select(F.col("key").alias("doc_id"), "n", F.explode("shingles").alias("h"))
    pairs = rows.join(sketch, "h").where("n >= need").select("doc_id", "item_id").distinct()
    shared = pairs.join(items.select("item_id", "n_item", "need", F.explode("shingles").alias("h")), "item_id").join(rows.select("doc_id", "h").distinct(), ["doc_id", "h"])
    counts = shared.groupBy("doc_id", "item_id", "n_item", "need").agg(F.count("*").alias("n_shared")).where("n_shared >= need")
    return counts.select("doc_id", "item_id", F.col("n_item").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: int = THRESHOLD, null_ids: bool = False) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows with a null id are kept unless ``null_ids``."""
    sets = shingle_table(items.select("item_id", "text"), "item_id").dropDuplicates()
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > MOST_SENT:
        # by the text's hash, as a row's own text decides, whatever its id
        keyed = docs.withColumn("__copy", F.xxhash64(F.col("text").cast("string")))
        found = _contaminated_by_join(keyed.select(F.col("__copy").alias("doc_id"), "text"), sets, threshold).select(F.col("doc_id").alias("__copy")).distinct()
        return keyed.join(found, (keyed["__copy"] == found["__copy"]) & (F.lit(null_ids) | F.col("doc_id").isNotNull()), "left_anti").select(docs.columns)
    index = ItemIndex([(r["key"], np.array(r["shingles"], np.int64)) for r in sets.collect()], threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            clean = [(key is None and not null_ids) or not index.search(s) for key, s in zip(table["doc_id"].to_pylist(), text_sets(table["text"]), strict=True)]
            yield from table.filter(pa.array(clean, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
