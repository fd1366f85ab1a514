"""Token-id output: frequency-ranked ids in a byte-aligned code with separate control bytes.

The file format is a Parquet table of blocks.  A block holds some documents
in ascending order of doc_id: ``doc_ids`` and ``counts`` (little-endian 64-bit),
``control`` and ``data``.  Each id is replaced by its rank by frequency in the
corpus, and each rank takes one to four bytes of ``data``; two bits of
``control`` give the number of bytes less one, four ranks to a control byte.
``shard`` and ``block`` order the blocks, ``start`` counts the ids of the
shard before the block.  The row of kind "ranks" holds the id of each rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, partitions, raw, small_batches, written
from .wordids import WordIds

BLOCKS = "kind string, shard int, block int, start long, n_ids long, doc_ids binary, counts binary, control binary, data binary"
#: Bytes of text that are encoded at once, and make a block.
CHUNK = 4 << 20
NULL_ID = np.iinfo(np.int64).min
_SHIFTS = np.arange(4, dtype=np.uint8) * 2
#: For each control byte, the byte lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> _SHIFTS) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = (1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFTS, axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` coded, by table lookup of the control bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    source = np.frombuffer(data, np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    out = source[starts].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= source[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.model._resize_cache(0)  # each distinct word comes once
    [mark] = tokenizer.encode("0", add_special_tokens=False).ids

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words are encoded many at a time with "0" between them; those that hold a "0" alone."""
        single = [i for i, w in enumerate(words) if b"0" in w]
        plain = [w for w in words if b"0" not in w] if single else words
        texts = [(b" 0 ".join(plain[a : a + 4096]) + b" 0").decode() for a in range(0, len(plain), 4096)]
        parts = [np.array(e.ids, np.uint32) for a in range(0, len(texts), 8) for e in tokenizer.encode_batch_fast(texts[a : a + 8], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        stops = np.flatnonzero(ids == mark)
        if len(stops) != len(plain):  # in this vocabulary a word without "0" has its id: all words alone
            each = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
            return np.array([x for own in each for x in own], np.uint32), np.array([len(own) for own in each], np.int64)
        counts = np.diff(stops, prepend=-1) - 1
        ids = ids[ids != mark]
        for i in single:
            own = tokenizer.encode(words[i].decode(), add_special_tokens=False).ids
            ids = np.insert(ids, int(counts[:i].sum()), own)
            counts = np.insert(counts, i, len(own))
        return ids, counts

    return WordIds(encode)


def _block(kind: str, shard: int, block: int, start: int, n: int, docs: bytes, counts: bytes, control: bytes, data: bytes) -> pa.RecordBatch:
    columns = [[kind], pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64())]
    columns += [pa.array([x], pa.binary()) for x in (docs, counts, control, data)]
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, list) else x for x in columns], ["kind", "shard", "block", "start", "n_ids", "doc_ids", "counts", "control", "data"])


def encode_blocks(docs: DataFrame, vocabulary: str, end_id: int, by: Column | None = None) -> DataFrame:
    """Blocks with plain ids of 16 or 32 bits in ``data``, and a row of kind "used" for each shard with its ids' counts.

    One shuffle: range partitions by doc_id, so shard and block order is doc_id order.
    """
    small_batches(docs.sparkSession)
    key = F.col("doc_id")
    tie = F.xxhash64("text")
    ordered = docs.select(key.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(partitions(docs), key, tie).sortWithinPartitions(key, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, shard, start, block = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0, 0
        used = np.zeros(1 << 16, np.int64)
        for table in chunks(batches, most=CHUNK):
            if memory.full():
                memory.clear()
            words = memory.words(*raw(table["text"]))
            memory.flush()
            ids, counts = memory.texts(*words)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id) if len(counts) else ids
            counts = counts + 1
            seen = np.bincount(ids, minlength=len(used))
            used = np.concatenate([used, np.zeros(len(seen) - len(used), np.int64)]) + seen
            docs_of = table["doc_id"].fill_null(int(NULL_ID)).to_numpy().astype("<i8")
            yield _block("ids", shard, block, start, len(ids), docs_of.tobytes(), counts.astype("<i8").tobytes(), b"", ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())
            start, block = start + len(ids), block + 1
        some = np.flatnonzero(used)
        if len(some):
            yield _block("used", shard, -1, 0, len(some), some.astype("<i8").tobytes(), used[some].astype("<i8").tobytes(), b"", b"")

    return ordered.mapInArrow(run, BLOCKS)


def ranked_ids(blocks: DataFrame) -> np.ndarray:
    """The vocabulary's ids that occur, most frequent first (ties: smaller id first); never more than the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts in zip(batch["doc_ids"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], ["id", "n"])

    counts = blocks.where("kind = 'used'").select("doc_ids", "counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the coded blocks; returns the table read back.

    Null text counts as empty, so each document has at least its end id.
    Rows with a null doc_id come first; equal doc_ids are kept as separate
    documents.  Extra columns are ignored.
    """
    plain = written(encode_blocks(docs, vocabulary, end_id), "ids", compression="zstd")
    order = ranked_ids(plain)
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                control, data = pack(rank[np.frombuffer(row["data"], f"<u{len(row['data']) // row['n_ids']}")])
                yield _block("ids", row["shard"], row["block"], row["start"], row["n_ids"], row["doc_ids"], row["counts"], control, data)

    spark = docs.sparkSession
    coded = plain.where("kind = 'ids'").mapInArrow(run, BLOCKS)
    table = spark.createDataFrame([("ranks", -1, -1, 0, len(order), None, None, None, bytearray(order.astype("<u4").tobytes()))], BLOCKS)
    return written(coded.unionByName(table), "tokens", compression="zstd")


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode the blocks: doc_id, shard, start (within the shard), n_tokens and the ids' crc32."""
    [order] = [np.frombuffer(r["data"], "<u4") for r in files.where("kind = 'ranks'").select("data").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = order[unpack(row["control"], row["data"], row["n_ids"])].astype("<u4").tobytes()
                docs, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<i8")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NULL_ID), pa.array(np.full(len(docs), row["shard"], np.int32)), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                )

    return files.where("kind = 'ids'").mapInArrow(run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write, read back, and give each document its place among all ids: doc_id, start, n_tokens, ids_crc32."""
    files = write_token_files(docs, vocabulary, end_id)
    # one row per shard, as many as the shuffle has partitions
    sizes = sorted(tuple(r) for r in files.where("kind = 'ids'").groupBy("shard").agg(F.sum("n_ids")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    bases = docs.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(sizes, before, strict=False)], "shard int, base long")
    return read_token_files(files).join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
