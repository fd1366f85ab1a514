"""Exact repeated-substring removal with common-prefix interval trees.

Every string of LENGTH bytes that starts at more than one place of the corpus
is found; all bytes that such strings cover are removed.

Anchors.  Of the hashes of the GRAM-byte strings in each window of LENGTH
bytes the least (leftmost) is an anchor, so equal windows have equal anchors
at equal offsets, and any repeat of LENGTH bytes shows as two anchors with
the same hash.  The suffixes at the anchors are a sparse suffix array, cut
into buckets by the anchor's hash.

Classes.  Anchors whose whole contexts (up to LENGTH bytes on either side)
are equal form a class: with two or more members, the context is a repeat.

Intervals.  In a bucket, the classes' suffixes are sorted and their common
prefixes scanned with a stack.  In each interval of the tree (a common prefix
of d bytes), left-extension diversity is tested: members in order of their
reversed left contexts fall apart where fewer than LENGTH - d bytes agree.
What stays together is a maximal repeat group, with all its occurrences.

Crowded buckets (a passage in very many documents) are not gathered.  A pair
that agrees in l bytes before and r after the anchor, l + r >= LENGTH, agrees
in one of a few cores: ``a`` bytes before and ``LENGTH - a - STEP + 1`` after,
for a = 0, STEP, 2 STEP, ...  Cores are counted by hash; the members that share
one form a smaller bucket, in which only the STEP - 1 bytes on either side of
the core are left to compare.  Buckets that are still crowded are divided
again by smaller steps, down to the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import U64, mix, prefix_hashes, span_hashes
from .common import PARTITION_BYTES, chunks, drop, partitions, plan_bytes, raw, settings, small_batches, written

LENGTH = 400
GRAM = 50
WINDOW = LENGTH - GRAM + 1
#: Buckets of more classes are crowded.
CROWD = 256
#: How crowded buckets are divided: bytes to agree in, and the step between cores.  What remains is the step - 1.
DIVISIONS = ((LENGTH, 50), (49, 10), (9, 1))
#: Ids are broadcast up to this many, and joined by a shuffle beyond.
MOST_IDS = 500_000
NULL_KEY = -(1 << 63)
_PLACE_BITS = U64(32)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(NULL_KEY)), "copy": F.xxhash64("text", F.col("doc_id").isNull())})


def anchor_positions(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all anchors, the texts they are in, and their hashes."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    place = np.arange(n)
    hashes = span_hashes(sums, place, place + GRAM)
    least = (hashes >> _PLACE_BITS << _PLACE_BITS) | place.astype(U64)
    width = 1
    while 2 * width <= WINDOW:  # least of 1, 2, 4, ... neighbours
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    rest = WINDOW - width
    least = (np.minimum(least[:-rest], least[rest:]) if len(least) > rest else least[:0]) if rest else least
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - LENGTH + 1, -1)
    at = (least[np.cumsum(valid[:-1]) > 0] & U64(0xFFFFFFFF)).astype(np.int64)
    change = np.ones(len(at), bool)
    change[1:] = at[1:] != at[:-1]
    at = at[change]
    return at, np.searchsorted(offsets, at, "right") - 1, hashes[at]


ANCHORS = "h long, context long, key long, copy long, pos int, before int, after int"


def find_anchors(keyed: DataFrame) -> DataFrame:
    """One row for each anchor: its hash, its context's, its place, and the context's bytes before and after it."""
    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            data, offsets = raw(table["text"])
            sums = prefix_hashes(data)
            at, of, hashes = anchor_positions(data, offsets, sums)
            pos = at - offsets[of]
            before = np.minimum(pos, LENGTH - GRAM)
            after = np.minimum(offsets[of + 1] - at, LENGTH)
            context = mix(span_hashes(sums, at - before, at + after) + (before * 1024 + after).astype(U64) * U64(0x9E3779B97F4A7C15))
            key, copy = (table[c].to_numpy()[of] for c in ("key", "copy"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (hashes.view(np.int64), context.view(np.int64), key, copy, pos.astype(np.int32), before.astype(np.int32), after.astype(np.int32))], ["h", "context", "key", "copy", "pos", "before", "after"]
            )

    return keyed.where(F.octet_length("text") >= LENGTH).select("key", "copy", "text").mapInArrow(run, ANCHORS)


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def prefix_intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(d, first, last) of each interval of sorted suffixes with a common prefix of d, from a stack scan.

    ``common[i]`` is the common prefix of suffixes i and i + 1.  Inner intervals come before those around them.
    """
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > d:
            deep, first = stack.pop()
            yield deep, first, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def repeat_groups(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[list[int], int, list[int]]]:
    """Maximal repeat groups of a bucket: (members, bytes that agree after the anchor, for each the most that agree before it).

    ``lefts`` are reversed.  Two members of a group agree in at least ``length`` bytes in all.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    common = [_shared_prefix(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    by_left = None
    for d, first, last in prefix_intervals(common):
        need = max(0, length - d)
        members = order[first : last + 1]
        if len(members) > 2:
            if by_left is None:
                by_left = {m: r for r, m in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
            members = sorted(members, key=by_left.__getitem__)
        agree = [_shared_prefix(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        start = 0
        for i, n in enumerate([*agree, -1]):
            if n < need:
                if i > start:
                    own = agree[start:i]
                    out.append((members[start : i + 1], d, [max(own[max(0, k - 1) : k + 1]) for k in range(i - start + 1)]))
                start = i + 1
    return out


def _reduced(keyed: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    return keyed.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "key", how)


MEMBERS = "h long, core long, crowded boolean, single boolean, key long, copy long, pos int, back int, left binary, right binary"
_MEMBER = [pa.field(*x) for x in (("h", pa.int64()), ("core", pa.int64()), ("crowded", pa.bool_()), ("single", pa.bool_()), ("key", pa.int64()), ("copy", pa.int64()), ("pos", pa.int32()), ("back", pa.int32()), ("left", pa.binary()), ("right", pa.binary()))]


def _contexts(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """The context bytes of one member of each class, from its text: members of buckets by ``h``."""
    wanted = classes.groupBy("key", "copy").agg(F.collect_list(F.struct("h", "crowded", "single", "pos")).alias("anchors"))
    wanted = written(wanted, "wanted")
    # rows that repeat an id and text would give the same contexts again
    texts = _reduced(keyed, wanted.select("key").distinct(), "left_semi").select("key", "copy", "text").dropDuplicates(["key", "copy"])
    rows = texts.join(wanted, ["key", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, copy, text, anchors in zip(*(batch[c].to_pylist() for c in ("key", "copy", "text", "anchors")), strict=True):
                data = text.encode()
                for a in anchors:
                    pos = a["pos"]
                    out.append((a["h"], 0, a["crowded"], a["single"], key, copy, pos, 0, data[max(0, pos - LENGTH + GRAM) : pos][::-1], data[pos : pos + LENGTH]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_MEMBER)], schema=pa.schema(_MEMBER))

    small_batches(keyed.sparkSession)
    contexts = written(rows.mapInArrow(run, MEMBERS), "contexts", compression="zstd")
    drop(wanted)
    return contexts


SPANS = "key long, copy long, start int, end int"


def _spans_of_buckets(members: DataFrame, need: int) -> DataFrame:
    """Covered spans of the single members, by the interval tree of each bucket (h, core): of two that agree in ``need`` bytes."""
    rows = members.drop("crowded").repartition(partitions(members), "h", "core").sortWithinPartitions("h", "core", "key", "copy", "pos")

    def solve(bucket: list) -> Iterator[tuple]:
        before, after = [-1] * len(bucket), [-1] * len(bucket)
        for found, d, left in repeat_groups([x[7] for x in bucket], [x[8] for x in bucket], need):
            for m, n in zip(found, left, strict=True):
                before[m], after[m] = max(before[m], n), max(after[m], d)
        for (_, _, single, key, copy, pos, back, _, _), b, a in zip(bucket, before, after, strict=True):
            if single and a >= 0:  # the outermost windows start back + b and back + need - a bytes before the anchor
                yield key, copy, pos - back - b, pos - back - max(0, need - a) + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list = []
        for batch in batches:
            out: list = []
            for x in zip(*(batch[c].to_pylist() for c in ("h", "core", "single", "key", "copy", "pos", "back", "left", "right")), strict=True):
                if bucket and bucket[0][:2] != x[:2]:
                    out += solve(bucket)
                    bucket = []
                bucket.append(x)
            yield _span_batch(out)
        yield _span_batch(list(solve(bucket)))

    return rows.mapInArrow(run, SPANS)


def _span_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["key", "copy", "start", "end"])


def _cores(batch: pa.RecordBatch, need: int, step: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(bytes before, bytes after, rows that have them, hashes) of the cores of each row's context."""
    left, right = (batch[c].to_pylist() for c in ("left", "right"))
    data = np.frombuffer(b"".join(x for a, b in zip(left, right, strict=True) for x in (a[::-1], b)), np.uint8)
    before, after = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    middle = np.cumsum(before + after) - after
    sums = prefix_hashes(data)
    old = batch["core"].to_numpy().view(U64)
    for a in range(0, need + 1, step):
        b = max(0, need - a - step + 1)
        some = np.flatnonzero((before >= a) & (after >= b))
        yield a, b, some, mix(span_hashes(sums, middle[some] - a, middle[some] + b) + old[some] * U64(0x9E3779B97F4A7C15) + U64(a + 1) * U64(0xD6E8FEB86659FD93)).view(np.int64)


def _divided(members: DataFrame, need: int, step: int) -> DataFrame:
    """The members of crowded buckets in smaller ones, those with equal cores; members alone in one are gone."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, single = batch["h"].to_numpy(), batch["single"].to_numpy(zero_copy_only=False)
            for _, _, some, core in _cores(batch, need, step):
                yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(core), pa.array(single[some])], ["h", "core", "single"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, back = batch["left"].to_pylist(), batch["right"].to_pylist(), batch["back"].to_numpy()
            for a, b, some, core in _cores(batch, need, step):
                rest = min(step - 1, need - a - b)
                own = batch.select(["h", "single", "key", "copy", "pos"]).take(pa.array(some))
                cut = [pa.array([left[i][a : a + rest] for i in some.tolist()], pa.binary()), pa.array([right[i][b : b + rest] for i in some.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays([own["h"], pa.array(core), own["single"], own["key"], own["copy"], own["pos"], pa.array((back[some] + a).astype(np.int32)), *cut], [f.name for f in _MEMBER if f.name != "crowded"])

    spark = members.sparkSession
    small_batches(spark)
    # rows become many here, and the table is small in bytes: smaller splits keep all cores busy
    split = str(min(max(plan_bytes(members) // (4 * spark.sparkContext.defaultParallelism), 1 << 20), PARTITION_BYTES))
    with settings(spark, spark_sql_files_maxPartitionBytes=split, spark_sql_files_openCostInBytes=str(1 << 18)):
        return _divided_members(members, hashes, rows)


def _divided_members(members: DataFrame, hashes, rows) -> DataFrame:
    counts = members.mapInArrow(hashes, "h long, core long, single boolean").groupBy("h", "core").agg(F.count("*").alias("n"), F.max("single").alias("single"))
    shared = written(counts.where("n > 1 and single").select("h", "core", (F.col("n") > CROWD).alias("crowded")), "cores")
    met = members.mapInArrow(rows, MEMBERS.replace(", crowded boolean", "")).join(F.broadcast(shared) if shared.count() <= MOST_IDS else shared, ["h", "core"])
    met = written(met.select(*[f.name for f in _MEMBER]), "crowd-members", compression="zstd")
    drop(shared)
    return met


def _spans_of_contexts(members: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Covered spans of the single members, and the tables that they are read from."""
    found, tables = None, [members]
    for need, step in DIVISIONS:
        small = _spans_of_buckets(members.where("not crowded"), need)
        found = small if found is None else found.unionByName(small)
        crowded = members.where("crowded")
        if crowded.isEmpty():
            return found, tables
        members = _divided(crowded, need, step)
        tables.append(members)
    # what is left are windows that start ``back`` bytes before the anchor
    ends = members.where("single").groupBy("h", "key", "copy", "pos").agg(F.max("back").alias("most"), F.min("back").alias("least"))
    return found.unionByName(ends.select("key", "copy", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + LENGTH).alias("end"))), tables


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, copy, spans): the runs of bytes of the texts of ``docs`` that repeats cover; those of a text may overlap."""
    return _repeated_spans(_keyed(docs))


def _repeated_spans(keyed: DataFrame) -> DataFrame:
    anchors = written(find_anchors(keyed), "anchors", compression="zstd")
    twice = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    # as a table of its own, its join with the anchors can be split where an anchor is very common
    twice = written(twice.select("h", (F.col("low") != F.col("high")).alias("mixed")), "twice")
    met = written(anchors.join(twice, "h"), "met", compression="zstd")
    drop(anchors, twice)
    # an anchor with one context only needs no join: all its places repeat that context
    mixed = met.where("mixed")
    classes = written(mixed.groupBy("h", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "copy", "pos")).alias("first")), "classes")
    whole = met.where("not mixed").unionByName(mixed.join(classes.where("n > 1").select("h", "context"), ["h", "context"], "left_semi").select(met.columns))
    spans = whole.select("key", "copy", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))

    size = classes.groupBy("h").agg((F.count("*") > CROWD).alias("crowded"), F.min(F.col("n")).alias("least")).where("least = 1").drop("least")
    contexts = _contexts(keyed, classes.join(size, "h").select("h", "crowded", (F.col("n") == 1).alias("single"), "first.*"))
    more, tables = _spans_of_contexts(contexts)
    spans = spans.unionByName(more).groupBy("key", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "spans", compression="zstd")
    drop(met, classes, *tables)
    return spans


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted spans; touching spans are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text), and ``kept`` as binary if asked.

    Text counts as UTF-8 bytes, null as empty.  Repeated rows are documents of
    their own, so their texts of LENGTH bytes and more are repeats; so are
    rows with a null doc_id.  Other columns are dropped.
    """
    keyed = _keyed(docs)
    spans = _repeated_spans(keyed)
    ids = spans.select("key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode()
                gone = merged([(x["start"], x["end"]) for x in found or ()])
                edges = [0, *(x for run in gone for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            some = 5 + with_text
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(some)], names[:some])

    small_batches(docs.sparkSession)
    touched = _reduced(keyed, ids, "left_semi").join(spans, ["key", "copy"], "left").select("doc_id", "text", "spans")
    touched = touched.mapInArrow(run, REPORT + (", kept binary" if with_text else ""))
    whole = _reduced(keyed, ids, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if with_text else []))
    return touched.unionByName(whole)
