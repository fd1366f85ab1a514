"""Exact n-gram Jaccard join with a token-group matrix.

A text's set holds the 64-bit hashes of its distinct five-word shingles.
Texts with the same set are one class.  Similar classes form groups: parts of
a large component, or classes of about the same size that share their most
crowded token, so that what a common passage gives is asked group by group
and not class by class; the matrix says which tokens (shingles) each group has in its members' prefixes:
of the tokens in order of frequency, the rarest ``n - ceil(t * n) + 1``, one of
which any two similar sets share.  A query meets the groups
that share as many prefix tokens as their sizes ask for; only
groups whose token union holds at least ``t`` of the query are opened, and
their members compared.

Groups come from a first round that compares each class with one leader, so
a large group of near copies is found by as many comparisons as it has
members, and later rounds only look across components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import U64, mix
from .common import CHUNK_BYTES, chunks, partitions, small_batches, written
from .components import components
from .decontaminate import text_sets

#: Two sets link if 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: log2 of the counters of the frequency sketch: a fixed size, sent to every task.
SKETCH_BITS = 20
_SEGMENT = 1 << 14
#: Members of a group, and queries that share a copy of a group.
GROUP = 64
QUERIES = 256
#: Ids of needed classes are broadcast up to this many, and joined by a shuffle beyond.
MOST_IDS = 500_000


def signature(s: np.ndarray) -> tuple[int, int]:
    a = np.add.reduce(mix(s ^ U64(0x1D8E4E27C47D124F)), dtype=U64)
    b = np.add.reduce(mix(s * U64(0x2545F4914F6CDD1D) + U64(0x632BE59BD9B4E019)), dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class _Seen:
    """Signatures met by a task, so that a copy's tokens are given once; forgetting some costs time only."""

    def __init__(self, most: int = 500_000):
        self.most, self.held = most, set()

    def add(self, key: tuple[int, int]) -> bool:
        if key in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(key)
        return True


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """How many sets have a token of each counter; all documents count, copies within a task once."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), _Seen()
        for table in chunks(batches):
            sets = [s for s in text_sets(table["text"]) if len(s) and seen.add(signature(s))]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        parts = counts.reshape(-1, _SEGMENT)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["segment", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch["segment"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["segment", "counts"])

    schema = "segment int, counts binary"
    parts = _texts(docs).select("text").mapInArrow(count, schema).repartition("segment").mapInArrow(add, schema)
    out = np.zeros((1 << SKETCH_BITS) // _SEGMENT * _SEGMENT, np.uint32).reshape(-1, _SEGMENT)
    for i, x in parts.collect():
        out[i] = np.frombuffer(x, np.uint32)
    return out.reshape(-1)


def prefix(s: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    """The rarest tokens of a sorted set, as many as a similar set can't all lack."""
    n = len(s)
    k = n - (-(-threshold * n // 100)) + 1
    order = np.lexsort((s, counts[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))
    return s[order[:k]]


def document_sets(docs: DataFrame, counts: np.ndarray, threshold: int) -> DataFrame:
    """doc_id, n, the set's signature, and its prefix tokens (null without a doc_id, and for a copy that the task has met)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for table in chunks(batches):
            sets = text_sets(table["text"])
            keys = [signature(s) for s in sets]
            ids = table["doc_id"].is_valid().to_pylist()
            tokens = [prefix(s, counts, threshold).view(np.int64) if len(s) and known and seen.add(k) else None for s, k, known in zip(sets, keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "tokens"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, tokens array<long>")


def _fits(a: str, b: str, threshold: int) -> Column:
    """Sizes that sets of the threshold's similarity can have."""
    return (F.lit(100) * F.least(a, b)) >= F.lit(threshold) * F.greatest(a, b)


def _share(a: Column, b: Column, threshold: int) -> Column:
    """How many prefix tokens two sets of these sizes share at least, if they are similar.

    Up to the end of the earlier of the two prefixes all their common tokens are in both; beyond it at most the
    rest of one set is common.
    """
    kept = lambda n: F.ceil(F.lit(threshold) * n / F.lit(100.0))
    both = F.ceil(F.lit(threshold) * (a + b) / F.lit(100.0 + threshold) - 1e-9)
    return F.greatest(F.lit(1), both - F.greatest(kept(a), kept(b)) + 1)


def _least_share(n: str, least: str, most: str, threshold: int) -> Column:
    """The least ``_share`` of a set of size ``n`` with any size from ``least`` to ``most``.

    Up to ``n`` the share grows with the other size.  Beyond, without its ceilings it falls by a fixed slope; they
    move it by less than 1 either way, so the least is at one of the last sizes, over which it falls by 2.
    """
    slope = threshold / 100 - threshold / (100 + threshold)
    last = [F.greatest(F.col(least), F.col(most) - i) for i in range(math.ceil(2 / slope) + 1)]
    return F.least(*[_share(F.col(n), m, threshold) for m in (F.col(least), *last)])


def needed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the classes ``ids`` (rep, s1), compressed: a text takes a third of its set's bytes, and gives the set again."""
    small = ids.count() <= MOST_IDS
    rows = _texts(docs).join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("rep")).select("rep", "s1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for table in chunks(batches):
            keep = [(r, squeeze(t.encode())) for r, s1, t, s in zip(table["rep"].to_pylist(), table["s1"].to_pylist(), table["text"].to_pylist(), text_sets(table["text"]), strict=True) if signature(s)[0] == s1]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in keep], pa.int64()), pa.array([t for _, t in keep], pa.binary())], ["rep", "text"])

    return rows.mapInArrow(run, "rep long, text binary").dropDuplicates(["rep"])


def open_groups(pairs: DataFrame, members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links (u, v) between queries and members of the groups they are paired with.

    ``pairs`` (q, g, component), ``members`` (g, rep, component), ``texts`` (rep, text).  A query gets one link
    to each other component of a group that it is similar to.  A group's
    members come once for every QUERIES of its queries, ahead of them, so no
    task gathers a popular group's queries and no pair carries a group.
    """
    copies = pairs.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies"))
    asked = pairs.join(copies, "g").select("g", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("q").alias("rep"), "component")
    held = members.join(copies, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "rep", "component")
    rows = asked.unionByName(held).join(texts, "rep").select("g", "copy", "kind", "rep", "component", "text")
    rows = rows.repartition(partitions(rows), "g", "copy").sortWithinPartitions("g", "copy", "kind", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, union = None, [], None
        for batch in batches:
            links = []
            for g, copy, kind, rep, component, s in zip(*(batch[c].to_pylist() for c in ("g", "copy", "kind", "rep", "component")), _sets_of(batch["text"]), strict=True):
                if (g, copy) != at:
                    at, group, union = (g, copy), [], None
                if kind == 0:
                    group.append((rep, component, s))
                    continue
                if union is None:
                    union = group[0][2] if len(group) == 1 else np.unique(np.concatenate([x for _, _, x in group]))
                if not len(union) or 100 * _shared(s, union) < threshold * len(s):
                    continue
                linked = {component}
                for other, of, x in group:
                    if of not in linked and 100 * min(len(x), len(s)) >= threshold * max(len(x), len(s)):
                        both = _shared(s, x)
                        if 100 * both >= threshold * (len(x) + len(s) - both):
                            links.append((rep, other))
                            linked.add(of)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])

    small_batches(pairs.sparkSession)
    return rows.mapInArrow(run, "u long, v long")


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of compressed texts, some millions of characters at a time."""
    expand = zstandard.ZstdDecompressor().decompress
    held, size = [], 0
    for text in column:
        held.append(expand(text.as_py()))
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from text_sets(pa.chunked_array([pa.array(held, pa.binary()).cast(pa.string())]))
            held, size = [], 0
    if held:
        yield from text_sets(pa.chunked_array([pa.array(held, pa.binary()).cast(pa.string())]))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    ``component_id`` is the least doc_id that links reach; links join sets
    of the threshold's Jaccard similarity.  Empty or null texts have no
    shingles and are linked with nothing, nor are rows with a null doc_id
    (their component_id is null).  Repeated rows are kept.  Other columns are
    dropped.
    """
    rows = written(document_sets(docs, frequency_sketch(docs), threshold), "sets")
    known = rows.where("n > 0 and doc_id is not null")
    reps = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens", ignorenulls=True).alias("tokens")), "classes")
    tokens = reps.select("rep", "n", F.explode("tokens").alias("token"))

    # first round: each class and the leader of most of its tokens
    twice = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    shared = written(tokens.join(twice, "token"), "shared")
    first = shared.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("first"))
    led = shared.join(first, "token").where(F.col("rep") != F.col("first.rep")).where(_fits("n", "first.n", threshold))
    votes = led.groupBy("rep", F.col("first.rep").alias("g"), "n", F.col("first.n").alias("of")).agg(F.count("*").alias("votes")).where(F.col("votes") >= _share(F.col("n"), F.col("of"), threshold))
    star = written(votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("g")).alias("g"))).alias("best")).select(F.col("rep").alias("q"), (-F.col("best.g")).alias("g")), "stars")
    ids = star.select(F.col("q").alias("rep")).unionByName(star.select(F.col("g").alias("rep"))).distinct()
    keys = reps.select("rep", "s1")
    texts = written(needed_texts(docs, keys.join(ids, "rep")), "needed")
    leaders = star.select("g", F.col("g").alias("rep"), F.lit(0).alias("component")).distinct()
    links = written(open_groups(star.withColumn("component", F.lit(1)), leaders, texts, threshold), "links")

    # second round: across the components found so far, by the token-group matrix
    found = components(links)
    placed = shared.select("token", "rep", "n").join(found.withColumnRenamed("u", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    open_tokens = written(placed.join(mixed, "token"), "open-tokens")
    crowd = open_tokens.groupBy("token").agg(F.count("*").alias("k"))
    home = open_tokens.join(crowd, "token").groupBy("rep", "component", "n").agg(F.max(F.struct("k", "token"))["token"].alias("home"))
    home = written(home, "homes")
    room = home.groupBy("component").agg(F.count("*").alias("classes"))
    near = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / threshold))  # sizes that may be similar, or next to it
    kind = F.when(F.col("classes") >= GROUP, F.xxhash64(F.lit(0), "component")).otherwise(F.xxhash64(F.lit(1), "home", near))
    placed = home.join(room, "component").select("rep", "component", "n", kind.alias("kind"))
    parts = placed.groupBy("kind").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    grouped = placed.join(parts, "kind").select("rep", "component", "n", F.xxhash64("kind", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("g"))
    grouped = written(grouped, "groups")
    spans = grouped.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    owned = written(open_tokens.select("token", "rep", "n").join(grouped.select("rep", "g"), "rep"), "owned-tokens")
    matrix = owned.groupBy("token", "g").agg(F.count("*").alias("classes")).join(spans, "g")
    wide = (F.lit(100) * F.col("n") >= F.lit(threshold) * F.col("least")) & (F.lit(100) * F.col("most") >= F.lit(threshold) * F.col("n"))
    # of two groups the one of the lesser id asks; within its own group a query's token counts if others have it
    asks = (F.col("g") > F.col("own")) | ((F.col("g") == F.col("own")) & (F.col("classes") > 1))
    pairs = owned.withColumnRenamed("g", "own").join(matrix, "token").where(asks & wide)
    pairs = pairs.groupBy(F.col("rep").alias("q"), "g", "n", "least", "most").agg(F.count("*").alias("common"))
    pairs = pairs.where(F.col("common") >= _least_share("n", "least", "most", threshold)).select("q", "g")
    pairs = written(pairs.join(grouped.select(F.col("rep").alias("q"), "component"), "q"), "pairs")
    members = grouped.select("g", "rep", "component").join(pairs.select("g").distinct(), "g", "left_semi")
    ids = pairs.select(F.col("q").alias("rep")).unionByName(members.select("rep")).distinct().join(texts.select("rep"), "rep", "left_anti")
    more = written(needed_texts(docs, keys.join(ids, "rep")), "needed")
    links = links.unionByName(open_groups(pairs, members, texts.unionByName(more), threshold))

    final = components(links)
    named = reps.select("s1", "s2", "rep").join(final.withColumnRenamed("u", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their component, with all their columns."""
    gone = jaccard_components(docs.select("doc_id", "text"), threshold).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
