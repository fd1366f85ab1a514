"""Line dedup by distinct-site spread, with DataFrame functions only.

Each trimmed line that isn't empty is known by a 128-bit hash; the hashes of
all lines are one scratch table.  Lines that occur less often than the
threshold can't be on as many sites, which a plain count tells.  For the
others a HyperLogLog sketch of the sites is merged by aggregation: lines whose
estimate is near the threshold get an exact distinct count, lines clearly
above it are boilerplate at once.  Boilerplate goes from every document except
where it comes first (lowest doc_id, then lowest line), so no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: A line on at least this many sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketches' size; estimates within NEAR of the threshold are counted exactly.
LOG_SIZE = 12
NEAR = 0.1
#: Sets of lines and of documents are broadcast up to this many rows; beyond, a join by shuffle deals each line to SALTS tasks.
MOST_ROWS = 200_000
SALTS = 16
HASHES = ["h1", "h2"]
ROW = ["known", "key", "copy"]


def _keys(docs: DataFrame, text: str) -> dict[str, Column]:
    """A row's place in order, and what tells rows of equal doc_id apart; rows that repeat both are treated alike."""
    doc_id = F.col("doc_id").cast("long")
    return {"known": doc_id.isNotNull(), "key": F.coalesce(doc_id, F.lit(0)), "copy": F.xxhash64(text)}


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(row key, position, line hash, site) of each line that isn't empty."""
    named = [c.alias(n) for n, c in _keys(docs, text).items()]
    exploded = docs.select(*named, F.col(site).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).withColumn("line", F.trim("line"))
    return exploded.where("line <> ''").select(*ROW, "at", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"))


def _met(lines: DataFrame, some: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``some``, a table by line hash.  A very common line is dealt to SALTS tasks."""
    if some.count() <= MOST_ROWS:
        return lines.join(F.broadcast(some), HASHES)
    salted = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64(*ROW, "at"), F.lit(SALTS)).cast("int")).join(salted, [*HASHES, "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line hash, first place) of the lines on at least ``min_sites`` distinct sites; null sites don't count."""
    often = written(lines.groupBy(*HASHES).agg(F.count("site").alias("n")).where(F.col("n") >= min_sites).select(*HASHES), "often-lines")
    met = _met(lines, often)
    spread = met.groupBy(*HASHES).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_SIZE))).alias("sites"), F.min(F.struct(*ROW, "at")).alias("first"))
    spread = spread.where(F.col("sites") >= min_sites * (1 - NEAR)).select(*HASHES, "first", (F.col("sites") < min_sites * (1 + NEAR)).alias("near"))
    spread = written(spread, "line-spread")
    exact = _met(lines, spread.where("near").select(*HASHES)).groupBy(*HASHES).agg(F.count_distinct("site").alias("exact"))
    kept = spread.join(exact, HASHES, "left").where(~F.col("near") | (F.col("exact") >= min_sites)).select(*HASHES, "first")
    # as a table of its own, its join with the lines can be broadcast or split where a line is in very many documents
    found = written(kept, "boilerplate")
    drop(often, spread)
    return found


def mark_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(row, gone) for each row of ``docs``, as a struct, with the positions of the lines to remove (null if none).

    Rows with a null doc_id come first in order; rows that repeat an id and
    text are treated alike.  Empty text is one empty line, null text has none.
    """
    lines = written(_lines(docs, text, site), "lines", compression="zstd")
    boiler = boilerplate(lines, min_sites)
    found = _met(lines, boiler).where(F.struct(*ROW, "at") != F.col("first"))
    gone = written(found.groupBy(*ROW).agg(F.collect_set("at").alias("gone")), "gone-lines")
    drop(lines, boiler)
    keyed = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in _keys(docs, text).items()])
    return keyed.join(F.broadcast(gone) if gone.count() <= MOST_ROWS else gone, ROW, "left").select("row", "gone")


def _kept(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (null if text is) of each row of ``docs`` (doc_id, text, source)."""
    marked = mark_lines(docs.select("doc_id", "text", "source"), min_sites)
    text = F.col("row.text")
    kept = F.when(F.col("gone").isNull(), text).otherwise(_kept(text))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return marked.select(F.col("row.doc_id").cast("long").alias("doc_id"), size(F.split(text, "\n", -1)).alias("n_lines"), size("gone").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the boilerplate lines removed from text (n_chars, if there, follows); all rows stay, with their columns."""
    text = F.col("row.text")
    new = {"text": _kept(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return mark_lines(docs, min_sites).select(*[(F.when(F.col("gone").isNull(), old[c]).otherwise(new[c]) if c in new else old[c]).alias(c) for c in docs.columns])
