"""Sinks: nested reports, packages, verdicts, manifests, id lists.  Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import MANIFEST


def write_nested(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row: reports, evidence, packages or verdicts."""
    rows.write.mode(mode).json(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet, in folders by the columns of ``by``."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_manifest(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The manifest's columns as CSV; columns that are missing are empty, a missing status is pending."""
    have = {c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in MANIFEST}
    have["status"] = F.coalesce(have["status"], F.lit("pending"))
    rows.select(*[e.alias(c) for c, e in have.items()]).write.mode(mode).csv(path, header=True)


def write_ids(rows: DataFrame, path: str, column: str, mode: str = "error") -> None:
    """One id per line."""
    rows.select(F.col(column).cast("string")).write.mode(mode).text(path)


def new_only(rows: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows whose output doesn't exist yet, for a resumed run."""
    return rows if done is None else rows.join(done.select(*keys).distinct(), keys, "left_anti")
