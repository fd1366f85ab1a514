"""Array functions over ordered series: windows, resampling, smoothing, similarity.  All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


def numbered(n) -> Column:
    """0, 1, ... n - 1; empty for n < 1."""
    n = col(n).cast("int")
    return F.when(n >= 1, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def deltas(values) -> Column:
    """Absolute differences of neighbours."""
    n = F.size(values)
    return F.transform(numbered(n - 1), lambda i: F.abs(F.get(values, i + 1) - F.get(values, i)))


def paired_windows(n_frames, n_mels, fps, frames: int = 5, mels: int = 16, rate: float = 80.0) -> Column:
    """struct(frame_start, mel_start) of windows of both series that both have in full; ends with the mel series."""
    last = F.least(col(n_frames), F.floor(col(n_mels) / rate * col(fps)).cast("int")) - frames
    starts = F.transform(numbered(last + 1), lambda v: F.struct(v.alias("frame_start"), F.floor(F.lit(rate) * v / col(fps)).cast("int").alias("mel_start")))
    return F.filter(starts, lambda w: w["mel_start"] + mels <= col(n_mels))


def resampled(values, source, target) -> Column:
    """Nearest items of a series at another rate, half to even."""
    n = F.greatest(F.lit(1), F.bround(F.size(values) / col(source) * col(target)).cast("int"))
    return F.transform(numbered(n), lambda i: F.get(values, F.least(F.bround(i * col(source) / col(target)).cast("int"), F.size(values) - 1)))


def stacked(values, by: int = 4) -> Column:
    """Rows of ``by`` items; the last is filled with zeros."""
    rows = F.ceil(F.size(values) / by).cast("int")
    return F.transform(numbered(rows), lambda i: F.transform(F.sequence(F.lit(0), F.lit(by - 1)), lambda k: F.coalesce(F.get(values, i * by + k), F.lit(0.0))))


def smoothed(values, alpha: float = 0.65) -> Column:
    """Exponential smoothing with weight ``alpha`` on the state; nulls keep it, the first value sets it.

    Results are gathered in blocks of 64, so that appending doesn't copy all of them each time.
    """
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(None).cast("double").alias("state"), F.array().cast("array<array<double>>").alias("done"), none.alias("last"))

    def step(acc: Column, x: Column) -> Column:
        state = F.when(acc["state"].isNull(), x).when(x.isNull(), acc["state"]).otherwise(F.lit(alpha) * acc["state"] + F.lit(1 - alpha) * x)
        full = F.size(acc["last"]) >= 64
        done = F.when(full, F.concat(acc["done"], F.array(acc["last"]))).otherwise(acc["done"])
        return F.struct(state.alias("state"), done.alias("done"), F.concat(F.when(full, none).otherwise(acc["last"]), F.array(state)).alias("last"))

    return F.aggregate(values, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["last"]))


def evenly(total, n: int) -> Column:
    """Indexes of ``n`` items in the middle of equal parts; all if there are no more."""
    step = F.try_divide(col(total).cast("double"), F.lit(float(n)))
    return F.when(col(total) <= n, numbered(total)).otherwise(F.array_distinct(F.transform(numbered(F.lit(n)), lambda i: F.floor(step * i + step / 2).cast("int"))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b, epsilon: float = 1e-8) -> Column:
    """Cosine of two vectors, whose norms are made larger by ``epsilon``; null if lengths differ or are 0."""
    value = dot(a, b) / ((F.sqrt(dot(a, a)) + epsilon) * (F.sqrt(dot(b, b)) + epsilon))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value)


def total(values) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def trimmed_pair(a, b) -> tuple[Column, Column, Column]:
    """Both series cut to the shorter, and a status."""
    n = F.least(F.size(a), F.size(b))
    status = F.when(n <= 0, "empty").otherwise("ok")
    return F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), status


def top_named(names: list[str], errors: list, n: int) -> Column:
    """Names of the ``n`` largest errors that aren't null; ties in the order given."""
    rows = F.array(*[F.struct((-col(e)).alias("minus"), F.lit(i).alias("at"), F.lit(x).alias("name")) for i, (x, e) in enumerate(zip(names, errors, strict=True))])
    kept = F.array_sort(F.filter(rows, lambda r: r["minus"].isNotNull()))
    return F.transform(F.slice(kept, 1, n), lambda r: r["name"])
