"""Column functions: cleaning, classification, guarded statistics.  All are native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkwise import spec

Cols = "Column | str"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_number(x) -> Column:
    """A double; null for what isn't one, and for NaN and the infinities."""
    v = col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def transformed(x, kind: str) -> Column:
    if kind not in ("identity", "one_minus"):
        raise ValueError(f"unknown transform: {kind}")
    return F.lit(1.0) - col(x) if kind == "one_minus" else col(x)


def feature_columns(chunk: str = "chunk", features=spec.FEATURES) -> list[Column]:
    """The feature columns of a report's chunk, in the order of the specification."""
    return [transformed(clean_number(f"{chunk}.{path}"), kind).alias(name) for name, path, kind, _ in features]


def percentile_rank(value, ordered) -> Column:
    """Share of the baseline's values at or below ``value`` in whole percent, half to even; 50 without a baseline."""
    n = F.size(ordered)
    below = F.size(F.filter(ordered, lambda b: b <= col(value)))
    return F.when(n == 0, F.lit(50)).otherwise(F.bround(F.try_divide(F.lit(100.0) * below, n)).cast("int"))


def signal(rank) -> Column:
    out = None
    for op, bound, name in spec.SIGNALS:
        test = col(rank) >= bound if op == ">=" else col(rank) <= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("NORMAL")


def severity(feature, sig) -> Column:
    """CRITICAL, ELEVATED or NORMAL, by the direction in which the feature is suspicious."""
    low = col(feature).isin(spec.LOW_IS_SUSPICIOUS)
    far = F.when(low, col(sig) == "FAR_BELOW_NORMAL").otherwise(col(sig) == "FAR_ABOVE_NORMAL")
    some = F.when(low, col(sig) == "BELOW_NORMAL").otherwise(col(sig) == "ABOVE_NORMAL")
    return F.when(far, "CRITICAL").when(some, "ELEVATED").otherwise("NORMAL")


def normalized_score(joint, threshold) -> Column:
    return F.least(F.lit(1.0), F.try_divide(col(joint), col(threshold) + F.lit(1e-12)))


def level(norm) -> Column:
    return F.when(col(norm) >= 1.0, "high").when(col(norm) >= 0.5, "medium").otherwise("low")


def temporal_pattern(n, first, last, duration) -> Column:
    """Where the chunks above the threshold lie, from their number and first and last position."""
    spread = F.try_divide(col(last) - col(first), col(duration))
    return (
        F.when((F.coalesce(col(n), F.lit(0)) == 0) | (F.coalesce(col(duration), F.lit(0.0)) <= 0), "NONE")
        .when(col(n) == 1, "ISOLATED")
        .when(spread >= 0.6, "SCATTERED")
        .when(spread <= 0.3, "CONCENTRATED")
        .otherwise("MIXED")
    )


def interpretation(features, lvl) -> Column:
    """A sentence for a level and an array of feature names."""
    names = F.create_map(*[F.lit(x) for kv in spec.LABELS.items() for x in kv])
    labels = F.array_join(F.transform(features, lambda f: F.coalesce(names[f], f)), ", ")
    head = F.create_map(*[F.lit(x) for kv in spec.LEVEL_TEXT.items() for x in kv])
    return F.when(F.size(features) == 0, spec.NO_FEATURE).otherwise(F.concat(head[col(lvl)], labels, F.lit(".")))


def guarded_corr(x, y) -> Column:
    """Pearson correlation of an aggregation; 0 where a side is constant."""
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1))
    x, y = both * col(x), both * col(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def truthy(x) -> Column:
    return F.coalesce(F.lower(F.trim(col(x))) == "true", F.lit(False))


def natural_number(name, pattern: str = r"(\d+)") -> Column:
    """The number in a name, 10**9 if there is none: the key of natural order."""
    return F.coalesce(F.regexp_extract(col(name), pattern, 1).try_cast("long"), F.lit(10**9))


def file_stem(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def fake_type(video_fake, audio_fake) -> Column:
    v, a = col(video_fake), col(audio_fake)
    return F.when(v & a, "both").when(v, "video_only").when(a, "audio_only").otherwise("real")


def method_bucket(method, is_fake) -> Column:
    """Generation method; a fake without one is fake in its audio only."""
    named = F.coalesce(F.nullif(F.trim(col(method)), F.lit("")), F.lit("real"))
    return F.when((named == "real") & col(is_fake), "real_video_audio_only_fake").otherwise(named)


def usage_bucket(split, label, open_set) -> Column:
    """genuine_train, genuine_val, eval_track1 (closed) or eval_track2 (open set); null for what isn't used."""
    real = F.lower(col(label)) == "real"
    return (
        F.when((col(split) == "train") & real, "genuine_train")
        .when((col(split) == "validation") & real, "genuine_val")
        .when((col(split) == "test") & truthy(open_set), "eval_track2")
        .when(col(split) == "test", "eval_track1")
    )


def usage_path(usage, method, path) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.when(col(usage).startswith("genuine"), F.concat_ws("/", col(usage), name)).otherwise(F.concat_ws("/", col(usage), F.coalesce(F.nullif(col(method), F.lit("")), F.lit("real")), name))


def failure_cascade(asr, vsr, asr_ok, vsr_ok) -> Column:
    """The first reason why a pair of transcripts can't be compared, or success."""
    return F.when(col(asr).isNull(), "missing_asr_chunk").when(col(vsr).isNull(), "missing_vsr_chunk").when(~F.coalesce(col(asr_ok), F.lit(False)), "asr_not_ok").when(~F.coalesce(col(vsr_ok), F.lit(False)), "vsr_not_ok").otherwise("success")


def infer_fps(*rates, slide_sec=None, default: float = spec.FPS) -> Column:
    """The first rate that is neither null nor 0, else one over the slide's length, else the default."""
    some = [F.nullif(col(r).cast("double"), F.lit(0.0)) for r in rates]
    if slide_sec is not None:
        some.append(F.try_divide(F.lit(1.0), col(slide_sec).cast("double")))
    return F.coalesce(*some, F.lit(default))


def time_span(pairs: list[tuple]) -> Column:
    """struct(start_sec, end_sec) of the first pair of which both parse; null if none does."""
    tries = []
    for a, b in pairs:
        x, y = clean_number(a), clean_number(b)
        tries.append(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("start_sec"), y.alias("end_sec"))))
    return reduce(lambda p, q: F.coalesce(p, q), tries)


def crop_half_size(width, height, eyes, least, most) -> Column:
    return F.bround(F.least(col(most), F.greatest(F.lit(0.95) * col(width), F.lit(1.9) * col(height), F.lit(0.33) * col(eyes), col(least)))).cast("int")


def iou(a: list, b: list) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) over their union."""
    a, b = [col(x) for x in a], [col(x) for x in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def landmarks_padded(points, n: int, dims: int = 2) -> Column:
    """Landmarks cut or filled with nulls to ``n`` points of ``dims`` coordinates."""
    row = F.array_repeat(F.lit(None).cast("double"), dims)
    return F.slice(F.concat(F.coalesce(points, F.array().cast("array<array<double>>")), F.array_repeat(row, n)), 1, n)
