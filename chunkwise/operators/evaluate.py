"""Evaluation of scores and verdicts against labels.  Scores are counted by distinct value before any global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import exact_percentiles, fitted, running_sums


def confusion(truth, predicted) -> list[Column]:
    """tp, tn, fp and fn of boolean columns, as aggregates."""
    t, p = F.col(truth), F.col(predicted)
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]


def rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """accuracy, precision, recall and f1 of tp, tn, fp, fn; 0 where a denominator is 0."""
    one = lambda c: F.greatest(F.lit(1), c)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    p, r = tp / one(tp + fp), tp / one(tp + fn)
    f1 = F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-12))
    return counts.withColumns({n: F.round(c, digits) for n, c in (("accuracy", (tp + tn) / one(tp + tn + fp + fn)), ("precision", p), ("recall", r), ("f1", f1))})


def binary_metrics(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return rates(rows.groupBy(*(by or [])).agg(*confusion(truth, predicted)))


def auc(rows: DataFrame, truth: str, score: str, by: list[str] | None = None, empty: float = 0.0) -> DataFrame:
    """Area under the ROC curve, ties counted half; ``empty`` if a class has no rows.  Per ``by`` if given."""
    by = by or []
    counts = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    below = running_sums(counts, score, {"below": "neg"}, by=by)
    out = below.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("__won"))
    value = F.coalesce(F.try_divide(F.col("__won"), F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(empty))
    return out.withColumn("auc", value).drop("__won")


def best_threshold(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """The percentile 1..99 of the scores with the best f1 when larger scores are positive; the least of equally good ones.

    The 99 thresholds are worked out first; a score falls between two of them, so the classes are counted for 100 ranges.
    """
    some = rows.where(F.col(score).isNotNull())
    grid = fitted(exact_percentiles(some, score, [i / 100 for i in range(1, 100)]).select(F.array_sort(F.array_distinct("percentiles")).alias("grid")))
    counts = some.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    # a score equal to a threshold is not over it
    under = counts.join(F.broadcast(grid)).groupBy(F.size(F.filter("grid", lambda t: t < F.col("s"))).alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    all_ = under.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"), F.collect_list(F.struct("i", "pos", "neg")).alias("ranges"))
    upto = lambda k, field: F.aggregate(F.filter("ranges", lambda r: r["i"] <= k), F.lit(0).cast("long"), lambda a, r: a + r[field])
    tries = all_.join(F.broadcast(grid)).select("np", "nn", "ranges", F.posexplode("grid").alias("k", "threshold")).withColumns({"fn": upto(F.col("k"), "pos"), "tn": upto(F.col("k"), "neg")})
    tried = rates(tries.select("threshold", (F.col("np") - F.col("fn")).alias("tp"), "tn", (F.col("nn") - F.col("tn")).alias("fp"), "fn"), digits=12)
    return tried.orderBy(F.desc("f1"), "threshold").limit(1)


def score_stats(rows: DataFrame, by: str, score: str, limit, spread: bool = False) -> DataFrame:
    """Per group: number, mean, median, population deviation, percent over the limit, and with ``spread`` least and largest."""
    over = F.avg((F.col(score) > limit).cast("double")) * 100
    more = [F.min(score).alias("min"), F.max(score).alias("max")] if spread else []
    stats = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), over.alias("pct_above"), *more)
    middle = exact_percentiles(rows, score, [0.5], [by]).select(by, F.col("percentiles")[0].alias("median"))
    return stats.join(middle, by, "left").select(by, "n", "mean", "median", "std", "pct_above", *(["min", "max"] if spread else []))


def score_distribution(rows: DataFrame, fake: str, score: str) -> DataFrame:
    """Real against fake: number, mean, median, deviation, and the 95th percentile of real or 5th of fake scores."""
    stats = rows.groupBy(fake).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    found = exact_percentiles(rows, score, [0.05, 0.5, 0.95], [fake]).select(fake, F.col("percentiles")[1].alias("median"), F.when(F.col(fake), F.col("percentiles")[0]).otherwise(F.col("percentiles")[2]).alias("tail"))
    return stats.join(found, fake, "left").select(fake, "n", "mean", "median", "std", "tail")


def label_coverage(labels: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """How many keys have both a label and a score, only a label, or only a score."""
    both = labels.select(key, F.lit(1).alias("l")).join(scores.select(key, F.lit(1).alias("s")), key, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("s").isNotNull()).alias("matched"), F.count_if(F.col("s").isNull()).alias("only_label"), F.count_if(F.col("l").isNull()).alias("only_score"))


def verdict_metrics(rows: DataFrame, tasks: dict[str, tuple[str, str]], label: str = "label") -> DataFrame:
    """Metrics of certain verdicts (FAKE or GENUINE) for each task, named by its (truth, predicted) columns."""
    certain = rows.where(F.col(label).isin("FAKE", "GENUINE"))
    pairs = F.array(*[F.struct(F.lit(n).alias("task"), F.coalesce(t, F.lit(False)).alias("truth"), F.coalesce(p, F.lit(False)).alias("predicted")) for n, (t, p) in tasks.items()])
    return binary_metrics(certain.select(F.inline(pairs)), "truth", "predicted", ["task"])


def verdict_breakdown(rows: DataFrame, tasks: dict[str, tuple], groups: dict[str, Column], label: str = "label") -> DataFrame:
    """``verdict_metrics`` of each task, and of the first task within each value of ``groups``: task, value (null for all), the metrics."""
    whole = [(n, F.lit(None).cast("string"), t, p) for n, (t, p) in tasks.items()]
    truth, predicted = next(iter(tasks.values()))
    every = whole + [(n, c, truth, predicted) for n, c in groups.items()]
    pairs = F.array(*[F.struct(F.lit(n).alias("task"), v.alias("value"), F.coalesce(t, F.lit(False)).alias("truth"), F.coalesce(p, F.lit(False)).alias("predicted")) for n, v, t, p in every])
    return binary_metrics(rows.where(F.col(label).isin("FAKE", "GENUINE")).select(F.inline(pairs)), "truth", "predicted", ["task", "value"])


def with_evidence_only(rows: DataFrame, analysed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Judged rows whose key was analysed, and one row with the number of those excluded."""
    keys = analysed.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti").agg(F.count("*").alias("excluded"))


def histogram(rows: DataFrame, values: list[str]) -> DataFrame:
    """(field, value, n), with UNKNOWN for what is missing."""
    pairs = F.array(*[F.struct(F.lit(v).alias("field"), F.coalesce(F.col(v).cast("string"), F.lit("UNKNOWN")).alias("value")) for v in values])
    return rows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def feature_report(rows: DataFrame, names: list[str], truth: str, low: list[str], least: int = 100) -> DataFrame:
    """For each feature: valid rows, status, AUC in its suspicious direction (0.5 if a class is empty), class medians and means."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    long = rows.select(F.col(truth).alias("truth"), F.inline(pairs)).where("value is not null")
    directed = long.withColumn("directed", F.when(F.col("feature").isin(low), -F.col("value")).otherwise(F.col("value")))
    real, fake = F.when(~F.col("truth"), F.col("value")), F.when(F.col("truth"), F.col("value"))
    stats = long.groupBy("feature").agg(F.count("*").alias("n_valid"), F.avg(real).alias("mean_real"), F.avg(fake).alias("mean_fake"))
    middle = exact_percentiles(long.where("truth is not null"), "value", [0.5], ["feature", "truth"])
    median = lambda t: F.max(F.when(F.col("truth") == t, F.col("percentiles")[0]))
    middle = middle.groupBy("feature").agg(median(False).alias("median_real"), median(True).alias("median_fake"))
    areas = auc(directed, "truth", "directed", ["feature"], empty=0.5).select("feature", "auc")
    out = stats.join(middle, "feature", "left").join(areas, "feature", "left").select("feature", "n_valid", "median_real", "median_fake", "mean_real", "mean_fake", "auc")
    status = F.when(F.col("n_valid") < least, "too_few_valid").otherwise("ok")
    return out.withColumns({"status": status, "auc": F.when(F.col("n_valid") >= least, F.col("auc"))})
