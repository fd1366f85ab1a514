"""Queries over the driver's tables, each built from the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.functions import arrays as A
from chunkwise.functions import scalar as S
from chunkwise.functions import text as T
from chunkwise.operators import assemble, evaluate, features, reports, retrieve, scale, score, segment, split
from chunkwise.operators.prefix import exact_percentiles, fitted

from chunkwise.sources import discovery

from . import fixtures as X
from .prompt import prompts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# segmentation


@query
def chunk_sliding(spark, sf):
    return segment.sliding_chunks(X.durations(spark, sf), "duration").select("user_id", "chunk_idx", "chunk_id", "start_sec", "end_sec", "start_frame", "end_frame")


@query
def slide_tumbling(spark, sf):
    chunks = segment.sliding_chunks(X.durations(spark, sf), "duration")
    return segment.tumbling_slides(chunks).select("user_id", "slide_id", "slide_idx", "slide_start", "slide_end")


@query
def longest_run(spark, sf):
    return segment.longest_run(X.frames(spark, sf).withColumn("day", F.floor("t").cast("int")), "user_id", "day")


@query
def overlap_dedupe(spark, sf):
    timed = X.frames(spark, sf).withColumn("start_sec", F.when(F.col("event_type") != "click", F.floor("t") / F.lit(2.0)))
    return segment.overlap_dedupe(timed, ["user_id"], "start_sec", "event_id").select("user_id", "event_id", "start_sec")


@query
def paired_windows(spark, sf):
    n = X.frames(spark, sf).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    windows = n.select("user_id", F.posexplode(A.paired_windows("n", F.col("n") * 3, F.lit(25.0))).alias("window_idx", "w"))
    return windows.select("user_id", "window_idx", "w.frame_start", "w.mel_start")


@query
def refined_times(spark, sf):
    runs = segment.longest_run(X.frames(spark, sf).withColumn("slide", F.floor(F.col("t") * 2).cast("int")), "user_id", "slide")
    begin, end = segment.refined_times(F.lit(0.0), "run_start", F.col("run_length") * 12)
    return runs.select("user_id", begin.alias("start_sec"), end.alias("end_sec"), "run_length")


@query
def kept_chunks(spark, sf):
    rows = X.chunk_frames(spark, sf).withColumn("valid", F.col("value") > 50)
    return segment.kept_chunks(rows, ["user_id", "chunk_idx"], "valid")


@query
def slide_acceptance(spark, sf):
    rows = X.frames(spark, sf).select("user_id", F.floor("t").cast("int").alias("slide_idx"), (F.col("event_type") == "error").alias("fatal"), (F.col("value") > 20).alias("real"))
    return segment.slide_acceptance(rows, ["user_id", "slide_idx"], "fatal", "real", 0.5)


@query
def physical_slides(spark, sf):
    rows = X.frames(spark, sf).select("user_id", segment.physical_slide(F.col("event_id"), F.lit(29.0)).alias("slide_idx"))
    return rows.groupBy("user_id", "slide_idx").agg(F.count("*").alias("n_frames"))


@query
def resampled_series(spark, sf):
    series = X.frames(spark, sf).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return series.select("user_id", F.posexplode(A.resampled(F.col("v"), F.lit(30.0), F.lit(25.0))).alias("i", "value"))


@query
def even_samples(spark, sf):
    n = X.frames(spark, sf).groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("user_id", F.explode(A.evenly("n", spec.FRAMES_PER_CHUNK)).alias("frame_idx"))


@query
def smoothed_series(spark, sf):
    series = X.frames(spark, sf).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v")))), lambda x: x["v"]).alias("v"))
    return series.select("user_id", F.posexplode(A.smoothed(F.col("v"))).alias("i", "value")).withColumn("value", F.round("value", 6))


@query
def stacked_series(spark, sf):
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = vectors.select("vec_id", F.posexplode(A.stacked(F.col("v"), 5)).alias("row", "items"))
    return rows.select("vec_id", "row", F.size("items").alias("n"), F.round(A.total(F.col("items")), 5).alias("sum_items"))


@query
def time_spans(spark, sf):
    rows = X.frames(spark, sf).select("event_id", F.when(F.col("event_type") == "click", F.col("t").cast("string")).alias("a"), F.lit("x").alias("b"), "k", "value")
    span = S.time_span([("a", "b"), ("k", "value")])
    return rows.select("event_id", F.round(span["start_sec"], 6).alias("start_sec"), F.round(span["end_sec"], 6).alias("end_sec"))


@query
def inferred_fps(spark, sf):
    rows = X.frames(spark, sf).select("event_id", F.when(F.col("event_type") == "click", F.lit(0.0)).alias("fps"), F.when(F.col("value") > 80, F.lit(30.0)).alias("video_fps"), F.when(F.col("value") > 30, F.lit(0.5)).alias("slide_sec"))
    return rows.select("event_id", S.infer_fps("fps", "video_fps", slide_sec="slide_sec").alias("fps"))


# features


def _series(f: Callable[[DataFrame], DataFrame], *rounded: str):
    def run(spark, sf):
        return f(X.frames(spark, sf)).withColumns({c: F.round(c, 6) for c in rounded})

    return run


@query
def flicker_features(spark, sf):
    return _series(lambda x: features.flicker(x, ["user_id"], ["t", "event_id"], "value"), "mean_value", "max_flicker", "flicker_variance")(spark, sf)


@query
def asymmetry_features(spark, sf):
    return _series(lambda x: features.asymmetry(x, ["user_id"], ["t", "event_id"], "value", "k"), "mean_value", "max_flicker", "asymmetry_max")(spark, sf)


@query
def axis_corr(spark, sf):
    return _series(lambda x: features.axis_sync(x, ["user_id"], "value", "k"), "axis_sync")(spark, sf)


@query
def relative_jitter(spark, sf):
    return _series(lambda x: features.relative_jitter(x, ["user_id"], ["t", "event_id"], "value", "k"), "jitter", "shimmer")(spark, sf)


@query
def sync_summary(spark, sf):
    return _series(lambda x: features.sync_summary(x, ["user_id"], "value"), "sync_score", "score_std", "variance", "min_sync_score", "max_sync_score")(spark, sf)


@query
def quality_gate(spark, sf):
    rows = X.frames(spark, sf).withColumns({"day": F.floor("t").cast("int"), "value": F.floor(F.col("value") / 40)})
    out = features.quality_gate(rows, ["user_id", "day"], ["t", "event_id"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_frame_delta", "static_like_ratio")})


@query
def landmark_quality(spark, sf):
    rows = X.frames(spark, sf).select("user_id", F.floor("t").cast("int").alias("slide"), F.array("value", F.when(F.col("k") > 50, F.lit(float("nan"))).otherwise(F.col("k"))).alias("points"))
    return features.landmark_quality(rows, "user_id", "slide", "points").withColumn("broken_pct", F.round("broken_pct", 6))


@query
def coordinate_jitter(spark, sf):
    points = X.table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(4)])
    return features.coordinate_jitter(points, ["label"], [f"c{i}" for i in range(4)]).withColumn("jitter", F.round("jitter", 6))


def _cosines(spark, sf) -> DataFrame:
    v = X.table(spark, sf, "embeddings").select((F.col("vec_id") / 2).cast("long").alias("step"), F.col("vec_id") % 2 == 0, "label", "embedding").toDF("step", "audio", "label", "e")
    pairs = v.where("audio").select("step", "label", F.col("e").alias("a")).join(v.where("not audio").select("step", F.col("e").alias("b")), "step")
    return pairs.select("label", "step", A.cosine(F.col("a"), F.col("b")).alias("cosine"))


@query
def cosine_steps(spark, sf):
    return _cosines(spark, sf).withColumn("cosine", F.round("cosine", 5))


@query
def cosine_summary(spark, sf):
    out = features.step_summary(_cosines(spark, sf), ["label"], "cosine")
    return out.withColumns({c: F.round(c, 5) for c in ("mean_cosine", "min_cosine", "max_cosine", "third_percentile")})


# texts


@query
def text_normalize(spark, sf):
    return X.turns(spark, sf).select("conv_id", "turn", T.normalized("text").alias("norm"), T.squeezed("text").alias("squeezed"))


def _transcripts(spark, sf) -> DataFrame:
    c = X.turns(spark, sf)
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("chunk"), F.lit(True).alias("ok"), "text")
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("chunk"), (F.length("text") > 100).alias("ok"), "text")
    return assemble.transcript_pairs(user, reply, ["conv_id", "chunk"])


@query
def transcript_full_outer(spark, sf):
    return _transcripts(spark, sf).select("conv_id", "chunk", "reason", "ok", F.length("asr_text").alias("asr_chars"), F.length("vsr_text").alias("vsr_chars"))


def _error_rates(spark, sf) -> DataFrame:
    pairs = _transcripts(spark, sf).select("conv_id", "chunk", "ok", T.words_of(T.normalized("asr_text")).alias("ref"), T.words_of(T.normalized("vsr_text")).alias("hyp"))
    out = pairs.withColumn("edit_distance", T.word_distance(F.when(F.col("ok"), F.col("ref")), F.when(F.col("ok"), F.col("hyp"))))
    wer = F.when(F.col("ok"), T.error_rate(F.col("ref"), F.col("hyp"), "edit_distance"))
    return out.withColumn("wer", wer).select("conv_id", "chunk", "ok", F.size("ref").alias("ref_words"), F.size("hyp").alias("hyp_words"), "edit_distance", F.round("wer", 6).alias("wer"), F.when(F.col("wer").isNotNull(), F.round(1 - F.least(F.lit(1.0), "wer"), 6)).alias("ccfd_score"))


@query
def wer_pairs(spark, sf):
    return _error_rates(spark, sf)


@query
def wer_video_summary(spark, sf):
    out = assemble.content_summary(_error_rates(spark, sf), "conv_id", "chunk", "wer", "ccfd_score")
    return out.withColumns({c: F.round(c, 9) for c in ("mean_wer", "mean_score")})


@query
def repetition_collapse(spark, sf):
    rows = T.with_repetition_collapsed(X.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", "repeated", F.length("collapsed").alias("n_chars"))


@query
def tail_trim(spark, sf):
    return X.turns(spark, sf).select("conv_id", "turn", T.tail_trimmed("text").alias("text"))


@query
def lips_text(spark, sf):
    return X.turns(spark, sf).select("conv_id", "turn", T.lips_text(F.concat("text", F.lit(" <eos>"))).alias("text"))


@query
def natural_order(spark, sf):
    rows = X.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", S.natural_number("source", r"src(\d+)$").alias("number"), "n")


# assembly and resumption


@query
def report_assemble(spark, sf):
    part = lambda df, key, payload, ok: df.select(F.col(key).alias("k"), F.col(payload).cast("double").alias("payload"), ok.alias("ok"))
    orders = X.table(spark, sf, "orders")
    lines = X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    out = assemble.assembled_report(
        orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("video_id")),
        part(lines.where("q > 50"), "l_orderkey", "q", F.lit(True)),
        part(lines, "l_orderkey", "d", F.col("d") > 0.05),
        part(lines, "l_orderkey", "t", F.col("t") > 0.04),
        part(orders.where("o_orderstatus = 'F'"), "o_orderkey", "o_totalprice", F.lit(True)),
        ["k"],
    )
    return out.withColumns({c: F.round(c, 4) for c in ("content", "semantic", "sync", "audio")})


def _cache(spark, sf) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderpriority").startswith("1"), "input_audio_not_found").when(F.col("o_orderpriority").startswith("2"), "empty_audio_input").when(F.col("o_orderpriority").startswith("3"), "skipped_short").otherwise("decode_timeout")
    return X.table(spark, sf, "orders").where("o_totalprice > 20000").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("ok"), reason.alias("reason"))


@query
def resume_antijoin(spark, sf):
    work = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return assemble.to_run(work, _cache(spark, sf), ["o_orderkey"], ["input_audio_not_found", "empty_audio_input"])


@query
def stage_rollup(spark, sf):
    return assemble.stage_rollup(_cache(spark, sf), "o_custkey")


@query
def work_list(spark, sf):
    return assemble.work_list(X.table(spark, sf, "customer").select("c_custkey"), X.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], "input_audio_not_found")


@query
def read_back(spark, sf):
    expected = X.table(spark, sf, "orders").select("o_orderkey")
    return assemble.read_back(expected, _cache(spark, sf).select("o_orderkey", "reason"), ["o_orderkey"], F.col("reason") == "decode_timeout")


@query
def manifest_usage(spark, sf):
    o = X.table(spark, sf, "orders")
    row = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "test").otherwise("validation").alias("split"), F.when(F.col("o_orderpriority") < "3", "real").otherwise("fake").alias("label"), F.when(F.col("o_orderpriority").startswith("5"), " True ").otherwise("false").alias("open_set"), F.col("o_orderpriority").alias("method"))
    used = row.withColumn("usage", S.usage_bucket("split", "label", "open_set")).where("usage is not null")
    path = S.usage_path("usage", "method", F.concat(F.lit("english/x/"), F.col("o_orderkey"), F.lit(".mp4")))
    return used.select("o_orderkey", "usage", path.alias("path"), S.file_stem(path).alias("stem"))


@query
def set_ops(spark, sf):
    d, l = X.table(spark, sf, "documents").select("doc_id"), X.table(spark, sf, "labels").select("doc_id")
    tagged = [(assemble.ids_union(d, l), "union"), (assemble.ids_both(d, l), "both"), (assemble.ids_only(d, l), "only")]
    out = None
    for rows, name in tagged:
        one = rows.select(F.lit(name).alias("kind"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


# what is normal


@query
def feature_clean_masks(spark, sf):
    rows = X.measurements(spark, sf)
    rows = rows.withColumn("l_tax", S.clean_number(F.when(F.col("l_tax") > 0.07, F.lit(float("nan"))).otherwise(F.col("l_tax"))))
    rows = rows.withColumn("l_discount", S.transformed("l_discount", "one_minus"))
    out = scale.with_masks(rows, ["l_quantity", "l_extendedprice"], "visual")
    return scale.with_masks(out, ["l_discount", "l_tax"], "audio").drop("l_linestatus").withColumn("l_discount", F.round("l_discount", 6))


@query
def baseline_stats(spark, sf):
    out = scale.baseline(X.measurements(spark, sf).where("l_returnflag = 'N'"), X.FEATURES)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p5", "p25", "p50", "p75", "p95", "p99")})


def _scaled(spark, sf) -> DataFrame:
    rows = X.measurements(spark, sf)
    return scale.scaled(rows, X.FEATURES, scale.scaler(rows.where("l_returnflag = 'N'"), X.FEATURES), fill=True)


@query
def robust_scale(spark, sf):
    return _scaled(spark, sf).drop("l_linestatus", "l_returnflag").withColumns({c: F.round(c, 6) for c in X.FEATURES})


@query
def percentile_rank_signal(spark, sf):
    rows = X.measurements(spark, sf)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in X.FEATURES])
    asked = rows.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.inline(pairs))
    ranked = scale.ranks_in_baseline(asked, scale.observed(rows.where("l_returnflag = 'N'"), X.FEATURES)).where("value is not null")
    out = ranked.withColumn("signal", S.signal("percentile_rank"))
    name = F.when(F.col("feature") == "l_tax", F.lit(spec.LOW_IS_SUSPICIOUS[0])).otherwise(F.col("feature"))
    return out.withColumn("severity", S.severity(name, "signal")).select("l_orderkey", "l_linenumber", "feature", "percentile_rank", "signal", "severity")


def _scores(spark, sf) -> DataFrame:
    """Scores of a model that rebuilds zeros: errors are the scaled values; latent means are half of them."""
    rows = _scaled(spark, sf)
    seen = [f"{n}__seen" for n in X.FEATURES]
    rows = rows.withColumns({"visual_score": score.masked_mean_square(X.FEATURES[:2], seen[:2]), "audio_score": score.masked_mean_square(X.FEATURES[2:], seen[2:]), "audio_available": F.col(seen[2]) | F.col(seen[3])})
    mu, logvar = F.array(*[F.col(n) * 0.5 for n in X.FEATURES[:2]]), F.array(F.lit(-0.5), F.lit(0.25))
    rows = rows.withColumn("kl_divergence", score.kl_divergence(mu, logvar))
    return rows.withColumn("joint_score", score.joint_score("visual_score", "audio_score", "audio_available", "kl_divergence"))


@query
def masked_scores(spark, sf):
    return _scores(spark, sf).select("l_orderkey", "l_linenumber", "audio_available", *[F.round(c, 6).alias(c) for c in ("visual_score", "audio_score", "kl_divergence", "joint_score")])


@query
def poe_fusion(spark, sf):
    e = X.table(spark, sf, "embeddings")
    part = lambda a: F.transform(F.slice("embedding", a, 4), lambda x: x.cast("double"))
    rows = e.select("vec_id", part(1).alias("m1"), part(5).alias("v1"), part(9).alias("m2"), part(13).alias("v2"), (F.col("label") % 3 > 0).alias("has2"))
    mu, logvar = score.product_of_experts([F.col("m1"), F.col("m2")], [F.col("v1"), F.col("v2")], [F.lit(True), "has2"])
    out = rows.select("vec_id", F.posexplode(F.arrays_zip(mu.alias("mu"), logvar.alias("logvar"))).alias("i", "x"))
    return out.select("vec_id", "i", (F.round("x.mu", 4) + 0.0).alias("mu"), (F.round("x.logvar", 4) + 0.0).alias("logvar"))


@query
def threshold_calibration(spark, sf):
    out = scale.threshold(_scores(spark, sf).where("l_returnflag = 'N'"), "joint_score")
    return out.withColumns({c: F.round(c, 5) for c in ("threshold", "mean_score", "median_score", "max_score")})


def _levelled(spark, sf) -> DataFrame:
    rows = _scores(spark, sf)
    return score.with_levels(rows, "joint_score", scale.threshold(rows.where("l_returnflag = 'N'"), "joint_score"))


@query
def anomaly_levels(spark, sf):
    return _levelled(spark, sf).select("l_orderkey", "l_linenumber", F.round("normalized_score", 5).alias("normalized_score"), "level")


@query
def top_features(spark, sf):
    rows = _levelled(spark, sf)
    errors = {f"e_{n}": F.when(F.col(f"{n}__seen"), F.round(F.col(n) * F.col(n), 9)) for n in X.FEATURES}
    out = score.evidence(rows.withColumns(errors), X.FEATURES, list(errors), "level", 2)
    return out.select("l_orderkey", "l_linenumber", F.array_join("top_anomalous_features", ",").alias("top_features"), F.array_join("missing_features", ",").alias("missing_features"), "interpretation")


# retrieval


def _chunk_scores(spark, sf) -> DataFrame:
    """Chunks of users with flicker features, scored by the mean square of their scaled features, with the threshold."""
    flick = features.flicker(X.chunk_frames(spark, sf), ["user_id", "chunk_idx", "chunk_id", "start_sec", "end_sec"], ["t", "event_id"], "value")
    names = ["mean_value", "max_flicker", "flicker_variance"]
    flick.persist(StorageLevel.MEMORY_AND_DISK)  # while it is fitted: both fits read it several times
    ready = scale.scaled(flick, names, scale.scaler(flick, names), fill=True)
    rows = ready.withColumn("score", F.round(score.masked_mean_square(names, [f"{n}__seen" for n in names]), 6))
    limit = fitted(exact_percentiles(rows, "score", [0.95]).select(F.round(F.col("percentiles")[0], 6).alias("threshold")))
    flick.unpersist()
    return rows.join(F.broadcast(limit)).select("user_id", "chunk_id", "start_sec", "end_sec", "score", "threshold", S.level(S.normalized_score("score", "threshold")).alias("level"))


@query
def topk_chunks(spark, sf):
    chunks = _chunk_scores(spark, sf)
    pattern = retrieve.video_summary(chunks, "user_id").select("user_id", "temporal_pattern")
    return retrieve.top_chunks(chunks, "user_id").join(pattern, "user_id").select("user_id", "rank", "chunk_id", "score", "level", "temporal_pattern")


@query
def video_summary(spark, sf):
    return retrieve.video_summary(_chunk_scores(spark, sf), "user_id").withColumn("mean_score", F.round("mean_score", 4))


@query
def argmax_chunk(spark, sf):
    return retrieve.largest_chunk(_chunk_scores(spark, sf), "user_id")


@query
def branch_fusion(spark, sf):
    rows = X.frames(spark, sf).groupBy("user_id").agg(F.avg("value").alias("scfd"), F.avg("k").alias("tcfd"), F.avg(F.col("value") / 200).alias("ccfd"))
    out = score.branch_fusion(rows, ["scfd", "tcfd"], "ccfd")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("scfd_scaled", "tcfd_scaled", "fused")])


#: Measures of chunks under the names of the features that they stand for.
_MEASURED = {"max_blur_flicker": "max_flicker", "blur_flicker_variance": "flicker_variance", "blinking_variance": "mean_value"}


def _flickers(spark, sf) -> DataFrame:
    keys = ["user_id", "chunk_idx", "chunk_id", "start_sec", "end_sec"]
    return features.flicker(X.chunk_frames(spark, sf), keys, ["t", "event_id"], "value")


def _contexts(spark, sf) -> DataFrame:
    """(user_id, chunk_id, feature, value, entry): features of chunks against those of the users with even ids; a value of 0 is unobserved."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.nullif(F.col(c), F.lit(0.0)), 6).alias("value")) for n, c in _MEASURED.items()])
    rows = _flickers(spark, sf).select("user_id", "chunk_id", F.inline(pairs))
    return reports.feature_contexts(rows, rows.where("user_id % 2 = 0 and value is not null").select("feature", "value"))


@query
def feature_context(spark, sf):
    return _contexts(spark, sf).select("user_id", "chunk_id", "feature", "entry.*")


@query
def pattern_types(spark, sf):
    signals = _contexts(spark, sf).select("user_id", "feature", F.coalesce("entry.signal", F.lit("NORMAL")).alias("signal"))
    worst = reports.worst_severities(signals, ["user_id"])
    return worst.withColumn("manipulation_type", reports.manipulation_type([f"group_{i}" for i in range(1, 5)]))


@query
def evidence_prompt(spark, sf):
    chunks = _chunk_scores(spark, sf).withColumn("n_frames", F.lit(spec.FRAMES_PER_CHUNK))
    entries = _contexts(spark, sf).groupBy("user_id", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "entry"))).alias("entries"), F.max(F.col("value").isNotNull()).alias("seen"))
    analyzed, missing = reports.modalities(F.col("seen"), F.lit(False))
    rows = chunks.join(entries, ["user_id", "chunk_id"]).withColumns({"modalities_analyzed": analyzed, "modalities_missing": missing}).drop("seen")
    return prompts(rows.withColumnRenamed("user_id", "video_id").withColumn("video_id", F.col("video_id").cast("string")))


@query
def frame_groups(spark, sf):
    top = retrieve.top_chunks(_chunk_scores(spark, sf), "user_id", k=3)
    files = F.when(F.col("rank") != 2, F.transform(F.sequence(F.lit(0), F.col("rank")), lambda i: F.concat("chunk_id", F.lit("_frame_"), i.cast("string"), F.lit(".jpg"))))
    package = top.withColumn("frame_files", files).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "start_sec", "end_sec", "frame_files"))).alias("top"))
    groups = package.select("user_id", F.posexplode(reports.frame_groups(F.col("top"), F.concat(F.lit("packages/"), F.col("user_id")))).alias("i", "g"))
    return groups.select("user_id", "i", "g.label", F.array_join("g.paths", ",").alias("paths"))


# folders and reports


@query
def chunk_discovery(spark, sf):
    out = None
    for variant in discovery.VARIANTS:
        one = discovery.chunk_folders(X.slide_paths(spark, sf), X.ROOT, variant).select(F.lit(variant).alias("variant"), "video_id", "chunk_id", "chunk_dir", "chunk_number")
        out = one if out is None else out.unionByName(one)
    return out


@query
def slide_pairs(spark, sf):
    return discovery.slide_pairs(X.slide_paths(spark, sf)).select("slides_dir", "slide_id", "slide_idx", "faces_path", "landmarks_path")


@query
def discovered_pairs(spark, sf):
    return discovery.discovered_pairs(X.slide_paths(spark, sf), X.ROOT)


@query
def layout_router(spark, sf):
    c = X.table(spark, sf, "customer")
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "train/").when(F.col("c_mktsegment") == "MACHINERY", "val/").when(F.col("c_mktsegment") == "FURNITURE", "other/deep/").otherwise("")
    files = c.select("c_custkey", F.concat(F.lit("raw/"), folder, F.col("c_custkey"), F.lit(".mp4")).alias("path"))
    genuine = discovery.layout_groups(files, "raw", "genuine").withColumn("mode", F.lit("genuine"))
    nested = discovery.layout_groups(files, "raw", "infer").withColumn("mode", F.lit("infer"))
    flat = discovery.layout_groups(files.where(folder == ""), "raw", "infer").withColumn("mode", F.lit("flat"))
    return genuine.unionByName(nested).unionByName(flat).select("mode", "c_custkey", "layout_group")


@query
def chunk_videos(spark, sf):
    orders = X.table(spark, sf, "orders").select(F.format_string("v%d", "o_custkey").alias("video_id"), F.format_string("chunk_%04d", F.col("o_orderkey") % 40).alias("chunk_id"), "o_orderstatus")
    files = orders.where("o_orderstatus = 'F'").select(F.concat_ws("/", F.lit(X.ROOT), "video_id", "chunk_id", F.lit("video.mp4")).alias("path")).distinct()
    return discovery.with_video_file(orders.select("video_id", "chunk_id").distinct(), files, X.ROOT)


@query
def slide_metadata(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    spans = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("start_sec"), (F.col("l_quantity") + 0.5).alias("end_sec"))))
    chunks = lines.where("l_discount > 0.02").groupBy(F.col("l_orderkey").alias("chunk_dir")).agg(spans.alias("slides"))
    slides = lines.select(F.col("l_orderkey").alias("chunk_dir"), (F.col("l_linenumber") - 1).cast("int").alias("slide_idx"))
    return discovery.slide_records(slides, chunks)


@query
def recording_fps(spark, sf):
    chunks = X.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 30 + 1).alias("fps"))
    return discovery.recording_fps(chunks, "o_custkey", ["o_orderkey"])


def _report(spark, sf) -> DataFrame:
    status = F.when(F.col("o_custkey") % 4 == 0, reports.DONE).otherwise("visual_only")
    return X.table(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("chunk_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("payload"))


def _patch(spark, sf) -> DataFrame:
    return X.table(spark, sf, "orders").where("o_orderpriority < '3'").select(F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 1000000000).otherwise(0)).alias("chunk_id"), (F.col("o_orderstatus") != "F").alias("ok"), (-F.col("o_totalprice")).alias("payload"))


@query
def report_patch(spark, sf):
    return reports.patched(_report(spark, sf), _patch(spark, sf), "payload")


@query
def report_audio(spark, sf):
    return reports.with_audio(_report(spark, sf), _patch(spark, sf), "payload")


@query
def sync_video_summary(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "skipped").otherwise("ok")
    rows = X.table(spark, sf, "events").select("user_id", "event_id", status.alias("status"), F.when(F.col("value") < 80, F.floor("value")).alias("score"))
    out = reports.sync_video_summary(rows, "user_id", "event_id", "status", "score")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "std_score")})


@query
def long_chunks(spark, sf):
    sizes = X.frames(spark, sf).groupBy("user_id", F.floor("t").cast("int").alias("chunk")).agg(F.count("*").alias("n"), F.lit(2.0).alias("fps"))
    kept = reports.long_enough(sizes, "n", "fps").select("user_id", "chunk", F.lit("at least").alias("rule"))
    return kept.unionByName(reports.long_enough(sizes, "n", "fps", strict=True).select("user_id", "chunk", F.lit("more").alias("rule")))


@query
def first_chunks(spark, sf):
    return reports.first_rows(X.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 25)


# evaluation


def _judged(spark, sf) -> DataFrame:
    return X.labelled(spark, sf).withColumn("predicted", F.col("score") > 7.0)


@query
def confusion_metrics(spark, sf):
    return evaluate.binary_metrics(_judged(spark, sf), "fake", "predicted")


@query
def auc_roc(spark, sf):
    return evaluate.auc(_judged(spark, sf), "fake", "score").withColumn("auc", F.round("auc", 9))


@query
def best_threshold(spark, sf):
    return evaluate.best_threshold(_judged(spark, sf), "fake", "score").select(*[F.round(c, 6).alias(c) for c in ("threshold", "f1")], "tp", "fp")


@query
def score_by_type(spark, sf):
    rows = X.labelled(spark, sf).withColumn("fake_type", S.fake_type("fake", "toxic"))
    return evaluate.score_stats(rows, "fake_type", "score", 7.0).withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "pct_above")})


@query
def score_by_method(spark, sf):
    rows = X.labelled(spark, sf).withColumn("method", S.method_bucket(F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), "fake"))
    return evaluate.score_stats(rows, "method", "score", 7.0, spread=True).withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "pct_above", "min", "max")})


@query
def score_distribution(spark, sf):
    return evaluate.score_distribution(X.labelled(spark, sf), "fake", "score").withColumns({c: F.round(c, 6) for c in ("mean", "median", "std", "tail")})


@query
def label_coverage(spark, sf):
    return evaluate.label_coverage(X.table(spark, sf, "labels"), X.table(spark, sf, "documents"), "doc_id")


@query
def per_feature_auc(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("chars"), F.size(F.split("text", " ")).cast("double").alias("blinking_variance"), F.when(F.col("source") < "src15", F.size(F.split("text", "\n")).cast("double")).alias("lines"))
    rows = docs.join(X.labelled(spark, sf), "doc_id")
    out = evaluate.feature_report(rows, ["chars", "blinking_variance", "lines"], "fake", spec.LOW_IS_SUSPICIOUS, least=20)
    return out.withColumns({c: F.round(c, 6) for c in ("auc", "median_real", "median_fake", "mean_real", "mean_fake")})


def _verdicts(spark, sf) -> DataFrame:
    """Model answers made from labelled rows: some not JSON, some fenced, some without a verdict."""
    rows = X.labelled(spark, sf)
    label = F.when(F.col("score") > 7.5, "FAKE").when(F.col("score") < 6, "UNCERTAIN").otherwise("GENUINE")
    body = F.concat(F.lit('{"video_fake": '), (F.col("score") > 7.5).cast("string"), F.lit(', "audio_fake": '), F.col("toxic").cast("string"), F.lit(', "label": "'), label, F.lit('"'), F.when(F.col("lang") != "en", F.lit(', "confidence": "HIGH"')).otherwise(""), F.lit("}"))
    body = F.when(F.col("source") == "src1", "not json").when(F.col("source") == "src2", "[1, 2]").when(F.col("source") == "src3", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    answer = F.when(F.col("source") == "src4", "no verdict").otherwise(F.concat(F.lit("<think>looked at "), F.col("doc_id"), F.lit("</think>\n<verdict>\n"), body, F.lit("\n</verdict><|im_end|>")))
    parsed = rows.withColumn("parsed", T.parsed_verdict(answer)).where("parsed.verdict is not null")
    return parsed.select("doc_id", "fake", "toxic", "parsed.reasoning", "parsed.verdict.*")


@query
def verdict_parse(spark, sf):
    return _verdicts(spark, sf).select("doc_id", "reasoning", "video_fake", "audio_fake", "label", "confidence")


@query
def verdict_metrics(spark, sf):
    rows = _verdicts(spark, sf)
    tasks = {"overall": (F.col("fake") | F.col("toxic"), F.col("label") == "FAKE"), "video": (F.col("fake"), F.col("video_fake")), "audio": (F.col("toxic"), F.col("audio_fake"))}
    return evaluate.verdict_metrics(rows, tasks)


@query
def verdict_breakdown(spark, sf):
    rows = _verdicts(spark, sf).join(X.labelled(spark, sf).select("doc_id", "lang"), "doc_id")
    tasks = {"overall": (F.col("fake") | F.col("toxic"), F.col("label") == "FAKE"), "video": (F.col("fake"), F.col("video_fake")), "audio": (F.col("toxic"), F.col("audio_fake"))}
    groups = {"method": S.method_bucket(F.when(F.col("lang") != "en", F.col("lang")).otherwise(""), F.col("fake") | F.col("toxic")), "type": S.fake_type("fake", "toxic")}
    return evaluate.verdict_breakdown(rows, tasks, groups)


@query
def verdict_evidence(spark, sf):
    analysed = X.table(spark, sf, "documents").where("n_chars > 900").select("doc_id")
    kept, excluded = evaluate.with_evidence_only(_verdicts(spark, sf), analysed, "doc_id")
    return evaluate.histogram(kept, ["label"]).join(F.broadcast(excluded))


@query
def usage_counts(spark, sf):
    return manifest_usage(spark, sf).groupBy("usage").agg(F.count("*").alias("n"))


@query
def verdict_hist(spark, sf):
    return evaluate.histogram(_verdicts(spark, sf), ["label", "confidence"])


# splits


def _sizes(spark, sf) -> DataFrame:
    return X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.count("*").alias("n_chunks"))


@query
def greedy_split(spark, sf):
    return split.greedy_split(_sizes(spark, sf), "video_id", "n_chunks", 0.15)


@query
def manifest_split(spark, sf):
    manifest = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), "c_mktsegment")
    return split.manifest_split(_sizes(spark, sf), manifest, "video_id", "c_mktsegment", "BUILDING", "MACHINERY")


@query
def balance_select(spark, sf):
    ids = X.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("video_id"))
    return split.balance_select(_sizes(spark, sf), ids, "video_id", "n_chunks", 712)


@query
def round_robin(spark, sf):
    return split.round_robin(X.table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], 3)


# the model


@query
def mvae_scores(spark, sf):
    from chunkwise.operators.model import score_rows, train_averaged

    rows = X.measurements(spark, sf)
    ready = scale.scaled(rows, X.FEATURES, scale.scaler(rows.where("l_returnflag = 'N'"), X.FEATURES), fill=True)
    model = train_averaged(ready.where("l_returnflag = 'N'"), X.FEATURES[:2], X.FEATURES[2:])
    return score_rows(ready, model, ["l_orderkey", "l_linenumber"])
