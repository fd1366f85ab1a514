"""Operators on hand-made rows, the model, sources and sinks, and streams."""

import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.operators import assemble, evaluate, features, model, retrieve, scale, score, segment, split
from chunkwise.operators.prefix import running_sums
from chunkwise.sources import readers, writers
from chunkwise.streaming import chunks as streams


@pytest.mark.parametrize("duration, n", [(0.5, 0), (1.0, 1), (2.9, 1), (3.0, 2), (5.0, 3 - 1 + 0), (9.99, 5), (0.0, 0)])
def test_sliding_chunks(spark, duration, n):
    got = segment.sliding_chunks(spark.createDataFrame([(duration,)], "d double"), "d").collect()
    want, start, i = [], 0.0, 0
    while start < duration:
        end = min(start + 4, duration)
        if end - start < 1:
            break
        want.append((i, start, end))
        start, i = start + 2, i + 1
    assert [(r["chunk_idx"], r["start_sec"], r["end_sec"]) for r in got] == want
    assert len(got) == n or duration == 5.0


def test_frames_in_chunks_match_the_chunks(spark):
    rows = [(t / 4, 9.9) for t in range(40)]
    df = spark.createDataFrame(rows, "t double, d double")
    got = sorted((r["t"], r["chunk_idx"]) for r in segment.chunks_containing(df, "t", F.col("d")).collect())
    spans = [(r["chunk_idx"], r["start_sec"], r["end_sec"]) for r in segment.sliding_chunks(df.limit(1), "d").collect()]
    assert got == sorted((t, i) for t, _ in rows for i, a, b in spans if a <= t and (t < b or t == b == 9.9))


def test_longest_run_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 1, 3, 4, 6, 6, None)], "k string, i int")
    assert tuple(segment.longest_run(df, "k", "i").first()) == ("a", 0, 1, 2)


def test_overlaps(spark):
    df = spark.createDataFrame([(1, 0.5, 3), (1, 0.5000000001, 1), (1, None, 0), (1, None, 0), (2, 0.5, 9)], "k int, s double, o int")
    assert sorted((r["k"], r["o"]) for r in segment.overlap_dedupe(df, ["k"], "s", "o").collect()) == [(1, 0), (1, 0), (1, 3), (2, 9)]


def test_features_of_short_series(spark):
    one = spark.createDataFrame([("v", 0, 2.0)], "k string, i int, x double")
    assert tuple(features.flicker(one, ["k"], ["i"], "x").first()) == ("v", 2.0, 0.0, 0.0)
    assert features.axis_sync(one, ["k"], "x", "x").first()["axis_sync"] == 0.0
    gate = features.quality_gate(one, ["k"], ["i"], "x").first()
    assert gate["quality_flags"] == "too_few_frames,low_visual_motion,mostly_static_frames" and gate["reason"].startswith("quality_gate_failed:")
    assert features.relative_jitter(one.withColumn("z", F.lit(0.0)), ["k"], ["i"], "z", "z").first()["jitter"] == 0.0


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (4.0, None)], "a double, b double")
    fitted = scale.scaler(df, ["a", "b"])
    got = fitted.first()
    assert got["a__center"] == 2.0 and got["a__scale"] == pytest.approx(np.percentile([1, 2, 4], 75) - np.percentile([1, 2, 4], 25)) and got["b__scale"] == 1.0
    out = [tuple(r) for r in scale.scaled(df, ["a", "b"], fitted).collect()]
    assert out[2][0] is None and out[3][1] is None and out[0][1] == 0.0
    filled = scale.scaled(df, ["a", "b"], fitted, fill=True).collect()
    assert filled[2]["a"] == 0.0 and filled[2]["a__seen"] is False
    assert scale.threshold(df.select((-F.col("a")).alias("s")), "s").first()["threshold"] == pytest.approx(-1 + 1e-8)


def test_running_sums_in_many_ranges(spark):
    rows = [(i % 17, 1 + i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "o int, n int").groupBy("o").agg(F.sum("n").alias("n"))
    want, total = {}, 0
    for o, n in sorted(df.collect()):
        want[o], total = total, total + n
    assert {r["o"]: r["before"] for r in running_sums(df, "o", {"before": "n"}, buckets=5).collect()} == want
    assert running_sums(df.limit(0), "o", {"before": "n"}).count() == 0


def test_auc(spark):
    random = np.random.default_rng(1)
    y, s = random.random(200) < 0.4, np.round(random.random(200), 1)
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(y, s)], "y boolean, s double")
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]]
    area = evaluate.auc(df, "y", "s").first()["auc"]
    assert area == pytest.approx(np.mean(pairs)) and evaluate.auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] == pytest.approx(1 - area)
    assert evaluate.auc(df.withColumn("s", F.lit(1.0)), "y", "s").first()["auc"] == 0.5
    assert evaluate.auc(df.where("y"), "y", "s").first()["auc"] == 0.0
    assert evaluate.auc(df.where("y").withColumn("g", F.lit("g")), "y", "s", ["g"], empty=0.5).first()["auc"] == 0.5
    best = evaluate.best_threshold(df, "y", "s").first()
    tries = []
    for t in sorted({*np.percentile(s, range(1, 100))}):
        p = s > t
        precision, recall = (p & y).sum() / max(1, p.sum()), (p & y).sum() / y.sum()
        tries.append((round(2 * precision * recall / max(precision + recall, 1e-12), 12), -t))
    assert (best["f1"], -best["threshold"]) == pytest.approx(max(tries))


def test_joins_and_rollups(spark):
    a = spark.createDataFrame([("v", 1, True, "x"), ("v", 2, False, "y")], "v string, c int, ok boolean, text string")
    b = spark.createDataFrame([("v", 2, True, "z"), ("w", 1, True, "q")], "v string, c int, ok boolean, text string")
    got = {(r["v"], r["c"]): r["reason"] for r in assemble.transcript_pairs(a, b, ["v", "c"]).collect()}
    assert got == {("v", 1): "missing_vsr_chunk", ("v", 2): "asr_not_ok", ("w", 1): "missing_asr_chunk"}
    status = spark.createDataFrame([("pending",), ("failed",), ("done",)], "s string")
    assert assemble.retried(status, "s").count() == 1 and assemble.retried(status, "s", failed_too=True).count() == 2


def test_top_chunks_and_packages(spark):
    rows = [("v", f"chunk_{i:04d}", 2.0 * i, 2.0 * i + 4, s, 2.0, "low") for i, s in enumerate([1.0, 3.0, 3.0, None, 2.0])] + [("w", "chunk_0000", 0.0, 4.0, None, 2.0, "low")]
    df = spark.createDataFrame(rows, "video_id string, chunk_id string, start_sec double, end_sec double, score double, threshold double, level string")
    top = [(r["chunk_id"], r["rank"]) for r in retrieve.top_chunks(df, k=2).where("video_id = 'v'").orderBy("rank").collect()]
    assert top == [("chunk_0001", 1), ("chunk_0002", 2)]
    assert [tuple(r) for r in retrieve.largest_chunk(df).collect()] == [("v", "chunk_0001", 3.0)]
    pack = {r["video_id"]: r for r in retrieve.packages(df, ["chunk_id", "score"], k=2).collect()}
    assert [c["chunk_id"] for c in pack["v"]["top_chunks"]] == ["chunk_0001", "chunk_0002"] and pack["v"]["video_summary"]["chunks_above_threshold"] == 3
    reports = {r["video_id"]: r for r in score.evidence_reports(df.where("video_id = 'v'"), df, ["score"]).collect()}
    assert reports["w"]["status"] == "no_valid_chunks" and len(reports["v"]["chunks"]) == 5


@pytest.mark.parametrize("sizes, ratio", [([5, 1, 3, 2], 0.3), ([4], 0.5), ([2, 2, 2], 0.9), ([1, 2], 0.0), ([0, 0], 0.5)])
def test_greedy_split(spark, sizes, ratio):
    rows = [(f"v{i}", n) for i, n in enumerate(sizes)]
    got = {r["v"]: r["subset"] for r in split.greedy_split(spark.createDataFrame(rows, "v string, n int"), "v", "n", ratio).collect()}
    total, val, held = sum(sizes), [], 0
    if ratio > 0 and len(rows) > 1 and total:
        for v, n in sorted(rows, key=lambda r: (r[1], r[0])):
            if held >= max(1, round(total * ratio)) or len(val) == len(rows) - 1:
                break
            val.append(v)
            held += n
    assert {v for v, s in got.items() if s == "val"} == set(val)


# the model


def test_slopes_against_differences():
    random = np.random.default_rng(0)
    m = model.Scorer(["a", "b"], ["c"], latent=3, hidden=(5, 4)).start(1)
    x = {"v": random.normal(size=(6, 2)), "a": random.normal(size=(6, 1))}
    mask = {"v": (random.random((6, 2)) < 0.8).astype(float), "a": (random.random((6, 1)) < 0.6).astype(float)}
    x = {k: x[k] * mask[k] for k in x}
    noise = random.normal(size=(6, 3))
    _, grads = m.loss(x, mask, noise)
    for net, values in grads.items():
        for name, g in values.items():
            at = tuple(int(random.integers(n)) for n in g.shape)
            w = m.nets[net].values[name]
            old, sides = w[at], []
            for d in (1e-6, -1e-6):
                w[at] = old + d
                sides.append(m.loss(x, mask, noise)[0])
            w[at] = old
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=1e-4, abs=1e-7), (net, name)


def test_erf():
    import math

    x = np.linspace(-7, 7, 4001)
    assert np.abs(model.erf(x) - [math.erf(v) for v in x]).max() < 1e-13


def test_scores_ignore_what_is_masked(spark, tmp_path):
    rows = [(i, float(i % 5), float(i % 3), float(i % 2), i % 4 > 0, True, i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, a__seen boolean, b__seen boolean, c__seen boolean")
    m = model.train(df, ["a", "b"], ["c"], epochs=3)
    first = {r["k"]: r for r in model.score_rows(df, m, ["k"]).collect()}
    assert all((r["audio_score"] is None) == (k % 3 == 0) and (r["a_error"] is None) == (k % 4 == 0) for k, r in first.items())
    for r in first.values():
        assert r["joint_score"] == pytest.approx(r["visual_score"] + (r["audio_score"] or 0) + r["kl_divergence"])
    model.save(m, str(tmp_path / "m.npz"))
    again = {r["k"]: r for r in model.score_rows(df, model.load(str(tmp_path / "m.npz")), ["k"]).collect()}
    assert first == again
    before = model.Scorer(["a", "b"], ["c"]).start(42).scores(*model._arrays(df.toPandas(), m))["joint_score"].mean()
    assert np.mean([r["joint_score"] for r in first.values()]) < before


def test_training_goes_over_all_rows(spark, monkeypatch):
    for name in ("PART_ROWS", "TRAIN_ROWS"):
        monkeypatch.setattr(model, name, 16, raising=False)
    rows = [(float(i), float(i % 3), float(i % 2), True, True, i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, a__seen boolean, b__seen boolean, c__seen boolean")
    used, loss = [], model.Scorer.loss
    monkeypatch.setattr(model.Scorer, "loss", lambda self, x, *args: (used.append(x["v"][:, 0]), loss(self, x, *args))[1])
    model.train(df, ["a", "b"], ["c"], epochs=2, batch=8)
    assert max(map(len, used)) <= 8 and sorted(np.concatenate(used)) == sorted([r[0] for r in rows] * 2)
    model.train(df, ["a", "b"], ["c"], epochs=2, val=df.limit(0))


def test_averaged_training(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(model, "AVERAGED_ROWS", 16)
    rows = [(1.0 if i < 40 else float(i), float(i % 3), float(i % 2), True, True, i % 3 > 0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, a__seen boolean, b__seen boolean, c__seen boolean")
    got = model.train_averaged(df, ["a", "b"], ["c"], epochs=1, batch=8)
    parts = [f.drop(columns="p") for _, f in model._dealt(df, df.columns).withColumn("p", F.spark_partition_id()).toPandas().groupby("p")]
    assert len(parts) == 4 and sum(map(len, parts)) == 60 and max(map(len, parts)) < 20  # equal rows are dealt out too
    sums = {}
    for p, frame in enumerate(parts):
        assert len(frame) > 8
        m = model.Scorer(["a", "b"], ["c"]).start(42)
        state = {k: {n: (0 * v, 0 * v) for n, v in net.values.items()} for k, net in m.nets.items()}
        x, mask = model._arrays(frame, m)
        random = np.random.default_rng([42, 0, p, 0])
        for step, some in enumerate(np.array_split(random.permutation(len(frame)), 2), 1):
            at = lambda d: {k: v[some] for k, v in d.items()}  # noqa: B023, E731
            model._step(m, state, m.loss(at(x), at(mask), random.standard_normal((len(some), m.latent)), 0.1, random)[1], step, 1e-3, 1e-4)
        for k, net in m.nets.items():
            for n, v in net.values.items():
                sums[k, n] = sums.get((k, n), 0) + v * len(frame) / 60
    assert all(np.allclose(got.nets[k].values[n], v) for (k, n), v in sums.items())

    monkeypatch.setattr(model, "_TASKS", 40)  # sums are added up by tasks first
    again = model.train_averaged(df, ["a", "b"], ["c"], epochs=1, batch=8)
    assert all(np.allclose(v, again.nets[k].values[n]) for k, net in got.nets.items() for n, v in net.values.items())

    more = model.train_averaged(df, ["a", "b"], ["c"], epochs=4, val=df.limit(20))
    mean = lambda m: m.scores(*model._arrays(df.limit(20).toPandas(), m))["joint_score"].mean()
    assert mean(more) < mean(model.Scorer(["a", "b"], ["c"]).start(42))
    assert all((more.nets[k].values[n] == v).all() for k, net in model.train_averaged(df, ["a", "b"], ["c"], epochs=4, val=df.limit(20)).nets.items() for n, v in net.values.items())
    first = model.Scorer(["a", "b"], ["c"]).start(42)
    assert (model.train_averaged(df.limit(0), ["a", "b"], ["c"]).nets["enc_v"].values["w0"] == first.nets["enc_v"].values["w0"]).all()


# sources and sinks


def report(video):
    chunk = {"visual_spatial": {"blur": {"max_blur_flicker": 1.5}, "eye_gaze": {"gaze_pose_sync_score": 0.25}}, "audio_visual_consistency": {}, "frames_analyzed": 9, "time_metadata": {"start_sec": 0.0, "end_sec": 4.0}}
    return {"video_metadata": {"video_id": video, "status": "fully_analyzed"}, "chunks": {"chunk_0000": chunk, "chunk_0002": chunk}}


def test_reports(spark, tmp_path):
    (tmp_path / "a_report.json").write_text(json.dumps(report("a"), indent=1))
    (tmp_path / "b_report.json").write_text(json.dumps(report(None), indent=1))
    (tmp_path / "c_report.json").write_text("{broken")
    rows = readers.report_features(readers.read_reports(spark, str(tmp_path))).collect()
    assert sorted((r["video_id"], r["chunk_id"]) for r in rows) == [(v, c) for v in "ab" for c in ("chunk_0000", "chunk_0002")]
    assert rows[0]["max_blur_flicker"] == 1.5 and rows[0]["gaze_anomaly"] == 0.75 and rows[0]["wer_score"] is None
    with pytest.raises(ValueError):
        readers.checked_mode("other")


def test_evidence_verdicts_and_manifest(spark, tmp_path):
    e, v, m = (tmp_path / x for x in "evm")
    for p in (e, v):
        p.mkdir()
    evidence = {"video_metadata": {"video_id": "a", "status": "analyzed"}, "chunks": {"chunk_0000": {"anomaly": {"joint_anomaly_score": 2.5, "threshold": 1.0, "level": "high"}}}}
    (e / "a_evidence.json").write_text(json.dumps(evidence, indent=1))
    (e / "b_evidence.json").write_text(json.dumps({"video_metadata": {"status": "no_valid_chunks"}, "chunks": {}}))
    (e / "c.json").write_text("nothing")
    assert [tuple(r) for r in readers.read_evidence(spark, str(e)).collect()] == [("a", "chunk_0000", 2.5, 1.0, "high")]
    (v / "a.json").write_text(json.dumps({"video_id": "a", "backend": "rules", "verdict": {"label": "FAKE", "video_fake": True}}))
    (v / "b.json").write_text(json.dumps({"video_id": "b", "verdict": None}))
    [got] = readers.read_verdicts(spark, str(v)).collect()
    assert got["video_id"] == "a" and got["label"] == "FAKE" and got["video_fake"] is True
    rows = spark.createDataFrame([("p", "x/a.mp4", "true"), ("p", "y/a.mp4", " False "), ("p", None, "true")], "video_path string, local_path string, video_fake string").coalesce(1)
    writers.write_manifest(rows, str(m))
    [row] = readers.read_manifest(spark, str(m)).collect()
    assert row["video_id"] == "a" and row["local_path"] == "y/a.mp4" and row["video_fake"] is False and row["status"] == "pending"


def test_arrays_and_recordings(spark, tmp_path):
    np.save(tmp_path / "good.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.array([[32767, -32767], [32767, 32767]], "<i2").tobytes())
    found = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_arrays(spark, str(tmp_path)).collect()}
    assert found["good.npy"]["shape"] == [2, 3] and found["good.npy"]["values"] == [0, 1, 2, 3, 4, 5] and found["bad.npy"]["error"]
    [wav] = readers.read_waves(spark, str(tmp_path)).collect()
    assert wav["rate"] == 16000 and wav["samples"][0] == 0 and wav["samples"][1] == pytest.approx(32767 / 65534 * 2, abs=1e-3) or wav["samples"][1] > 0
    (tmp_path / "method").mkdir()
    (tmp_path / "method" / "x.MP4").write_bytes(b"1")
    [video] = readers.list_recordings(spark, str(tmp_path), recursive=True).collect()
    assert video["video_id"] == "x" and video["method"] == "method"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, m string")
    writers.write_table(df, str(tmp_path / "t"), ["m"])
    assert spark.read.parquet(str(tmp_path / "t")).where("m = 'a'").count() == 1
    writers.write_ids(df, str(tmp_path / "ids"), "id")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["1", "2"]
    writers.write_nested(df, str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n")).count() == 2
    assert writers.new_only(df, df.limit(1), ["id"]).count() == 1 and writers.new_only(df, None, ["id"]).count() == 2


def test_stream_chunks_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = events.schema
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_chunks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["user_id"], "value")
    query = streams.write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    got = {(r["user_id"], r["start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["user_id"], r["start"]): r["n"] for r in streams.stream_chunks(events, "ts", ["user_id"], "value").collect()}
    assert got and got.items() <= batch.items() and spec.STRIDE_SEC == 2.0


def test_exact_percentiles(spark):
    from chunkwise.operators.prefix import exact_percentiles

    random = np.random.default_rng(5)
    data = {"a": np.round(random.normal(size=301), 1), "b": random.random(7), "c": np.array([2.5])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: r for r in exact_percentiles(df, "v", shares, ["g"]).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert got[g]["n"] == len(vs) and got[g]["percentiles"] == pytest.approx(list(np.quantile(vs, shares)))
    [every] = exact_percentiles(df, "v", shares).collect()
    assert every["percentiles"] == pytest.approx(list(np.quantile(np.concatenate(list(data.values())), shares)))
    assert exact_percentiles(df.where("g = 'd'"), "v", shares).count() == 0


def test_percentiles_of_equal_neighbours_are_their_value(spark):
    """A weighted sum of two equal numbers may be rounded to another, and then rows with that score count as over the threshold."""
    from chunkwise.operators.prefix import exact_percentiles

    odd = next(v for v in (math.log(i) for i in range(2, 9999)) if (1 - 0.37) * v + 0.37 * v < v)
    rows = spark.createDataFrame([(odd,), (odd,)], "s double")
    assert exact_percentiles(rows, "s", [0.37]).first()["percentiles"] == [odd]


def test_order_statistics_in_many_parts(spark, monkeypatch):
    """Parts are cut again until they are small; infinities, NaN, outliers and equal values keep their places."""
    from chunkwise.operators import prefix

    random = np.random.default_rng(3)
    values = np.concatenate([random.normal(size=3000), random.normal(size=50) * 1e12, np.repeat(0.25, 900), [math.inf, -math.inf, math.nan, math.nan, 1e-300]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.0), ("c", None), (None, 1.0)], "g string, v double")
    monkeypatch.setattr(prefix, "_FEW", 20)
    got = prefix.values_at(df, "v", lambda n: range(0, n, 7), ["g"])
    assert {g for (g,) in got} == {"a", "b"}
    want = np.sort(values)
    assert got["a",][0] == len(values) and np.array_equal([got["a",][1][p] for p in range(0, len(values), 7)], want[::7], equal_nan=True)
    assert got["b",] == (1, {0: 2.0})


def test_running_sums_ask_their_sketch_once(spark):
    """Two runs of a sketch may differ, so ranges are cut at literal ends."""
    df = spark.createDataFrame([(float(i), 1) for i in range(50)], "o double, n int")
    assert "percentile_approx" not in running_sums(df, "o", {"before": "n"})._jdf.queryExecution().toString()
    assert "percentile_approx" not in running_sums(df.withColumn("g", F.lit(1)), "o", {"before": "n"}, by=["g"])._jdf.queryExecution().toString()


def test_ranks_need_no_shuffle_by_value(spark):
    """Ranks equal their definition, half to even, and rows meet only the few limits of their feature."""
    base = [1.0] * 3 + [2.0] * 5 + [3.5] * 1 + [7.0] * 191
    asked = [None, 0.0, 1.0, 1.5, 2.0, 3.0, 3.5, 6.9, 7.0, 8.0]
    rows = spark.createDataFrame([("f", v) for v in asked] + [("g", 1.0)], "feature string, value double")
    found = scale.ranks_in_baseline(rows, spark.createDataFrame([("f", v) for v in base], "feature string, value double"))
    got = {(r["feature"], r["value"]): r["percentile_rank"] for r in found.collect()}
    assert got == {("f", v): None if v is None else round(100.0 * sum(b <= v for b in base) / len(base)) for v in asked} | {("g", 1.0): 50}
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_gelu_and_a_step_in_one_go():
    """GELU and its slope by the grid equal their definition; a step of all arrays of a net at once equals AdamW one by one."""
    x = np.concatenate([np.random.default_rng(0).normal(size=2000) * 4, [-40.0, -9.0, 0.0, 8.9999, 9.0, 40.0]])
    cdf = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in x])
    y, slope = model.gelu(x)
    assert np.abs(y - x * cdf).max() < 1e-13 and np.abs(slope - cdf - x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)).max() < 1e-13
    m = model.Scorer(["a", "b"], ["c"]).start(1)
    before = {k: dict(net.values) for k, net in m.nets.items()}
    random = np.random.default_rng(2)
    state = {k: {n: (random.random(v.shape), random.random(v.shape)) for n, v in net.values.items()} for k, net in m.nets.items()}
    moments = {k: dict(s) for k, s in state.items()}
    grads = {k: {n: random.normal(size=v.shape) for n, v in net.values.items()} for k, net in m.nets.items()}
    model._step(m, state, grads, 3, 1e-3, 1e-4)
    for k, net in m.nets.items():
        for n, v in net.values.items():
            g, (a, b) = grads[k][n], moments[k][n]
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            assert np.allclose(v, before[k][n] * (1 - 1e-7) - 1e-3 * (a / (1 - 0.9**3)) / (np.sqrt(b / (1 - 0.999**3)) + 1e-8), rtol=1e-12)
            assert np.allclose(state[k][n][0], a) and np.allclose(state[k][n][1], b)
