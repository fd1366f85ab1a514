import pytest
from pyspark.sql import functions as F

from chunkwise.functions import text as T
from chunkwise.operators import evaluate, reports
from chunkwise.sources import discovery


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_chunk_folders_of_each_variant(spark):
    files = paths(spark, "r/a/chunk_2/slides/x.npy", "r/a/chunk_2/metadata.json", "r/a/cache/chunk_3/slides/y.npy", "r/b/cache/chunk_10/slides/z.npy", "r/c/deep/er/chunk_4/w", "r/chunk_9/x", "r/d/chunk_5", "r/e/chunk_6/audio.wav", "q/a/chunk_7/x")
    got = {v: {r["chunk_dir"]: r["chunk_number"] for r in discovery.chunk_folders(files, "r", v).collect()} for v in discovery.VARIANTS}
    assert got["deep"] == {"r/a/chunk_2": 2, "r/a/cache/chunk_3": 3, "r/b/cache/chunk_10": 10, "r/c/deep/er/chunk_4": 4, "r/e/chunk_6": 6}
    assert got["direct_else_cache"] == {"r/a/chunk_2": 2, "r/b/cache/chunk_10": 10, "r/e/chunk_6": 6}
    assert got["both_with_slides"] == {"r/a/chunk_2": 2, "r/a/cache/chunk_3": 3, "r/b/cache/chunk_10": 10}
    with pytest.raises(ValueError):
        discovery.chunk_folders(files, "r", "other")


def test_paths_and_layouts(spark):
    assert discovery.pipeline_paths("infer", "/p")["interim_dir"] == "/p/data/interim/infer"
    with pytest.raises(ValueError):
        discovery.pipeline_paths("train", "/p")
    files = paths(spark, "raw/x.mp4", "raw/train/a.mp4", "raw/roop/b.mp4", "raw/roop/more/c.mp4", None)
    groups = lambda df, mode: {r["path"]: r["layout_group"] for r in discovery.layout_groups(df, "raw", mode).collect()}
    assert groups(files, "genuine") == {"raw/train/a.mp4": "train"}
    assert groups(files, "infer") == {"raw/train/a.mp4": "train", "raw/roop/b.mp4": "roop"}
    assert groups(files.where("path = 'raw/x.mp4'"), "infer") == {"raw/x.mp4": None} and groups(files.limit(0), "infer") == {}


def test_slide_pairs_keep_the_first_longest_run(spark):
    names = [f"s/slide_{i:03d}_{k}.npy" for i in (1, 2, 5, 6, 9) for k in ("faces", "landmarks")] + ["s/slide_003_faces.npy", "s/other.npy"]
    assert sorted(r["slide_idx"] for r in discovery.slide_pairs(paths(spark, *names)).collect()) == [1, 2]


def test_reports_are_patched_in_new_versions(spark):
    kind = "video_id string, chunk_id string, status string, part double"
    report = spark.createDataFrame([("v", "a", "visual_only", None), ("v", "b", "visual_only", 1.0), ("w", "a", "visual_only", None), ("x", "a", reports.DONE, 7.0)], kind)
    patch = spark.createDataFrame([("v", "a", True, 2.0), ("v", "z", True, 3.0), ("x", "a", True, 9.0), ("w", "a", False, 4.0)], "video_id string, chunk_id string, ok boolean, part double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(reports.patched(report, patch.where("ok"), "part")) == [("v", "a", "fully_analyzed", 2.0), ("v", "b", "fully_analyzed", 1.0), ("w", "a", "visual_only", None), ("x", "a", "fully_analyzed", 9.0)]
    assert rows(reports.with_audio(report, patch, "part").fillna(-1.0)) == [("v", "a", reports.DONE, 2.0), ("v", "b", reports.DONE, -1.0), ("w", "a", reports.DONE, -1.0), ("x", "a", reports.DONE, 7.0)]


def test_contexts_without_a_baseline_have_the_value_only(spark):
    rows = spark.createDataFrame([("f", 3.0), ("f", None), ("g", 1.0)], "feature string, value double")
    base = spark.createDataFrame([("f", float(i)) for i in range(5)], "feature string, value double")
    got = {(r["feature"], r["value"]): r["entry"].asDict() for r in reports.feature_contexts(rows, base).collect()}
    assert got["f", 3.0] == {"value": 3.0, "genuine_p50": 2.0, "genuine_p95": 3.8, "percentile_rank": 80, "signal": "ABOVE_NORMAL"}
    assert set(got["g", 1.0].values()) == {1.0, None} and set(got["f", None].values()) == {None}


def test_patterns(spark):
    names = ["a", "b", "c", "d"]
    rows = [*[p for p, _ in reports.PATTERNS], ("ELEVATED", "NORMAL", "NORMAL", "NORMAL")]
    got = [r[0] for r in spark.createDataFrame(rows, names).coalesce(1).select(reports.manipulation_type(names)).collect()]
    assert got == [*[n for _, n in reports.PATTERNS], "UNCERTAIN"]


def test_excluded_verdicts_are_counted(spark):
    kept, excluded = evaluate.with_evidence_only(spark.range(10), spark.range(3, 5), "id")
    assert kept.count() == 2 and excluded.first()["excluded"] == 8


@pytest.mark.parametrize(
    "digits,want",
    [("0", "zero"), ("007", "seven"), ("1000", "one thousand"), ("1005", "one thousand and five"), ("1000000000000105", "one quadrillion one hundred and five"), ("1" + "0" * 21, "one sextillion"), ("12" + "0" * 51, "twelve sexdecillion"), ("1" + "0" * 303, "one centillion"), ("9" * 307, "9" * 307)],
)
def test_numbers_of_any_length(spark, digits, want):
    got = spark.createDataFrame([(digits,)], "t string").select(T.number_words("t")).first()[0]
    assert got == want


def test_prompts_hold_the_evidence_of_their_chunks(spark):
    from chunkwise.plans import prompt

    kind = "video_id string, chunk_id string, start_sec double, end_sec double, score double, threshold double, level string, n_frames int, modalities_analyzed array<string>, modalities_missing array<string>"
    rows = spark.createDataFrame([("v", f"c{i}", i * 2.0, i * 2.0 + 4, float(i), 2.0, "high", 4, ["visual"], ["audio_visual"]) for i in range(3)], kind)
    entry = F.struct(F.lit(0.5).alias("value"), F.lit(0.1).alias("genuine_p50"), F.lit(0.2).alias("genuine_p95"), F.lit(97).alias("percentile_rank"), F.lit("FAR_ABOVE_NORMAL").alias("signal"))
    text = prompt.prompts(rows.withColumn("entries", F.create_map(F.lit("max_blur_flicker"), entry)), k=2).first()["prompt"]
    assert text.count("** CRITICAL **") == 2 and text.index("c2  |  Time: 4.0s-8.0s  |  Frames: 4 attached") < text.index("c1  |  Time: 2.0s-6.0s")
    assert "c0  |" not in text and text.count("Modalities ABSENT: audio_visual") == 2
