"""Hand-computed and plainly recomputed values of the column functions."""

import json
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chunkwise import spec
from chunkwise.functions import arrays as A
from chunkwise.functions import scalar as S
from chunkwise.functions import text as T


def one(spark, expr, **values):
    df = spark.createDataFrame([Row(**values)]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [("1.5", 1.5), ("abc", None), ("NaN", None), ("Infinity", None), ("-Infinity", None), ("", None)])
def test_clean_number(spark, value, want):
    assert one(spark, S.clean_number("v"), v=value) == want


def test_transform_of_unknown_kind():
    with pytest.raises(ValueError):
        S.transformed(F.lit(1.0), "square")


def test_rank_and_signal(spark):
    base = F.array(*[F.lit(float(i)) for i in range(1, 9)])
    assert one(spark, S.percentile_rank(F.lit(1.0), base)) == 12  # 12.5 to even
    assert one(spark, S.percentile_rank(F.lit(1.0), F.array().cast("array<double>"))) == 50
    signals = {95: "FAR_ABOVE_NORMAL", 80: "ABOVE_NORMAL", 50: "NORMAL", 20: "BELOW_NORMAL", 5: "FAR_BELOW_NORMAL"}
    assert {r: one(spark, S.signal(F.lit(r))) for r in signals} == signals
    assert one(spark, S.severity(F.lit("blinking_variance"), F.lit("FAR_BELOW_NORMAL"))) == "CRITICAL"
    assert one(spark, S.severity(F.lit("blinking_variance"), F.lit("FAR_ABOVE_NORMAL"))) == "NORMAL"
    assert one(spark, S.severity(F.lit("wer_score"), F.lit("ABOVE_NORMAL"))) == "ELEVATED"


def test_level_at_the_threshold_is_medium(spark):
    assert one(spark, S.level(S.normalized_score(F.lit(1.0), F.lit(1.0)))) == "medium"
    assert one(spark, S.level(S.normalized_score(F.lit(2.0), F.lit(1.0)))) == "high"
    assert one(spark, S.level(S.normalized_score(F.lit(0.1), F.lit(1.0)))) == "low"


@pytest.mark.parametrize("n, a, b, d, want", [(0, None, None, 10.0, "NONE"), (2, 1.0, 2.0, 0.0, "NONE"), (1, 3.0, 3.0, 10.0, "ISOLATED"), (2, 0.0, 3.0, 10.0, "CONCENTRATED"), (2, 0.0, 6.0, 10.0, "SCATTERED"), (3, 0.0, 5.0, 10.0, "MIXED")])
def test_temporal_pattern(spark, n, a, b, d, want):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, S.temporal_pattern(F.lit(n), lit(a), lit(b), lit(d))) == want


def test_corr_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "x double, y double")
    assert df.agg(S.guarded_corr("x", "y")).first()[0] == 0.0
    assert abs(df.agg(S.guarded_corr("y", "y")).first()[0] - 1) < 1e-12


def test_small_helpers(spark):
    assert one(spark, S.natural_number(F.lit("chunk_0012"), r"chunk_(\d+)")) == 12
    assert one(spark, S.natural_number(F.lit("chunk"), r"chunk_(\d+)")) == 10**9
    assert one(spark, S.file_stem(F.lit("/a/b.c/video.x.mp4"))) == "video.x"
    assert one(spark, S.infer_fps(F.lit(0.0), F.lit(None), slide_sec=F.lit(0.5))) == 2.0
    assert one(spark, S.infer_fps(F.lit(None))) == 25.0
    assert one(spark, S.iou([F.lit(float(x)) for x in (0, 0, 2, 2)], [F.lit(float(x)) for x in (1, 1, 3, 3)])) == pytest.approx(1 / 7)
    assert one(spark, S.crop_half_size(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(5.0), F.lit(30.0))) == 30
    assert one(spark, S.interpretation(F.array().cast("array<string>"), F.lit("low"))) == spec.NO_FEATURE
    assert one(spark, S.interpretation(F.array(F.lit("wer_score")), F.lit("high"))).endswith("content mismatch between ASR and VSR transcripts.")
    assert len(one(spark, S.landmarks_padded(F.lit(None).cast("array<array<double>>"), 4))) == 4
    assert one(spark, S.usage_bucket(F.lit("test"), F.lit("fake"), F.lit("True"))) == "eval_track2"
    assert one(spark, S.usage_bucket(F.lit("train"), F.lit("fake"), F.lit("True"))) is None
    assert one(spark, S.failure_cascade(F.lit(1), F.lit(1), F.lit(True), F.lit(None).cast("boolean"))) == "vsr_not_ok"


# arrays


def test_windows_and_resampling(spark):
    got = [tuple(x) for x in one(spark, A.paired_windows(F.lit(10), F.lit(32), F.lit(25.0)))]
    assert got == [(v, int(80 * v / 25)) for v in range(0, min(10, 10) - 5 + 1) if int(80 * v / 25) + 16 <= 32]
    assert one(spark, A.paired_windows(F.lit(2), F.lit(2), F.lit(25.0))) == []
    series = F.array(*[F.lit(float(i)) for i in range(7)])
    n = max(1, round(7 / 30 * 25))
    assert one(spark, A.resampled(series, F.lit(30.0), F.lit(25.0))) == [float(min(round(i * 30 / 25), 6)) for i in range(n)]
    assert one(spark, A.stacked(series, 4)) == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 0.0]]
    assert one(spark, A.evenly(F.lit(10), 4)) == [int(10 / 4 * i + 10 / 8) for i in range(4)]
    assert one(spark, A.evenly(F.lit(3), 4)) == [0, 1, 2]
    assert one(spark, A.deltas(series)) == [1.0] * 6 and one(spark, A.deltas(F.array(F.lit(1.0)))) == []


def test_smoothing_keeps_its_state_over_nulls(spark):
    values = F.array(*[F.lit(x).cast("double") for x in (None, 1.0, None, 3.0)])
    assert one(spark, A.smoothed(values)) == pytest.approx([None, 1.0, 1.0, 0.65 * 1 + 0.35 * 3])


def test_cosine(spark):
    a, b = [F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3))]
    assert one(spark, A.cosine(a, b)) == pytest.approx(24 / 25, abs=1e-7)
    assert one(spark, A.cosine(a, F.array(F.lit(1.0)))) is None
    left, right, status = A.trimmed_pair(a, F.array().cast("array<double>"))
    assert one(spark, status) == "empty" and one(spark, left) == []


def test_top_names_keep_the_order_of_ties(spark):
    errors = [F.lit(x).cast("double") for x in (1.0, None, 2.0, 2.0)]
    assert one(spark, A.top_named(["a", "b", "c", "d"], errors, 3)) == ["c", "d", "a"]


# texts


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_word_errors(spark):
    random.seed(4)
    rows = [("", ""), ("", "a"), ("a", ""), ("a", "b c d")]
    rows += [(" ".join(random.choices("abcdefg", k=random.randint(0, 12))), " ".join(random.choices("abcdefg", k=random.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "r string, h string").select("r", "h", T.words_of("r").alias("a"), T.words_of("h").alias("b"))
    df = df.withColumn("d", T.word_distance(F.col("a"), F.col("b"))).withColumn("wer", T.error_rate(F.col("a"), F.col("b"), "d"))
    for r in df.collect():
        ref, hyp = r["r"].split(), r["h"].split()
        assert r["d"] == levenshtein(ref, hyp)
        assert r["wer"] == pytest.approx((0.0 if not hyp else 1.0) if not ref else r["d"] / len(ref))


def test_word_errors_of_very_many_words(spark):
    n = 46_000  # past the surrogates and the four-digit codes
    words = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), i.cast("string")))
    pairs = [(35_400, "new"), (n, "w45990")]
    df = spark.createDataFrame(pairs, "k int, b string").select("k", "b", F.slice(words, 1, F.col("k")).alias("a"))
    got = df.select("k", "b", T.word_distance(F.col("a"), F.array("b")).alias("d")).collect()
    assert [(r["k"], r["b"], r["d"]) for r in got] == [(35_400, "new", 35_400), (n, "w45990", n - 1)]


def test_error_rates_of_the_tables(spark, sf_dir):
    from chunkwise.plans import queries as Q

    texts = Q._transcripts(spark, sf_dir).where("ok").select("conv_id", "chunk", T.normalized("asr_text").alias("a"), T.normalized("vsr_text").alias("b")).collect()
    got = {(r["conv_id"], r["chunk"]): r for r in Q.wer_pairs(spark, sf_dir).collect()}
    for r in texts:
        assert got[r["conv_id"], r["chunk"]]["edit_distance"] == levenshtein(r["a"].split(), r["b"].split())
    summary = {r["conv_id"]: r for r in Q.wer_video_summary(spark, sf_dir).collect()}
    for conv, s in summary.items():
        rates = sorted((k[1], r["wer"]) for k, r in got.items() if k[0] == conv and r["wer"] is not None)
        if rates:
            worst = max(w for _, w in rates)
            assert s["worst_chunk"] == min(c for c, w in rates if w == worst) and s["mean_wer"] == pytest.approx(sum(w for _, w in rates) / len(rates))


@pytest.mark.parametrize(
    "text, want",
    [("Um, it’s 3 o'clock, uh DON'T", "it is three o clock do not"), ("I'm 21; 1234 and 100 or 105", "i am twenty one one thousand two hundred and thirty four and one hundred or one hundred and five"), ("x2 1000001 0", "x one million and one zero"), (None, ""), ("  ", "")],
)
def test_normalized(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.normalized("t")).first()[0] == want


def collapsed(text):
    """A plain version of the repetition rule."""
    words = " ".join((text or "").split()).split(" ")
    if words == [""] or len(words) < 12:
        return " ".join(words), False
    for unit in range(min(24, len(words) // 3), 3, -1):
        n = 0
        while words[n * unit : (n + 1) * unit] == words[:unit]:
            n += 1
        if n >= 3 and n * unit / len(words) >= 0.75:
            kept = words[:unit]
            while kept and kept[-1].lower() in spec.TAIL_WORDS:
                kept.pop()
            return " ".join(kept), True
    return " ".join(words), False


def test_repetition(spark, sf_dir):
    random.seed(8)
    texts = ["a b c d " * 5, "we go to the " * 4 + "end", "a b c " * 9, "one two three four five", None, "", ("x y z w and " * 6)]
    texts += [" ".join(random.choices("ab", k=random.randint(10, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    for r in T.with_repetition_collapsed(docs, "text").collect():
        assert (r["collapsed"], r["repeated"]) == collapsed(re.sub(r"[ \t\n\x0b\f\r]+", " ", r["text"] or ""))


@pytest.mark.parametrize("first, retry, want", [(("a", False), (None, None), ("a", "none")), (("a", True), ("b", False), ("b", "retry")), (("a", True), ("b", True), ("b", "retry_collapsed")), (("a", True), ("", False), ("a", "collapsed"))])
def test_retry_choice(spark, first, retry, want):
    df = spark.createDataFrame([(first, retry)], "f struct<text: string, repeated: boolean>, r struct<text: string, repeated: boolean>")
    assert tuple(df.select(T.retry_choice("f", "r")).first()[0]) == want


@pytest.mark.parametrize(
    "text, label",
    [("none", None), ("<verdict>{bad</verdict>", None), ("<verdict>\n```json\n{\"label\": \"FAKE\"}\n```\n</verdict>", "FAKE"), ("<verdict>[1]</verdict>", None), (None, None), ("<think>\na\nb</think><verdict> {\"label\": \"GENUINE\", \"video_fake\": true}</verdict><|im_end|>", "GENUINE")],
)
def test_verdicts(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string").select(T.parsed_verdict("t").alias("p"))
    got = df.first()["p"]
    assert (got["verdict"] and got["verdict"]["label"]) == label
    if label == "GENUINE":
        assert got["reasoning"] == "a\nb" and got["verdict"]["video_fake"] is True and "im_end" not in got["raw_output"]


def test_series_of_events_are_smoothed_in_order(spark, sf_dir):
    from chunkwise.plans import fixtures, queries

    series = {}
    for r in sorted(fixtures.frames(spark, sf_dir).collect(), key=lambda r: (r["user_id"], r["t"], r["event_id"])):
        series.setdefault(r["user_id"], []).append(None if r["event_type"] == "error" else r["value"])
    got = {(r["user_id"], r["i"]): r["value"] for r in queries.smoothed_series(spark, sf_dir).collect()}
    for user, values in series.items():
        state = None
        for i, v in enumerate(values):
            state = v if state is None else state if v is None else 0.65 * state + 0.35 * v
            assert got[user, i] == (None if state is None else pytest.approx(state, abs=1e-6))


def test_prompts(spark):
    from chunkwise.plans import prompt, prompt_texts

    rows = [("v", "chunk_0001", 2.0, 6.0, 3.25, 2.0, "high"), ("v", "chunk_0000", 0.0, 4.0, 1.0, 2.0, "medium")]
    text = prompt.prompts(spark.createDataFrame(rows, "video_id string, chunk_id string, start_sec double, end_sec double, score double, threshold double, level string")).first()["prompt"]
    assert "Threshold    : 2.0000" in text and "  chunk_0001  [2.0s-6.0s]  score=3.2500  HIGH\n  chunk_0000  [0.0s-4.0s]  score=1.0000  MEDIUM\n\n  Temporal pattern: ISOLATED" in text
    assert text.endswith("</verdict>") and all(name in prompt_texts.system_prompt() for name, *_ in spec.FEATURES)
    entry = {"value": 0.5, "genuine_p50": 0.1, "percentile_rank": 99, "signal": "FAR_ABOVE_NORMAL"}
    chunk = {"chunk_id": "c", "start_sec": 0.0, "end_sec": 4.0, "n_frames": 2, "score": 1.5, "level": "low", "modalities_analyzed": ["visual"], "modalities_missing": ["audio"]}
    kind = "chunk struct<chunk_id: string, start_sec: double, end_sec: double, n_frames: int, score: double, level: string, modalities_analyzed: array<string>, modalities_missing: array<string>>"
    e = "struct<value: double, genuine_p50: double, percentile_rank: int, signal: string>"
    df = spark.createDataFrame([(chunk, entry, {**entry, "signal": "NORMAL"})], f"{kind}, a {e}, b {e}")
    block = df.select(prompt.block_b(F.col("chunk"), lambda n: {"max_blur_flicker": F.col("a"), "wer_score": F.col("b")}.get(n))).first()[0]
    assert "  max_blur_flicker             0.5000  genP50=  0.1000  pct= 99  ** CRITICAL **" in block
    assert "GROUP 3 — AUDIO-VISUAL COHERENCE\n  [NORMAL] wer_score" in block and "Modalities ABSENT: audio" in block
    answers = prompt.answered(spark.createDataFrame([("** CRITICAL **" * 3,), ("fine",)], "prompt string")).select(T.parsed_verdict("answer")["verdict"]["label"]).collect()
    assert [r[0] for r in answers] == ["FAKE", "GENUINE"]
    with pytest.raises(ValueError):
        prompt.answered(df, "no such backend")


def test_constants_are_whole():
    assert len(spec.FEATURES) == 21 and len(spec.VISUAL) == 13 and len(spec.CONTRACTIONS) == 43 and set(spec.LABELS) == {n for n, *_ in spec.FEATURES}
    assert sorted(n for g in spec.GLOSSARY.values() for n in g) == sorted(spec.LABELS) and json.dumps(spec.GLOSSARY) and math.isclose(spec.BETA, 1.0)
