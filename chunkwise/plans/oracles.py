"""DuckDB SQL for the queries of ``queries``; those that SQL can't express, or only slowly, are left to the tests."""

from __future__ import annotations

from chunkwise import spec

FRAMES = """f AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 86400000000::DOUBLE AS t, value, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events),
d AS (SELECT user_id, max(t) AS duration FROM f GROUP BY user_id)"""
CHUNKS = (
    FRAMES
    + """, c AS (SELECT user_id, i AS chunk_idx, printf('chunk_%04d', i) AS chunk_id, duration, i * 2::DOUBLE AS s, least(i * 2::DOUBLE + 4, duration) AS e
  FROM (SELECT user_id, duration, unnest(range(0, floor(duration / 2)::BIGINT + 1)) AS i FROM d) WHERE i * 2::DOUBLE < duration AND least(i * 2::DOUBLE + 4, duration) - i * 2::DOUBLE >= 1)"""
)
CHUNK_FRAMES = CHUNKS + """, cf AS (SELECT f.*, c.chunk_idx, c.chunk_id, c.s AS start_sec, round(c.e, 6) AS end_sec FROM f JOIN c USING (user_id) WHERE c.s <= t AND t <= c.s + 4 AND (t < c.s + 4 OR t = duration))"""
LINES = """m AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)"""
NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_q = lambda n, p: f"quantile_cont({n}, {p})"
SCALER = "fit AS (SELECT " + ", ".join(f"{_q(n, 0.5)} AS {n}_c, CASE WHEN {_q(n, 0.75)} - {_q(n, 0.25)} >= 1e-8 THEN {_q(n, 0.75)} - {_q(n, 0.25)} ELSE 1 END AS {n}_s" for n in NAMES) + " FROM m WHERE l_returnflag = 'N')"
SCALED = f"{LINES}, {SCALER}, z AS (SELECT l_orderkey, l_linenumber, l_returnflag, " + ", ".join(f"coalesce(({n} - {n}_c) / {n}_s, 0) AS {n}, {n} IS NOT NULL AS {n}__seen" for n in NAMES) + " FROM m, fit)"


def _mse(names: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {n}__seen THEN {n} * {n} ELSE 0 END" for n in names) + ") / greatest(1, " + " + ".join(f"{n}__seen::INT" for n in names) + ")"


SCORES = (
    SCALED
    + f""", v AS (SELECT *, {_mse(NAMES[:2])} AS visual_score, {_mse(NAMES[2:])} AS audio_score, l_discount__seen OR l_tax__seen AS audio_available,
  -0.5::DOUBLE * ((1 - 0.5::DOUBLE - 0.25::DOUBLE * l_quantity * l_quantity - exp(-0.5::DOUBLE)) + (1 + 0.25::DOUBLE - 0.25::DOUBLE * l_extendedprice * l_extendedprice - exp(0.25::DOUBLE))) AS kl_divergence FROM z),
j AS (SELECT *, visual_score + CASE WHEN audio_available THEN audio_score ELSE 0 END + kl_divergence AS joint_score FROM v),
limits AS (SELECT CASE WHEN quantile_cont(joint_score, 0.95) > 0 THEN quantile_cont(joint_score, 0.95) ELSE max(joint_score) + 1e-8 END AS threshold, avg(joint_score) AS mean_score, quantile_cont(joint_score, 0.5) AS median_score, max(joint_score) AS max_score, count(joint_score) AS n FROM j WHERE l_returnflag = 'N')"""
)
LEVELS = SCORES + """, lv AS (SELECT j.*, least(1, joint_score / (threshold + 1e-12)) AS norm FROM j, limits)"""
LEVEL = "CASE WHEN norm >= 1 THEN 'high' WHEN norm >= 0.5 THEN 'medium' ELSE 'low' END"
_FLICK = ["mean_value", "max_flicker", "flicker_variance"]
CHUNK_SCORES = (
    CHUNK_FRAMES
    + """, dl AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id, chunk_idx ORDER BY t, event_id)) AS dd FROM cf),
fl AS (SELECT user_id, chunk_idx, chunk_id, start_sec, end_sec, coalesce(avg(value), 0) AS mean_value, coalesce(max(dd), 0) AS max_flicker, coalesce(var_pop(dd), 0) AS flicker_variance FROM dl GROUP BY ALL),
sc AS (SELECT """
    + ", ".join(f"{_q(n, 0.5)} AS {n}_c, CASE WHEN {_q(n, 0.75)} - {_q(n, 0.25)} >= 1e-8 THEN {_q(n, 0.75)} - {_q(n, 0.25)} ELSE 1 END AS {n}_s" for n in _FLICK)
    + " FROM fl), sv AS (SELECT user_id, chunk_id, start_sec, end_sec, round(("
    + " + ".join(f"(({n} - {n}_c) / {n}_s) * (({n} - {n}_c) / {n}_s)" for n in _FLICK)
    + ") / 3, 6) AS score FROM fl, sc), th AS (SELECT round(quantile_cont(score, 0.95), 6) AS threshold FROM sv), cs AS (SELECT sv.*, threshold, least(1, score / (threshold + 1e-12)) AS norm FROM sv, th)"
)
SUMMARY = (
    CHUNK_SCORES
    + """, vs AS (SELECT user_id, count(*) AS total_chunks, max(threshold) AS threshold, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count(*) FILTER (score >= threshold) AS chunks_above_threshold,
  max(end_sec) AS video_duration_sec, min(start_sec) FILTER (score >= threshold) AS a, max(start_sec) FILTER (score >= threshold) AS b FROM cs GROUP BY user_id),
vp AS (SELECT * EXCLUDE (a, b), CASE WHEN chunks_above_threshold = 0 OR video_duration_sec <= 0 THEN 'NONE' WHEN chunks_above_threshold = 1 THEN 'ISOLATED'
  WHEN (b - a) / video_duration_sec >= 0.6 THEN 'SCATTERED' WHEN (b - a) / video_duration_sec <= 0.3 THEN 'CONCENTRATED' ELSE 'MIXED' END AS temporal_pattern FROM vs)"""
)
JUDGED = """lb AS (SELECT doc_id, lang, source, quality = 0 AS fake, toxic = 1 AS toxic, round(ln(1 + n_chars), 6) AS score FROM documents JOIN labels USING (doc_id))"""
ORDERS = """cache AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS ok, CASE WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderpriority LIKE '1%' THEN 'input_audio_not_found' WHEN o_orderpriority LIKE '2%' THEN 'empty_audio_input' WHEN o_orderpriority LIKE '3%' THEN 'skipped_short' ELSE 'decode_timeout' END AS reason FROM orders WHERE o_totalprice > 20000)"""
SIZES = "sz AS (SELECT o_custkey AS video_id, count(*) AS n_chunks FROM orders GROUP BY 1)"
PAIRS = """u AS (SELECT conv_id, turn AS chunk, true AS ok, text FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS chunk, length(text) > 100 AS ok, text FROM conversations WHERE role = 'assistant')"""
VERDICTS = (
    JUDGED
    + r""", vb AS (SELECT *, '{"video_fake": ' || (score > 7.5)::VARCHAR || ', "audio_fake": ' || toxic::VARCHAR || ', "label": "' || CASE WHEN score > 7.5 THEN 'FAKE' WHEN score < 6 THEN 'UNCERTAIN' ELSE 'GENUINE' END || '"' || CASE WHEN lang <> 'en' THEN ', "confidence": "HIGH"' ELSE '' END || '}' AS body FROM lb),
vd AS (SELECT doc_id, fake, toxic, 'looked at ' || doc_id AS reasoning, (body->>'video_fake')::BOOLEAN AS video_fake, (body->>'audio_fake')::BOOLEAN AS audio_fake, body->>'label' AS label, body->>'confidence' AS confidence FROM vb WHERE source NOT IN ('src1', 'src2', 'src4'))"""
)
RATES = """round((tp + tn) / greatest(1, tp + tn + fp + fn), 4) AS accuracy, round(tp / greatest(1, tp + fp), 4) AS precision, round(tp / greatest(1, tp + fn), 4) AS recall,
  round(2::DOUBLE * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn), 1e-12), 4) AS f1"""
CONFUSION = "count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND NOT predicted) AS tn, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn"
_LONG = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_returnflag, '{n}' AS feature, {n}::DOUBLE AS value FROM m" for n in NAMES)


def _expanded(text: str) -> str:
    for word, meaning in sorted(spec.CONTRACTIONS.items()):
        pattern = word.replace("'", "''")
        text = f"regexp_replace({text}, '\\b{pattern}\\b', '{meaning}', 'g')"
    return text


def _words(text: str) -> str:
    """The words of a normalised text; the tables' texts have no digits."""
    fillers = ", ".join(f"'{w}'" for w in spec.FILLERS)
    lower = f"replace(lower(coalesce({text}, '')), '’', '''')"
    return "list_filter(regexp_split_to_array(regexp_replace(" + _expanded(lower) + r", '[^a-z\s]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('', " + fillers + "))"


def _tail_trimmed(text: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g')), '(?i)(^|\s+)((^|\s*)\b({'|'.join(spec.TAIL_WORDS)})\b)+$', ''))"


def _top(n: int) -> str:
    errors = [f"CASE WHEN {x}__seen THEN round({x} * {x}, 9) END" for x in NAMES]
    rows = ", ".join(f"{{'e': -({e}), 'at': {i}, 'name': '{x}'}}" for i, (x, e) in enumerate(zip(NAMES, errors, strict=True)))
    return f"list_transform(list_sort(list_filter([{rows}], lambda x: x.e IS NOT NULL))[1:{n}], lambda x: x.name)"


def _stats(by: str, spread: str = "") -> str:
    return f"SELECT {by}, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS std, round(avg((score > 7)::INT::DOUBLE) * 100, 6) AS pct_above{spread} FROM x GROUP BY {by}"


#: Edit distances by rows of the dynamic programme: a cell is its column plus the least so far of what comes from above, less the column.
ERROR_RATES = f"""WITH RECURSIVE {PAIRS},
p AS (SELECT conv_id, chunk, coalesce(u.text IS NOT NULL AND r.text IS NOT NULL AND u.ok AND r.ok, false) AS ok, {_words("u.text")} AS ref, {_words("r.text")} AS hyp FROM u FULL JOIN r USING (conv_id, chunk)),
dp AS (
  SELECT conv_id, chunk, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS cells FROM p WHERE ok
  UNION ALL
  SELECT conv_id, chunk, ref, hyp, i + 1, list_transform(range(0, len(hyp) + 1), lambda j: j + list_min(above[1:j + 1])) FROM (
    SELECT *, list_transform(range(0, len(hyp) + 1), lambda k: CASE WHEN k = 0 THEN cells[1] + 1 ELSE least(cells[k + 1] + 1, cells[k] + (hyp[k] <> ref[i + 1])::BIGINT) - k END) AS above FROM dp WHERE i < len(ref))),
e AS (SELECT p.conv_id, p.chunk, p.ok, len(p.ref)::INT AS ref_words, len(p.hyp)::INT AS hyp_words, dp.cells[len(p.hyp) + 1]::INT AS edit_distance FROM p LEFT JOIN dp ON dp.conv_id = p.conv_id AND dp.chunk = p.chunk AND dp.i = len(p.ref)),
w AS (SELECT *, CASE WHEN ok THEN CASE WHEN ref_words = 0 THEN (hyp_words > 0)::INT::DOUBLE ELSE edit_distance / ref_words::DOUBLE END END AS rate FROM e),
er AS (SELECT conv_id, chunk, ok, ref_words, hyp_words, edit_distance, round(rate, 6) AS wer, CASE WHEN ok THEN round(1 - least(1, rate), 6) END AS ccfd_score FROM w)"""

ORACLE: dict[str, str] = {
    "wer_pairs": ERROR_RATES + " SELECT * FROM er",
    "wer_video_summary": ERROR_RATES
    + """ SELECT conv_id, count(*) AS num_chunks, round(avg(wer), 9) AS mean_wer, quantile_cont(wer, 0.5) AS median_wer, round(avg(ccfd_score), 9) AS mean_score, quantile_cont(ccfd_score, 0.5) AS median_score,
  arg_max(chunk, (wer, -chunk)) FILTER (wer IS NOT NULL) AS worst_chunk, arg_min(chunk, (wer, chunk)) FILTER (wer IS NOT NULL) AS best_chunk FROM er GROUP BY 1""",
    "smoothed_series": f"""WITH RECURSIVE {FRAMES}, x AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM f),
s AS (SELECT user_id, i, v AS state FROM x WHERE i = 0
  UNION ALL SELECT x.user_id, x.i, CASE WHEN s.state IS NULL THEN x.v WHEN x.v IS NULL THEN s.state ELSE 0.65::DOUBLE * s.state + (1 - 0.65::DOUBLE) * x.v END FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
SELECT user_id, i::INT AS i, round(state, 6) AS value FROM s""",
    "repetition_collapse": rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents), w AS (SELECT doc_id, s, string_split(s, ' ') AS w FROM t),
u AS (SELECT *, CASE WHEN s <> '' THEN list_reverse(range(4, least(24, len(w) // 3) + 1)) ELSE []::BIGINT[] END AS units FROM w),
n AS (SELECT *, list_filter(units, lambda u: w[u + 1:2 * u] = w[1:u]) AS near FROM u),
r AS (SELECT *, list_transform(near, lambda u: {{'u': u, 'r': coalesce(list_filter(range(2, len(w) // u + 1), lambda k: w[(k - 1) * u + 1:k * u] <> w[1:u])[1] - 1, len(w) // u)}}) AS runs FROM n),
c AS (SELECT *, list_filter(runs, lambda x: x.r >= 3 AND x.r * x.u / len(w)::DOUBLE >= 0.75)[1].u AS unit FROM r)
SELECT doc_id, unit IS NOT NULL AS repeated, length(CASE WHEN unit IS NOT NULL THEN {_tail_trimmed("array_to_string(w[1:unit], ' ')")} ELSE s END)::INT AS n_chars FROM c""",
    "chunk_sliding": f"WITH {CHUNKS} SELECT user_id, chunk_idx::INT AS chunk_idx, chunk_id, round(s, 6) AS start_sec, round(e, 6) AS end_sec, round_even(s * 25, 0)::INT AS start_frame, round_even(e * 25, 0)::INT AS end_frame FROM c",
    "slide_tumbling": f"""WITH {CHUNKS}, r AS (SELECT user_id, chunk_id, round(s, 6) AS s, round(e, 6) AS e FROM c)
SELECT user_id, chunk_id || '_slide_' || printf('%03d', i) AS slide_id, i::INT AS slide_idx, round(s + i * 0.5::DOUBLE, 6) AS slide_start, round(least(s + i * 0.5::DOUBLE + 0.5, e), 6) AS slide_end
FROM (SELECT *, unnest(range(0, ceil((e - s) / 0.5)::BIGINT)) AS i FROM r)""",
    "longest_run": f"""WITH {FRAMES}, a AS (SELECT DISTINCT user_id, floor(t)::INT AS day FROM f), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM a),
r AS (SELECT user_id, min(day) AS run_start, max(day) AS run_end, count(*) AS run_length FROM i GROUP BY user_id, island)
SELECT user_id, run_start, run_end, run_length FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, run_start) = 1""",
    "overlap_dedupe": f"""WITH {FRAMES}, a AS (SELECT user_id, event_id, CASE WHEN event_type <> 'click' THEN floor(t) / 2 END AS start_sec FROM f)
SELECT * FROM a QUALIFY start_sec IS NULL OR row_number() OVER (PARTITION BY user_id, round(start_sec, 6) ORDER BY start_sec, event_id) = 1""",
    "paired_windows": f"""WITH {FRAMES}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1), w AS (SELECT user_id, n, unnest(range(0, greatest(0, least(n, floor(3 * n / 80::DOUBLE * 25)::BIGINT) - 5 + 1))) AS v FROM n)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY v) - 1)::INT AS window_idx, v::INT AS frame_start, floor(80::DOUBLE * v / 25)::INT AS mel_start FROM w WHERE floor(80::DOUBLE * v / 25) + 16 <= 3 * n""",
    "refined_times": f"""WITH {FRAMES}, a AS (SELECT DISTINCT user_id, floor(t * 2)::INT AS day FROM f), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM a),
r AS (SELECT user_id, min(day) AS run_start, count(*) AS run_length FROM i GROUP BY user_id, island), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_length DESC, run_start) = 1)
SELECT user_id, round(run_start * 0.5::DOUBLE, 3) AS start_sec, round(run_start * 0.5::DOUBLE + run_length * 12 / 25::DOUBLE, 3) AS end_sec, run_length FROM b""",
    "kept_chunks": f"WITH {CHUNK_FRAMES} SELECT user_id, chunk_idx::INT AS chunk_idx, count(*) FILTER (value > 50) AS n_valid FROM cf GROUP BY 1, 2 HAVING count(*) FILTER (value > 50) > 3",
    "slide_acceptance": f"""WITH {FRAMES} SELECT user_id, floor(t)::INT AS slide_idx, coalesce(bool_or(event_type = 'error'), false) AS any_fatal, count(*) FILTER (value > 20) AS n_real, count(*) AS n_frames,
  NOT coalesce(bool_or(event_type = 'error'), false) AND count(*) FILTER (value > 20) >= count(*) * 0.5::DOUBLE AS accepted FROM f GROUP BY 1, 2""",
    "physical_slides": "SELECT user_id, floor(event_id / 14::DOUBLE)::INT AS slide_idx, count(*) AS n_frames FROM events GROUP BY 1, 2",
    "resampled_series": f"""WITH {FRAMES}, l AS (SELECT user_id, list(value ORDER BY t, event_id, value) AS v FROM f GROUP BY 1), w AS (SELECT user_id, v, unnest(range(0, greatest(1, round_even(len(v) / 30::DOUBLE * 25, 0)::BIGINT))) AS i FROM l)
SELECT user_id, i::INT AS i, v[least(round_even(i * 30::DOUBLE / 25, 0)::BIGINT, len(v) - 1) + 1] AS value FROM w""",
    "even_samples": f"""WITH {FRAMES}, n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1)
SELECT DISTINCT user_id, CASE WHEN n <= 4 THEN i ELSE floor(n / 4::DOUBLE * i + n / 4::DOUBLE / 2) END::INT AS frame_idx FROM (SELECT user_id, n, unnest(range(0, least(4, n))) AS i FROM n)""",
    "stacked_series": """SELECT vec_id, floor((pos - 1) / 5)::INT AS "row", 5 AS n, round(sum(x::DOUBLE), 5) AS sum_items FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""",
    "time_spans": f"WITH {FRAMES} SELECT event_id, round(CASE WHEN k IS NOT NULL AND value IS NOT NULL THEN k END, 6) AS start_sec, round(CASE WHEN k IS NOT NULL AND value IS NOT NULL THEN value END, 6) AS end_sec FROM f",
    "inferred_fps": "SELECT event_id, CASE WHEN value > 80 THEN 30::DOUBLE WHEN value > 30 THEN 2::DOUBLE ELSE 25::DOUBLE END AS fps FROM events",
    "flicker_features": f"""WITH {FRAMES}, x AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS dd FROM f)
SELECT user_id, round(coalesce(avg(value), 0), 6) AS mean_value, round(coalesce(max(dd), 0), 6) AS max_flicker, round(coalesce(var_pop(dd), 0), 6) AS flicker_variance FROM x GROUP BY 1""",
    "asymmetry_features": f"""WITH {FRAMES}, x AS (SELECT *, greatest(abs(value - lag(value) OVER w), abs(k - lag(k) OVER w)) AS dd FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, round(avg((value + k) / 2), 6) AS mean_value, round(coalesce(max(dd), 0), 6) AS max_flicker, round(max(abs(value - k)), 6) AS asymmetry_max FROM x GROUP BY 1""",
    "axis_corr": f"""WITH {FRAMES} SELECT user_id, round(CASE WHEN count(*) < 10 OR count(*) FILTER (value IS NOT NULL AND k IS NOT NULL) < 2 THEN 0
  ELSE coalesce(abs(covar_pop(value, k) / nullif(stddev_pop(CASE WHEN k IS NOT NULL THEN value END) * stddev_pop(CASE WHEN value IS NOT NULL THEN k END), 0)), 0) END, 6) AS axis_sync, count(*) AS n_frames FROM f GROUP BY 1""",
    "relative_jitter": f"""WITH {FRAMES}, a AS (SELECT user_id, t, event_id, 1 / value AS v FROM f WHERE value > 0), b AS (SELECT user_id, t, event_id, k AS v FROM f WHERE k > 1e-4),
aj AS (SELECT user_id, avg(dd) / nullif(avg(v), 0) AS x FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS dd FROM a) GROUP BY 1),
bj AS (SELECT user_id, avg(dd) / nullif(avg(v), 0) AS x FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS dd FROM b) GROUP BY 1)
SELECT d.user_id, round(coalesce(aj.x, 0), 6) AS jitter, round(coalesce(bj.x, 0), 6) AS shimmer FROM d LEFT JOIN aj USING (user_id) LEFT JOIN bj USING (user_id)""",
    "sync_summary": "SELECT user_id, round(avg(value), 6) AS sync_score, round(stddev_pop(value), 6) AS score_std, round(pow(stddev_pop(value), 2), 6) AS variance, round(min(value), 6) AS min_sync_score, round(max(value), 6) AS max_sync_score, count(value) AS n_windows FROM events GROUP BY 1",
    "quality_gate": f"""WITH {FRAMES}, x AS (SELECT user_id, floor(t)::INT AS day, abs(floor(value / 40) - lag(floor(value / 40)) OVER (PARTITION BY user_id, floor(t)::INT ORDER BY t, event_id)) AS dd FROM f),
g AS (SELECT user_id, day, count(*) AS num_frames, coalesce(avg(dd), 0) AS m, coalesce(avg((dd < 0.75)::INT::DOUBLE), 1) AS s FROM x GROUP BY 1, 2),
h AS (SELECT *, array_to_string(list_filter([CASE WHEN num_frames < 4 THEN 'too_few_frames' END, CASE WHEN m < 0.75 THEN 'low_visual_motion' END, CASE WHEN s > 0.9 THEN 'mostly_static_frames' END], lambda y: y IS NOT NULL), ',') AS flags FROM g)
SELECT user_id, day, num_frames, round(m, 6) AS mean_frame_delta, round(s, 6) AS static_like_ratio, flags AS quality_flags, flags = '' AS quality_ok,
  CASE WHEN num_frames < 4 OR s > 0.9 THEN 'quality_gate_failed:' || flags WHEN flags <> '' THEN 'success_with_quality_warning' ELSE 'success' END AS reason FROM h""",
    "landmark_quality": f"""WITH {FRAMES}, s AS (SELECT user_id, floor(t)::INT AS slide, count(*) AS n, count(*) FILTER (k IS NULL OR k > 50 OR value IS NULL) AS b FROM f GROUP BY 1, 2)
SELECT user_id, count(*) AS n_slides, count(*) FILTER (b > 0) AS broken_slides, sum(n)::BIGINT AS n_frames, sum(b)::BIGINT AS broken_frames, round(100::DOUBLE * sum(b) / sum(n), 6) AS broken_pct FROM s GROUP BY 1""",
    "coordinate_jitter": "SELECT label, round((var_pop(embedding[1]::DOUBLE) + var_pop(embedding[2]::DOUBLE) + var_pop(embedding[3]::DOUBLE) + var_pop(embedding[4]::DOUBLE)) / 4, 6) AS jitter, count(*) AS n_frames FROM embeddings GROUP BY 1",
    "text_normalize": r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(regexp_replace("
    + _expanded("replace(lower(coalesce(text, '')), '’', '''')")
    + r", '[^a-z\s]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('', "
    + ", ".join(f"'{w}'" for w in spec.FILLERS)
    + r")), ' ') AS norm, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS squeezed FROM conversations",
    "transcript_full_outer": f"""WITH {PAIRS} SELECT conv_id, chunk, CASE WHEN u.text IS NULL THEN 'missing_asr_chunk' WHEN r.text IS NULL THEN 'missing_vsr_chunk' WHEN NOT u.ok THEN 'asr_not_ok' WHEN NOT r.ok THEN 'vsr_not_ok' ELSE 'success' END AS reason,
  u.text IS NOT NULL AND r.text IS NOT NULL AND coalesce(u.ok, false) AND coalesce(r.ok, false) AS ok, length(u.text)::INT AS asr_chars, length(r.text)::INT AS vsr_chars FROM u FULL JOIN r USING (conv_id, chunk)""",
    "tail_trim": r"SELECT conv_id, turn, trim(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '(?i)(^|\s+)((^|\s*)\b(" + "|".join(spec.TAIL_WORDS) + r")\b)+$', '')) AS text FROM conversations",
    "lips_text": r"SELECT conv_id, turn, lower(trim(regexp_replace(replace(text || ' <eos>', '<eos>', ''), '\s+', ' ', 'g'))) AS text FROM conversations",
    "natural_order": r"SELECT source, coalesce(try_cast(regexp_extract(source, 'src(\d+)$', 1) AS BIGINT), 1000000000) AS number, count(*) AS n FROM documents GROUP BY 1",
    "report_assemble": """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, o_custkey AS video_id, CASE WHEN q > 50 THEN round(q, 4) END AS content, CASE WHEN q > 50 AND d > 0.05 THEN round(d, 4) END AS semantic, CASE WHEN q > 50 AND t > 0.04 THEN round(t, 4) END AS sync,
  CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 4) END AS audio, CASE WHEN o_orderstatus = 'F' THEN 'audio_artifacts_completed' WHEN q > 50 THEN 'fully_analyzed' ELSE 'visual_only' END AS status FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "resume_antijoin": f"WITH {ORDERS} SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT o_orderkey FROM cache WHERE ok OR reason IN ('input_audio_not_found', 'empty_audio_input')) USING (o_orderkey)",
    "stage_rollup": f"""WITH {ORDERS} SELECT o_custkey, count(*) AS total, count(*) FILTER (ok) AS num_ok, count(*) FILTER (NOT ok AND reason NOT LIKE 'skipped%' AND reason NOT LIKE '%not_found%') AS num_failed,
  count(*) FILTER (NOT ok AND reason LIKE 'skipped%') AS num_skipped, count(*) FILTER (NOT ok AND reason LIKE '%not_found%') AS num_missing FROM cache GROUP BY ROLLUP (o_custkey)""",
    "work_list": "SELECT c_custkey, o_custkey IS NOT NULL AS input_exists, CASE WHEN o_custkey IS NULL THEN 'input_audio_not_found' END AS reason FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey",
    "read_back": f"""WITH {ORDERS}, x AS (SELECT orders.o_orderkey, CASE WHEN cache.o_orderkey IS NULL THEN 'missing_output_json_after_processing' WHEN reason = 'decode_timeout' THEN 'manifest_read_error' ELSE 'success' END AS reason FROM orders LEFT JOIN cache USING (o_orderkey))
SELECT o_orderkey, reason, reason = 'success' AS ok FROM x""",
    "manifest_usage": """WITH x AS (SELECT o_orderkey, o_orderpriority AS method, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'genuine_train' WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderpriority < '3' THEN 'genuine_val'
  WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '5%' THEN 'eval_track2' WHEN o_orderstatus = 'O' THEN 'eval_track1' END AS usage FROM orders)
SELECT o_orderkey, usage, CASE WHEN usage LIKE 'genuine%' THEN usage || '/' || o_orderkey || '.mp4' ELSE usage || '/' || method || '/' || o_orderkey || '.mp4' END AS path, o_orderkey::VARCHAR AS stem FROM x WHERE usage IS NOT NULL""",
    "set_ops": """SELECT 'union' AS kind, doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) UNION ALL SELECT 'both', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'only', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)""",
    "feature_clean_masks": f"""WITH {LINES}, c AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, 1 - l_discount AS l_discount, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS l_tax FROM m)
SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_extendedprice, 0) AS l_extendedprice, round(coalesce(l_discount, 0), 6) AS l_discount, coalesce(l_tax, 0) AS l_tax,
  l_quantity IS NOT NULL AS l_quantity__seen, l_extendedprice IS NOT NULL AS l_extendedprice__seen, l_quantity IS NOT NULL OR l_extendedprice IS NOT NULL AS visual__available, l_discount IS NOT NULL AS l_discount__seen, l_tax IS NOT NULL AS l_tax__seen, l_discount IS NOT NULL OR l_tax IS NOT NULL AS audio__available FROM c""",
    "baseline_stats": f"WITH {LINES}, o AS ({_LONG}) SELECT feature, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, "
    + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95, 99))
    + " FROM o WHERE l_returnflag = 'N' GROUP BY 1",
    "robust_scale": f"WITH {SCALED} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({n}, 6) AS {n}, {n}__seen" for n in NAMES) + " FROM z",
    "percentile_rank_signal": f"""WITH {LINES}, o AS ({_LONG}), b AS (SELECT feature, value, count(*) AS n FROM o WHERE l_returnflag = 'N' AND value IS NOT NULL GROUP BY 1, 2),
a AS (SELECT l_orderkey, l_linenumber, feature, value FROM o WHERE l_returnflag = 'R' AND value IS NOT NULL),
g AS (SELECT feature, value, sum(n) OVER (PARTITION BY feature ORDER BY value) AS below, sum(n) OVER (PARTITION BY feature) AS total FROM (SELECT feature, value, sum(n) AS n FROM (SELECT * FROM b UNION ALL SELECT DISTINCT feature, value, 0 FROM a) GROUP BY 1, 2)),
r AS (SELECT a.*, round_even(100::DOUBLE * below / total, 0)::INT AS percentile_rank FROM a JOIN g USING (feature, value)),
s AS (SELECT *, CASE WHEN percentile_rank >= 95 THEN 'FAR_ABOVE_NORMAL' WHEN percentile_rank >= 80 THEN 'ABOVE_NORMAL' WHEN percentile_rank <= 5 THEN 'FAR_BELOW_NORMAL' WHEN percentile_rank <= 20 THEN 'BELOW_NORMAL' ELSE 'NORMAL' END AS signal FROM r)
SELECT l_orderkey, l_linenumber, feature, percentile_rank, signal, CASE WHEN feature = 'l_tax' THEN CASE signal WHEN 'FAR_BELOW_NORMAL' THEN 'CRITICAL' WHEN 'BELOW_NORMAL' THEN 'ELEVATED' ELSE 'NORMAL' END
  ELSE CASE signal WHEN 'FAR_ABOVE_NORMAL' THEN 'CRITICAL' WHEN 'ABOVE_NORMAL' THEN 'ELEVATED' ELSE 'NORMAL' END END AS severity FROM s""",
    "masked_scores": f"WITH {SCORES} SELECT l_orderkey, l_linenumber, audio_available, round(visual_score, 6) AS visual_score, round(audio_score, 6) AS audio_score, round(kl_divergence, 6) AS kl_divergence, round(joint_score, 6) AS joint_score FROM j",
    "poe_fusion": """WITH x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS m1, embedding[i + 5]::DOUBLE AS v1, embedding[i + 9]::DOUBLE AS m2, embedding[i + 13]::DOUBLE AS v2, (label % 3 > 0)::INT AS w FROM (SELECT *, unnest(range(0, 4)) AS i FROM embeddings))
SELECT vec_id, i::INT AS i, round((m1 * exp(-v1) + m2 * w * exp(-v2)) / (1 + exp(-v1) + w * exp(-v2) + 1e-8), 4) + 0::DOUBLE AS mu, round(-ln(1 + exp(-v1) + w * exp(-v2) + 1e-8), 4) + 0::DOUBLE AS logvar FROM x""",
    "threshold_calibration": f"WITH {SCORES} SELECT round(threshold, 5) AS threshold, round(mean_score, 5) AS mean_score, round(median_score, 5) AS median_score, round(max_score, 5) AS max_score, n FROM limits",
    "anomaly_levels": f"WITH {LEVELS} SELECT l_orderkey, l_linenumber, round(norm, 5) AS normalized_score, {LEVEL} AS level FROM lv",
    "top_features": f"WITH {LEVELS}, t AS (SELECT *, {LEVEL} AS level, {_top(2)} AS tops FROM lv) SELECT l_orderkey, l_linenumber, array_to_string(tops, ',') AS top_features, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN NOT {n}__seen THEN '{n}' END" for n in NAMES)
    + "], lambda x: x IS NOT NULL), ',') AS missing_features, CASE WHEN len(tops) = 0 THEN '"
    + spec.NO_FEATURE
    + "' ELSE CASE level "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.LEVEL_TEXT.items())
    + " END || array_to_string(tops, ', ') || '.' END AS interpretation FROM t",
    "topk_chunks": f"WITH {SUMMARY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM cs) SELECT user_id, rank::INT AS rank, chunk_id, score, {LEVEL} AS level, temporal_pattern FROM r JOIN vp USING (user_id) WHERE rank <= 5",
    "video_summary": f"WITH {SUMMARY} SELECT * REPLACE (round(mean_score, 4) AS mean_score) FROM vp",
    "argmax_chunk": f"WITH {CHUNK_SCORES} SELECT user_id, chunk_id, score FROM cs WHERE score > -1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, chunk_id) = 1",
    "branch_fusion": f"""WITH {FRAMES}, b AS (SELECT user_id, avg(value) AS s, avg(k) AS t, avg(value / 200) AS c FROM f GROUP BY 1),
x AS (SELECT *, coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0) AS a1, coalesce((t - min(t) OVER ()) / nullif(max(t) OVER () - min(t) OVER (), 0), 0) AS a2 FROM b)
SELECT user_id, round(a1, 6) AS scfd_scaled, round(a2, 6) AS tcfd_scaled, round((a1 + a2 + c) / 3, 6) AS fused FROM x""",
    "cosine_steps": """WITH a AS (SELECT vec_id // 2 AS step, label, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 2 AS step, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 2 = 1)
SELECT label, step, round(list_inner_product(a, b) / ((sqrt(list_inner_product(a, a)) + 1e-8) * (sqrt(list_inner_product(b, b)) + 1e-8)), 5) AS cosine FROM a JOIN b USING (step)""",
    "cosine_summary": """WITH a AS (SELECT vec_id // 2 AS step, label, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 2 AS step, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 2 = 1),
c AS (SELECT label, list_inner_product(a, b) / ((sqrt(list_inner_product(a, a)) + 1e-8) * (sqrt(list_inner_product(b, b)) + 1e-8)) AS x FROM a JOIN b USING (step))
SELECT label, round(round(avg(x), 6), 5) AS mean_cosine, round(round(min(x), 6), 5) AS min_cosine, round(round(max(x), 6), 5) AS max_cosine, round(round(quantile_cont(x, 0.03), 6), 5) AS third_percentile, count(*) AS n_steps FROM c GROUP BY 1""",
    "confusion_metrics": f"WITH {JUDGED}, c AS (SELECT {CONFUSION} FROM (SELECT fake AS truth, score > 7 AS predicted FROM lb)) SELECT *, {RATES} FROM c",
    "auc_roc": f"""WITH {JUDGED}, r AS (SELECT fake, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM lb),
x AS (SELECT count(*) FILTER (fake) AS n_pos, count(*) FILTER (NOT fake) AS n_neg, sum(k) FILTER (fake) AS s FROM r)
SELECT n_pos, n_neg, round(coalesce((s - n_pos * (n_pos + 1) / 2) / nullif(n_pos::DOUBLE * n_neg, 0), 0), 9) AS auc FROM x""",
    "best_threshold": f"""WITH {JUDGED}, p AS (SELECT DISTINCT unnest(quantile_cont(score, [{", ".join(str(i / 100) for i in range(1, 100))}])) AS threshold FROM lb),
c AS (SELECT threshold, {CONFUSION} FROM (SELECT threshold, fake AS truth, score > threshold AS predicted FROM p, lb) GROUP BY 1),
r AS (SELECT *, round(2::DOUBLE * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn), 1e-12), 12) AS f1 FROM c)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, tp, fp FROM r ORDER BY r.f1 DESC, r.threshold LIMIT 1""",
    "score_by_type": f"WITH {JUDGED}, x AS (SELECT CASE WHEN fake AND toxic THEN 'both' WHEN fake THEN 'video_only' WHEN toxic THEN 'audio_only' ELSE 'real' END AS fake_type, score FROM lb) " + _stats("fake_type"),
    "score_by_method": f"WITH {JUDGED}, x AS (SELECT CASE WHEN lang <> 'en' THEN lang WHEN fake THEN 'real_video_audio_only_fake' ELSE 'real' END AS method, score FROM lb) " + _stats("method", ', round(min(score), 6) AS "min", round(max(score), 6) AS "max"'),
    "score_distribution": f"WITH {JUDGED} SELECT fake, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS std, round(CASE WHEN fake THEN quantile_cont(score, 0.05) ELSE quantile_cont(score, 0.95) END, 6) AS tail FROM lb GROUP BY fake",
    "label_coverage": "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NULL) AS only_label, count(*) FILTER (l.doc_id IS NULL) AS only_score FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id",
    "per_feature_auc": f"""WITH {JUDGED}, w AS (SELECT fake, length(text)::DOUBLE AS chars, len(string_split(text, ' '))::DOUBLE AS blinking_variance, CASE WHEN documents.source < 'src15' THEN len(string_split(text, chr(10)))::DOUBLE END AS lines FROM documents JOIN lb USING (doc_id)),
o AS (SELECT fake, 'chars' AS feature, chars AS value, chars AS v FROM w UNION ALL SELECT fake, 'blinking_variance', blinking_variance, -blinking_variance FROM w UNION ALL SELECT fake, 'lines', lines, lines FROM w WHERE lines IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS k FROM o)
SELECT feature, count(*) AS n_valid, round(quantile_cont(value, 0.5) FILTER (NOT fake), 6) AS median_real, round(quantile_cont(value, 0.5) FILTER (fake), 6) AS median_fake, round(avg(value) FILTER (NOT fake), 6) AS mean_real, round(avg(value) FILTER (fake), 6) AS mean_fake,
  CASE WHEN count(*) < 20 THEN 'too_few_valid' ELSE 'ok' END AS status, CASE WHEN count(*) >= 20 THEN round(coalesce((sum(k) FILTER (fake) - count(*) FILTER (fake) * (count(*) FILTER (fake) + 1) / 2) / nullif(count(*) FILTER (fake)::DOUBLE * count(*) FILTER (NOT fake), 0), 0.5), 6) END AS auc FROM r GROUP BY 1""",
    "verdict_parse": f"WITH {VERDICTS} SELECT doc_id, reasoning, video_fake, audio_fake, label, confidence FROM vd",
    "verdict_metrics": f"""WITH {VERDICTS}, t AS (SELECT 'overall' AS task, fake OR toxic AS truth, label = 'FAKE' AS predicted FROM vd WHERE label IN ('FAKE', 'GENUINE') UNION ALL SELECT 'video', fake, video_fake FROM vd WHERE label IN ('FAKE', 'GENUINE') UNION ALL SELECT 'audio', toxic, audio_fake FROM vd WHERE label IN ('FAKE', 'GENUINE')),
c AS (SELECT task, {CONFUSION} FROM t GROUP BY 1) SELECT *, {RATES} FROM c""",
    "verdict_hist": f"WITH {VERDICTS} SELECT 'label' AS field, coalesce(label, 'UNKNOWN') AS value, count(*) AS n FROM vd GROUP BY 2 UNION ALL SELECT 'confidence', coalesce(confidence, 'UNKNOWN'), count(*) FROM vd GROUP BY 2",
    "greedy_split": f"""WITH {SIZES}, x AS (SELECT *, coalesce(sum(n_chunks) OVER (ORDER BY n_chunks, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY n_chunks, video_id) AS at_, count(*) OVER () AS n, sum(n_chunks) OVER () AS total FROM sz)
SELECT video_id, n_chunks, CASE WHEN n >= 2 AND before < greatest(1, round_even(total * 0.15::DOUBLE, 0)) AND at_ < n THEN 'val' ELSE 'train' END AS subset FROM x""",
    "manifest_split": f"WITH {SIZES} SELECT video_id, n_chunks, CASE c_mktsegment WHEN 'BUILDING' THEN 'train' ELSE 'val' END AS subset FROM sz JOIN customer ON c_custkey = video_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "balance_select": f"WITH {SIZES} SELECT video_id, n_chunks FROM sz JOIN customer ON c_custkey = video_id WHERE c_acctbal > 0 ORDER BY n_chunks DESC, video_id LIMIT 712",
    "round_robin": "SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 3)::INT AS shard FROM supplier",
}

_SLIDES = FRAMES + """, sl AS (SELECT DISTINCT user_id, user_id % 3 = 0 AS cached, floor(t / 4)::INT AS chunk, (event_id % 12)::INT AS idx, event_type = 'click' AS landmark FROM f),
sd AS (SELECT *, 'store/interim/user_' || user_id || CASE WHEN cached THEN '/cache' ELSE '' END || printf('/chunk_%04d', chunk) AS dir FROM sl),
sp AS (SELECT dir || '/slides' AS slides_dir, user_id, chunk, cached, printf('slide_%03d', idx) AS slide_id, idx AS slide_idx, dir || printf('/slides/slide_%03d_faces.npy', idx) AS faces_path, dir || printf('/slides/slide_%03d_landmarks.npy', idx) AS landmarks_path
  FROM sd GROUP BY ALL HAVING bool_or(landmark) AND bool_or(NOT landmark))"""
_CONTEXTS = CHUNK_SCORES + """, lx AS (
  SELECT user_id, chunk_id, 'max_blur_flicker' AS feature, round(nullif(max_flicker, 0), 6) AS value FROM fl UNION ALL SELECT user_id, chunk_id, 'blur_flicker_variance', round(nullif(flicker_variance, 0), 6) FROM fl
  UNION ALL SELECT user_id, chunk_id, 'blinking_variance', round(nullif(mean_value, 0), 6) FROM fl),
gb AS (SELECT feature, value FROM lx WHERE user_id % 2 = 0 AND value IS NOT NULL),
gs AS (SELECT feature, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count(*) AS n FROM gb GROUP BY 1),
gr AS (SELECT lx.user_id, lx.chunk_id, lx.feature, lx.value, count(gb.value) AS below FROM lx LEFT JOIN gb ON gb.feature = lx.feature AND gb.value <= lx.value GROUP BY ALL),
fc AS (SELECT user_id, chunk_id, feature, value, CASE WHEN value IS NOT NULL THEN p50 END AS genuine_p50, CASE WHEN value IS NOT NULL THEN p95 END AS genuine_p95, CASE WHEN value IS NOT NULL THEN round_even(100 * below / n::DOUBLE, 0)::INT END AS percentile_rank FROM gr LEFT JOIN gs USING (feature)),
fx AS (SELECT *, CASE WHEN percentile_rank >= 95 THEN 'FAR_ABOVE_NORMAL' WHEN percentile_rank >= 80 THEN 'ABOVE_NORMAL' WHEN percentile_rank <= 5 THEN 'FAR_BELOW_NORMAL' WHEN percentile_rank <= 20 THEN 'BELOW_NORMAL' WHEN percentile_rank IS NOT NULL THEN 'NORMAL' END AS signal FROM fc)"""
_REPORT = """rp AS (SELECT o_custkey AS video_id, o_orderkey AS chunk_id, CASE WHEN o_custkey % 4 = 0 THEN 'audio_artifacts_completed' ELSE 'visual_only' END AS status, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS payload FROM orders),
pt AS (SELECT o_custkey AS video_id, o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 1000000000 ELSE 0 END AS chunk_id, o_orderstatus <> 'F' AS ok, -o_totalprice AS payload FROM orders WHERE o_orderpriority < '3')"""

ORACLE |= {
    "feature_context": f"WITH {_CONTEXTS} SELECT * FROM fx",
    "pattern_types": f"""WITH {_CONTEXTS}, g AS (SELECT user_id, feature = 'blinking_variance' AS second, CASE WHEN signal = CASE WHEN feature = 'blinking_variance' THEN 'FAR_BELOW_NORMAL' ELSE 'FAR_ABOVE_NORMAL' END THEN 2
  WHEN signal = CASE WHEN feature = 'blinking_variance' THEN 'BELOW_NORMAL' ELSE 'ABOVE_NORMAL' END THEN 1 ELSE 0 END AS grade FROM fx),
w AS (SELECT user_id, ['NORMAL', 'ELEVATED', 'CRITICAL'][max(grade) FILTER (NOT second) + 1] AS group_1, ['NORMAL', 'ELEVATED', 'CRITICAL'][max(grade) FILTER (second) + 1] AS group_2 FROM g GROUP BY 1)
SELECT user_id, group_1, group_2, 'NORMAL' AS group_3, 'NORMAL' AS group_4, CASE WHEN group_1 = 'CRITICAL' AND group_2 = 'CRITICAL' THEN 'FACE SWAP' WHEN group_1 = 'NORMAL' AND group_2 = 'NORMAL' THEN 'GENUINE' ELSE 'UNCERTAIN' END AS manipulation_type FROM w""",
    "frame_groups": f"""WITH {CHUNK_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC NULLS LAST, chunk_id) AS rank FROM cs)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1)::INT AS i, printf('Frames for %s [%.1fs-%.1fs]', chunk_id, start_sec, end_sec) AS label,
  array_to_string(list_transform(range(0, rank + 1), lambda k: 'packages/' || user_id || '/' || chunk_id || '_frame_' || k || '.jpg'), ',') AS paths FROM r WHERE rank IN (1, 3)""",
    "chunk_discovery": f"WITH {_SLIDES} SELECT DISTINCT unnest(['deep', 'direct_else_cache', 'both_with_slides']) AS variant, 'user_' || user_id AS video_id, printf('chunk_%04d', chunk) AS chunk_id, dir AS chunk_dir, chunk::BIGINT AS chunk_number FROM sd",
    "slide_pairs": f"""WITH {_SLIDES}, i AS (SELECT *, slide_idx - row_number() OVER (PARTITION BY slides_dir ORDER BY slide_idx) AS island FROM sp),
r AS (SELECT slides_dir, island, count(*) AS n, min(slide_idx) AS a FROM i GROUP BY slides_dir, island QUALIFY row_number() OVER (PARTITION BY slides_dir ORDER BY n DESC, a) = 1)
SELECT slides_dir, slide_id, slide_idx, faces_path, landmarks_path FROM i JOIN r USING (slides_dir, island)""",
    "discovered_pairs": f"WITH {_SLIDES} SELECT 'user_' || user_id AS video_id, printf('chunk_%04d', chunk) AS chunk_id, faces_path, landmarks_path FROM sp WHERE NOT cached",
    "layout_router": """WITH x AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'train' WHEN 'MACHINERY' THEN 'val' END AS layout_group, c_mktsegment FROM customer)
SELECT m AS mode, c_custkey, layout_group FROM x, (VALUES ('genuine'), ('infer')) v(m) WHERE layout_group IS NOT NULL UNION ALL SELECT 'flat', c_custkey, NULL FROM x WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')""",
    "chunk_videos": """SELECT 'v' || o_custkey AS video_id, printf('chunk_%04d', o_orderkey % 40) AS chunk_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'store/interim/v' || o_custkey || printf('/chunk_%04d', o_orderkey % 40) || '/video.mp4' END AS video_path FROM orders GROUP BY o_custkey, o_orderkey % 40""",
    "slide_metadata": """WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, l_quantity FROM lineitem WHERE l_discount > 0.02)
SELECT l.l_orderkey AS chunk_dir, (l.l_linenumber - 1)::INT AS slide_idx, m.l_quantity AS start_sec, m.l_quantity + 0.5 AS end_sec FROM lineitem l LEFT JOIN m ON m.l_orderkey = l.l_orderkey AND m.i = l.l_linenumber""",
    "recording_fps": """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN (o_custkey % 30 + 1)::DOUBLE ELSE 25 END AS fps FROM orders GROUP BY 1""",
    "report_patch": f"""WITH {_REPORT}, j AS (SELECT rp.*, pt.payload AS p, pt.chunk_id IS NOT NULL AS has FROM rp LEFT JOIN pt USING (video_id, chunk_id))
SELECT video_id, chunk_id, CASE WHEN bool_or(has) OVER (PARTITION BY video_id) THEN 'fully_analyzed' ELSE status END AS status, CASE WHEN has THEN p ELSE payload END AS payload FROM j""",
    "report_audio": f"WITH {_REPORT} SELECT video_id, chunk_id, 'audio_artifacts_completed' AS status, CASE WHEN status = 'audio_artifacts_completed' THEN rp.payload WHEN ok THEN pt.payload END AS payload FROM rp LEFT JOIN pt USING (video_id, chunk_id)",
    "sync_video_summary": """WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN value < 80 THEN floor(value)::BIGINT END AS score FROM events), y AS (SELECT *, CASE WHEN status = 'ok' THEN score END AS s FROM x)
SELECT user_id, count(*) AS num_chunks, count(s) AS num_ok, count(*) FILTER (status = 'skipped') AS num_skipped, count(*) FILTER (status = 'error') AS num_error, round(avg(s), 6) AS mean_score, round(stddev_pop(s), 6) AS std_score,
  arg_max(event_id, (s, -event_id)) FILTER (s IS NOT NULL) AS best_chunk, max(s) AS best_chunk_score, arg_min(event_id, (s, event_id)) FILTER (s IS NOT NULL) AS worst_chunk, min(s) AS worst_chunk_score FROM y GROUP BY 1""",
    "long_chunks": f"""WITH {FRAMES}, n AS (SELECT user_id, floor(t)::INT AS chunk, count(*) AS n FROM f GROUP BY 1, 2) SELECT user_id, chunk, 'at least' AS rule FROM n WHERE n >= 3 UNION ALL SELECT user_id, chunk, 'more' FROM n WHERE n > 3""",
    "first_chunks": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 25",
    "verdict_breakdown": f"""WITH {VERDICTS}, x AS (SELECT vd.*, lang, fake OR toxic AS truth, vd.label = 'FAKE' AS predicted FROM vd JOIN documents USING (doc_id) WHERE vd.label IN ('FAKE', 'GENUINE')),
t AS (SELECT 'overall' AS task, NULL AS value, truth, predicted FROM x UNION ALL SELECT 'video', NULL, fake, video_fake FROM x UNION ALL SELECT 'audio', NULL, toxic, audio_fake FROM x
  UNION ALL SELECT 'method', CASE WHEN lang = 'en' OR lang IS NULL THEN CASE WHEN truth THEN 'real_video_audio_only_fake' ELSE 'real' END ELSE lang END, truth, predicted FROM x
  UNION ALL SELECT 'type', CASE WHEN fake AND toxic THEN 'both' WHEN fake THEN 'video_only' WHEN toxic THEN 'audio_only' ELSE 'real' END, truth, predicted FROM x),
c AS (SELECT task, value, {CONFUSION} FROM t GROUP BY 1, 2) SELECT *, {RATES} FROM c""",
    "verdict_evidence": f"""WITH {VERDICTS}, k AS (SELECT doc_id FROM documents WHERE n_chars > 900) SELECT 'label' AS field, coalesce(label, 'UNKNOWN') AS value, count(*) AS n, (SELECT count(*) FROM vd ANTI JOIN k USING (doc_id)) AS excluded FROM vd SEMI JOIN k USING (doc_id) GROUP BY 2""",
    "usage_counts": """WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 'genuine_train' WHEN o_orderstatus NOT IN ('F', 'O') AND o_orderpriority < '3' THEN 'genuine_val'
  WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '5%' THEN 'eval_track2' WHEN o_orderstatus = 'O' THEN 'eval_track1' END AS usage FROM orders) SELECT usage, count(*) AS n FROM x WHERE usage IS NOT NULL GROUP BY 1""",
}
