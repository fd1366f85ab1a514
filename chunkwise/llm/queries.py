"""The queries of this subpackage over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenids import token_digest

    return token_digest(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_decode

    return encode_decode(_read(spark, sf_dir, "documents"), tokenizer_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_languages, predict_languages

    docs = _read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    found = predict_languages(docs, learn_languages(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import without_repeats

    return without_repeats(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_rules

    docs = _read(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link_quotes

    return link_quotes(_read(spark, sf_dir, "conversations"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import line_report

    return line_report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_repeated_spans": op4_repeated_spans,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_quotation_links": op7_quotation_links,
    "op8_decontaminate": op8_decontaminate,
    "op9_bpe": op9_bpe,
    "op10_line_dedup": op10_line_dedup,
}

#: Lower-case words and the distinct five-word shingles of ``table`` (id, text), as used by op8's SQL.
_SHINGLES = """
{name}_words AS (
  SELECT {id} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {table} WHERE text IS NOT NULL AND {id} IS NOT NULL),
{name} AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM {name}_words WHERE len(w) > 0)"""

ORACLE: dict[str, str] = {
    "op8_decontaminate": "WITH"
    + _SHINGLES.format(name="d", id="doc_id", table="documents")
    + ","
    + _SHINGLES.format(name="b", id="item_id", table="benchmark")
    + """,
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, n_shared, n_shared / n AS containment
FROM p JOIN n ON n.id = p.item_id WHERE 100 * n_shared >= 80 * n""",
    "op7_quotation_links": r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM conversations),
p AS (SELECT conv_id, turn, role, list_transform(l, lambda x: {'level': length(regexp_replace(regexp_extract(x, '^( ?>)+'), '[^>]', '', 'g')), 'body': regexp_replace(x, '^( ?>)+ ?', '')}) AS l FROM m),
q AS (SELECT conv_id, turn, role, list_transform(l, lambda x, i: {'level': x.level, 'body': x.body, 'announces': regexp_matches(x.body, '^(On|Le|Am|El) .{0,200}:\s*$') AND coalesce(l[i + 1].level, 0) > x.level}) AS l FROM p),
n AS (SELECT conv_id, turn, list_transform(q.l, lambda x: CASE WHEN x.announces THEN '' ELSE trim(regexp_replace(lower(x.body), '\s+', ' ', 'g'), ' ') END) AS norm, q.l FROM q),
k AS (SELECT conv_id, turn, norm, list_transform(l, lambda x, i: CASE WHEN norm[i] = '' THEN -1 ELSE x.level END) AS level FROM n),
e AS (SELECT *, list_filter(range(1, len(level) + 1), lambda i: level[i] >= 0 AND coalesce(level[i - 1], -1) <> level[i]) AS a, list_filter(range(1, len(level) + 1), lambda i: level[i] >= 0 AND coalesce(level[i + 1], -1) <> level[i]) AS b FROM k),
p1 AS (SELECT conv_id, turn, norm, level, unnest(a) AS a, unnest(b) AS b FROM e),
p2 AS (SELECT DISTINCT conv_id, turn, level[a] AS level, array_to_string(norm[a:b], ' ') AS passage, list_distinct(norm[a:b]) AS said FROM p1),
unit AS (SELECT conv_id, turn, level, passage, true AS whole, len(said) AS n, passage AS body FROM p2 UNION ALL SELECT conv_id, turn, level, passage, false, 1, unnest(said) FROM p2),
first AS (SELECT conv_id, whole, body, level, min(turn) AS from_turn FROM unit GROUP BY ALL),
found AS (SELECT u.conv_id, u.turn, u.level, u.passage, u.whole, u.n, f.from_turn FROM unit u JOIN first f ON u.conv_id = f.conv_id AND u.whole = f.whole AND u.body = f.body AND u.level = f.level + 1 AND f.from_turn < u.turn),
votes AS (SELECT conv_id, turn, level, from_turn, sum(n)::BIGINT AS n FROM (SELECT * FROM found QUALIFY whole OR NOT bool_or(whole) OVER (PARTITION BY conv_id, turn, level, passage)) GROUP BY ALL),
parent AS (SELECT conv_id, turn, arg_max(from_turn, (-level, n, from_turn)) AS parent, sum(n) AS n_linked FROM votes GROUP BY ALL),
thread AS (
  SELECT DISTINCT m.conv_id, m.turn, 0 AS depth, format('{:08d}', m.turn) AS path FROM m ANTI JOIN parent USING (conv_id, turn)
  UNION ALL SELECT parent.conv_id, parent.turn, depth + 1, path || '/' || format('{:08d}', parent.turn) FROM thread JOIN parent ON parent.conv_id = thread.conv_id AND parent.parent = thread.turn)
SELECT q.conv_id, q.turn, role,
  regexp_replace(array_to_string(list_transform(list_filter(l, lambda x: x.level = 0 AND NOT x.announces), lambda x: x.body), chr(10)), '^\s*\n|\s+$', '', 'g') AS reply,
  len(list_filter(l, lambda x: x.level > 0))::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, parent AS parent_turn, depth::BIGINT AS depth, path
FROM q LEFT JOIN parent USING (conv_id, turn) JOIN thread USING (conv_id, turn)""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, source, i AS pos, trim(lines[i], ' ') AS line FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))),
boiler AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT doc_id, list(pos) AS ats FROM l JOIN boiler USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(ats), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(lines, lambda x, i: NOT coalesce(list_contains(ats, i), false)), chr(10))) AS kept_sha256
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) LEFT JOIN gone USING (doc_id)""",
}
