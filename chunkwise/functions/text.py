"""Text functions: transcripts, word error rate, repetition, verdicts.  All but the word distance are native expressions."""

from __future__ import annotations

import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chunkwise import spec

from .scalar import col

_UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
# Names of 1000 ** k, k = 1 to 101, by the rule of the short scale: a unit's and a ten's Latin stem.
_STEMS = ["m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non", *(u + t for t in "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split() for u in ("", *"un duo tre quattuor quin sex sept octo novem".split())), "cent"]
_SCALES = ["thousand", *(x + "illion" for x in _STEMS)]
#: A mark between pieces of a text that are replaced one by one.
_CUT = "\u0001"


def squeezed(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def _below_thousand(n: Column) -> Column:
    units = F.array(*map(F.lit, _UNITS))
    tens = F.array(*map(F.lit, ["", "", *_TENS]))
    rest = (n % 100).cast("int")
    small = F.when(rest < 20, F.get(units, rest)).otherwise(F.concat_ws(" ", F.get(tens, (rest / 10).cast("int")), F.when(rest % 10 > 0, F.get(units, rest % 10))))
    hundreds = (n / 100).cast("int")
    return F.when(hundreds > 0, F.concat(F.get(units, hundreds), F.lit(" hundred"), F.when(rest > 0, F.concat(F.lit(" and "), small)).otherwise(""))).otherwise(small)


def number_words(digits) -> Column:
    """English words of a whole number, without hyphens or commas; from 1000 ** 102 on, which has no name, it stays as it is."""
    d = F.regexp_replace(col(digits), "^0+", "")
    n = F.ceil(F.length(d) / F.lit(3)).cast("int")
    padded = F.lpad(d, n * 3, "0")
    groups = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((n - i).alias("k"), F.substring(padded, (i - 1) * 3 + 1, F.lit(3)).cast("int").alias("g")))
    scale = F.array(*map(F.lit, ["", *_SCALES]))
    words = F.transform(F.filter(groups, lambda x: x["g"] > 0), lambda x: F.when(x["k"] > 0, F.concat_ws(" ", _below_thousand(x["g"]), F.get(scale, x["k"]))).when((x["g"] < 100) & (n > 1), F.concat(F.lit("and "), _below_thousand(x["g"]))).otherwise(_below_thousand(x["g"])))
    return F.when(d == "", "zero").when(n > len(_SCALES) + 1, col(digits)).otherwise(F.array_join(words, " "))


def _replaced(text, pattern: str, by) -> Column:
    """``text`` with each match of ``pattern``, which has one group, put through ``by``."""
    pieces = F.split(F.regexp_replace(F.translate(col(text), _CUT, " "), pattern, f"{_CUT}$1{_CUT}"), _CUT)
    # matches are the pieces at odd places
    return F.array_join(F.transform(pieces, lambda w, i: F.when(i % 2 == 1, by(w)).otherwise(w)), "")


def numbers_spelled(text) -> Column:
    """Whole numbers that stand alone are put in words."""
    return _replaced(text, r"\b(\d+)\b", number_words)


def contractions_expanded(text) -> Column:
    meaning = F.create_map(*map(F.lit, chain(*spec.CONTRACTIONS.items())))
    return _replaced(text, rf"\b({'|'.join(map(re.escape, spec.CONTRACTIONS))})\b", lambda w: F.try_element_at(meaning, w))


def normalized(text) -> Column:
    """Words of a transcript as compared: lower case, no contractions, digits, punctuation or fillers."""
    t = F.replace(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("’"), F.lit("'"))
    spelled = numbers_spelled(contractions_expanded(t))
    words = F.split(F.regexp_replace(spelled, r"[^a-z\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(spec.FILLERS)), " ")


def words_of(text) -> Column:
    return F.filter(F.split(col(text), " "), lambda w: w != "")


def words_apart(a: list[str], b: list[str]) -> int:
    """Levenshtein distance of two lists of words, by columns of differences kept as the bits of one integer."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, distance = whole, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        down = ((same & more) + more ^ more) | same
        right_more, right_less = less | whole & ~(down | more), more & down
        distance += bool(right_more & last) - bool(right_less & last)
        right_more, right_less = (right_more << 1 | 1) & whole, right_less << 1 & whole
        more, less = right_less | whole & ~(same | less | right_more), right_more & (same | less)
    return distance


@F.pandas_udf(IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two word arrays of any length, in Arrow batches; null if one is null."""
    return pd.Series([None if x is None or y is None else words_apart(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def error_rate(ref, hyp, distance) -> Column:
    """Word errors for each reference word; an empty reference has 0 or, if there are hypotheses, 1."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.try_divide(col(distance).cast("double"), F.size(ref)))


def tail_trimmed(text) -> Column:
    """Without function words at the end."""
    return F.trim(F.regexp_replace(squeezed(text), rf"(?i)(^|\s+)((^|\s*)\b({'|'.join(spec.TAIL_WORDS)})\b)+$", ""))


def with_repetition_collapsed(rows: DataFrame, text: str, least: int = 4, repeats: int = 3, longest: int = 24, covered: float = 0.75) -> DataFrame:
    """``rows`` with ``collapsed`` and ``repeated``: a text whose first words repeat keeps them once.

    The longest unit of ``least`` to ``longest`` words wins that comes ``repeats``
    times or more at the start and covers ``covered`` of the words.
    """
    out = rows.withColumn("__text", squeezed(text)).withColumn("__words", F.split("__text", " "))
    words, n = F.col("__words"), F.size("__words")
    top = F.least(F.lit(longest), F.floor(n / repeats).cast("int"))
    units = F.when(top >= least, F.sequence(F.greatest(top, F.lit(least)), F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    # words equal to those one unit before make a run of whole units; only units whose second copy is there are looked at
    near = F.filter(units, lambda u: F.slice(words, u + 1, u) == F.slice(words, 1, u))

    def runs(u: Column) -> Column:
        """How many times the first u words come in a row."""
        differs = F.filter(F.sequence(F.lit(2), F.floor(n / u).cast("int") + 1), lambda k: F.slice(words, (k - 1) * u + 1, u) != F.slice(words, 1, u))
        return F.coalesce(F.get(differs, F.lit(0)) - 1, F.floor(n / u).cast("int"))

    out = out.withColumn("__near", F.when((F.col("__text") != "") & (n >= least * repeats), near).otherwise(F.array().cast("array<int>")))
    tried = F.transform("__near", lambda u: F.struct(u.alias("u"), runs(u).alias("r")))
    out = out.withColumn("__unit", F.get(F.filter(tried, lambda x: (x["r"] >= repeats) & (x["r"] * x["u"] / n >= covered)), F.lit(0))["u"])
    once = tail_trimmed(F.array_join(F.slice(words, 1, F.coalesce("__unit", F.lit(1))), " "))
    out = out.withColumns({"collapsed": F.when(F.col("__unit").isNotNull(), once).otherwise(F.col("__text")), "repeated": F.col("__unit").isNotNull()})
    return out.drop("__text", "__words", "__near", "__unit")


def retry_choice(first: str, retry: str) -> Column:
    """struct(text, repetition_fix) of a decode and its retry, each a struct(text, repeated)."""
    a, b = F.col(first), F.col(retry)
    return (
        F.when(~a["repeated"], F.struct(a["text"].alias("text"), F.lit("none").alias("repetition_fix")))
        .when(b["text"].isNotNull() & (b["text"] != "") & ~b["repeated"], F.struct(b["text"].alias("text"), F.lit("retry").alias("repetition_fix")))
        .when(b["text"].isNotNull() & (b["text"] != ""), F.struct(b["text"].alias("text"), F.lit("retry_collapsed").alias("repetition_fix")))
        .otherwise(F.struct(a["text"].alias("text"), F.lit("collapsed").alias("repetition_fix")))
    )


def stripped(text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def lips_text(text) -> Column:
    return F.lower(squeezed(F.replace(col(text), F.lit("<eos>"), F.lit(""))))


VERDICT = (
    "video_fake boolean, audio_fake boolean, label string, confidence string, video_manipulation_type string, audio_manipulation_type string, "
    "primary_evidence array<string>, visual_inspection_summary string, metric_summary string, key_reasoning string"
)


def parsed_verdict(text) -> Column:
    """struct(reasoning, verdict, raw_output) of a model's answer; the verdict is null unless it is a JSON object."""
    raw = stripped(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>", ""))
    inner = stripped(F.regexp_replace(stripped(F.regexp_extract(raw, r"(?s)<verdict>(.*?)</verdict>", 1)), r"(?m)^```(?:json)?|```$", ""))
    good = F.try_parse_json(inner).isNotNull() & inner.startswith("{")
    return F.struct(stripped(F.regexp_extract(raw, r"(?s)<think>(.*?)</think>", 1)).alias("reasoning"), F.when(good, F.from_json(inner, VERDICT)).alias("verdict"), raw.alias("raw_output"))
