"""Quotation linking for conversations, with DataFrame functions only.

Lines that begin with ``>`` are quotes; the number of ``>`` is the level.  A
passage is a run of lines of one level without an empty or announcing line.
Passages are normalised (lower case, white space and line breaks to one space)
and hashed, and a quoted passage is joined to the earliest message of its
conversation that has the passage one level up, wherever its lines break.  The
lines of passages that no message has as a whole (cut or mixed quotes) are
joined one by one in the same way.  The message that most of a message's
first-level quotes come from, in lines (ties: the later one), is the one it
replies to; where none has an original, the quotes of the next level that has
one decide.  Messages in order of ``path`` are the reply-ordered conversation;
``reply`` is without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MARKS = r"^(?: ?>)+"
#: A line that announces a quotation goes with it.
ANNOUNCE = r"^(?:On|Le|Am|El) .{0,200}:\s*$"
NULL_KEY = -(1 << 63)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _parsed(messages: DataFrame) -> DataFrame:
    """Each message with its parsed lines: struct(level, body), and whether a line announces a quote."""
    line = F.split(F.coalesce("text", F.lit("")), "\r?\n", -1)
    cut = F.transform(line, lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body")))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text", cut.alias("lines"))
    # line i announces if the next line is a quote one level down
    said = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), (x["body"].rlike(ANNOUNCE) & (F.coalesce(F.try_element_at("lines", i + 2)["level"], F.lit(0)) > x["level"])).alias("announces")))
    return rows.withColumns({"lines": said, "ck": F.coalesce("conv_id", F.lit(NULL_KEY)), "tk": F.coalesce("turn", F.lit(NULL_KEY))})


def _norm(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def _passages(parsed: DataFrame) -> DataFrame:
    """(ck, tk, level, lines) of each passage: the normalised lines in order."""
    norm = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), F.when(x["announces"], "").otherwise(_norm(x["body"])).alias("norm")))
    rows = parsed.select("ck", "tk", norm.alias("l"))
    # level -1 stands for a line that no passage goes over
    level = F.transform("l", lambda x: F.when(x["norm"] == "", -1).otherwise(x["level"]))
    rows = rows.withColumn("levels", level)
    at = lambda i: F.coalesce(F.get("levels", i), F.lit(-1))
    numbers = F.sequence(F.lit(0), F.size("l") - 1)
    edges = lambda step: F.filter(numbers, lambda i: (at(i) >= 0) & (at(i + step) != at(i)))
    runs = F.arrays_zip(edges(-1).alias("a"), edges(1).alias("b"))
    rows = rows.select("ck", "tk", "l", "levels", F.explode(runs).alias("run"))
    return rows.select("ck", "tk", at(F.col("run.a")).alias("level"), F.transform(F.slice("l", F.col("run.a") + 1, F.col("run.b") - F.col("run.a") + 1), lambda x: x["norm"]).alias("lines"))


def _units(passages: DataFrame) -> DataFrame:
    """(ck, tk, level, passage, whole, n, h1, h2): each distinct passage of a message and level as a whole, and its distinct lines."""
    text = F.array_join("lines", " ")
    each = F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(False).alias("whole"), F.lit(1).alias("n"), x.alias("text")))
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.size(F.array_distinct("lines")).alias("n"), text.alias("text"))), each)
    rows = passages.select("ck", "tk", "level", F.xxhash64(text).alias("passage"), F.explode(units).alias("u"))
    return rows.select("ck", "tk", "level", "passage", "u.whole", "u.n", F.xxhash64("u.whole", "u.text").alias("h1"), F.xxhash64(F.lit(29), "u.text").alias("h2"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Reply links of ``messages`` (conv_id, turn, role, text).

    Returns one row for each row: conv_id, turn, role, reply (without
    quotes), n_quoted (quoted lines), n_linked (quoted lines of any level
    with an original), parent_turn (null if none), depth and path (turns from the
    first message of the thread).  Rows that repeat a conv_id and turn are one
    message to the links.  A null text has an empty reply; null ids and turns
    are values of their own, before all others, and ``null`` in a path.  Columns
    of other names are dropped.
    """
    parsed = _parsed(messages)
    units = _units(_passages(parsed))
    quoted = units.where("level > 0").distinct()
    # the earliest message with the unit at each level: one row for each, so no group is multiplied
    first = units.groupBy("ck", "h1", "h2", F.col("level").alias("of_level")).agg(F.min("tk").alias("from_tk"))
    above = first.withColumn("level", F.col("of_level") + 1)
    linked = quoted.join(above, ["ck", "h1", "h2", "level"]).where("from_tk < tk")
    # a passage that is linked as a whole stands for its lines
    found = linked.groupBy("ck", "tk", "level", "passage").agg(F.max(F.when(F.col("whole"), F.struct("from_tk", "n"))).alias("all"), F.collect_list(F.when(~F.col("whole"), F.struct("from_tk", "n"))).alias("some"))
    found = found.select("ck", "tk", "level", F.explode(F.when(F.col("all").isNotNull(), F.array("all")).otherwise(F.col("some"))).alias("v"))
    votes = found.groupBy("ck", "tk", "level", "v.from_tk").agg(F.sum("v.n").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("nearest"), "n", "from_tk")).alias("best")
    parent = votes.groupBy("ck", "tk").agg(best, F.sum("n").alias("n_linked")).select("ck", "tk", F.col("best.from_tk").alias("parent"), "n_linked")
    parent = written(parent, "quote-links")
    paths = _paths(parent)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["announces"])
    reply = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s*\n|\s+$", "")
    out = parsed.join(paths, ["ck", "tk"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        reply.alias("reply"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.when(F.col("parent") != NULL_KEY, F.col("parent")).alias("parent_turn"),
        F.coalesce(F.size("path") - 1, F.lit(0)).cast("long").alias("depth"),
        F.array_join(F.transform(F.coalesce("path", F.array("tk")), lambda t: F.when(t == NULL_KEY, "null").otherwise(F.format_string("%08d", t))), "/").alias("path"),
    )


def _paths(parent: DataFrame) -> DataFrame:
    """(ck, tk, parent, n_linked, path) of the messages with a parent; paths double in length each round."""
    paths = parent.select("ck", "tk", "parent", "n_linked", F.col("parent").alias("top"), F.array("parent", "tk").alias("path"))
    while not parent.isEmpty():
        up = paths.select("ck", F.col("tk").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"))
        joined = paths.join(up, ["ck", "top"], "left")
        if joined.where("next is not null").isEmpty():
            break
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("above", F.slice("path", 2, 1 << 30)))
        paths = written(joined.select("ck", "tk", "parent", "n_linked", F.coalesce("next", "top").alias("top"), path.alias("path")), "quote-paths")
    return paths.drop("top")
