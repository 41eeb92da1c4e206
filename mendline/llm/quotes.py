"""Quotation linking: quoted passages are joined to the messages they come from, by DataFrame functions only.

A line's level is the number of ``>`` it starts with (blanks and tabs between them do not count). A block
is a run of lines of one level without a blank line. Its key is a digest of the block with runs of
blanks as one space, trimmed, and A-Z in lower case, so other wrapping or indentation does not matter.

The origin of a quoted block is the first message of the same conversation that has an equal block of its
own (level 0); it counts if it comes before the quoting message. A message answers the origin of its
shallowest linked quote, and of several the latest. Origins are found by one aggregation
(``min``) and one join many-to-one, so neither a huge conversation nor a passage that everybody quotes pairs
up rows. Roots and depths of the reply chains come from pointer jumping, in logarithmically many joins.

The result has one row per message: ``conv_id, turn, role, body`` (the text without quotes and without the
line that introduces one), ``n_quotes, n_linked, max_level, parent_turn, root_turn, depth``, dealt out by range and sorted by
conversation, root, turn: the order of replies, for a conversation of any size.

Edge cases: a NULL or empty text has an empty body. A NULL conversation or turn links to nothing and nothing to it. Repeated
messages give repeated rows; an origin is a turn, so ties between its copies do not matter.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import count_of, stored

#: What introduces a quote, at the end of a line that stands before it.
INTRODUCES = "(wrote|writes|schrieb|écrit|escribió) ?:$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds ``lines``: level and rest of each line."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    mark = lambda line: F.regexp_extract(line, "^[> \t]*", 0)
    line = lambda x: F.struct(
        F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"),
        F.when(F.contains(mark(x), F.lit(">")), F.substr(x, F.length(mark(x)) + 1)).otherwise(x).alias("rest"),
    )
    return messages.select("conv_id", "turn", "role", F.transform(F.split(plain, "\n", -1), line).alias("lines"))


def _blocks(parsed: DataFrame) -> DataFrame:
    """Adds ``blocks`` (level, key) and ``body``."""
    at = lambda i: F.element_at("lines", i)
    n = F.size("lines")
    blank = lambda i: F.trim(at(i)["rest"], F.lit(" \t")) == ""
    begins = lambda i: ~blank(i) & ((i == 1) | F.when(i > 1, blank(i - 1) | (at(i - 1)["level"] != at(i)["level"])))
    ends = lambda i: ~blank(i) & ((i == n) | F.when(i < n, blank(i + 1) | (at(i + 1)["level"] != at(i)["level"])))
    every = F.sequence(F.lit(1), n)
    said = lambda i: (at(i)["level"] == 0) & ~(
        F.coalesce(F.when(i < n, at(i + 1)["level"] > 0), F.lit(False)) & at(i)["rest"].rlike(INTRODUCES)
    )
    own = F.transform(F.filter(every, said), lambda i: at(i)["rest"])
    cut = parsed.select(
        "conv_id", "turn", "role", "lines",
        F.filter(every, begins).alias("starts"),
        F.filter(every, ends).alias("ends"),
        F.trim(F.concat_ws("\n", own), F.lit("\n")).alias("body"),
    )
    rest = lambda a, b: F.concat_ws(" ", F.transform(F.slice("lines", a, b - a + 1), lambda x: x["rest"]))
    block = lambda a, b: F.struct(at(a)["level"].alias("level"), _key(rest(a, b)).alias("key"))
    return cut.select(
        "conv_id", "turn", "role", "body",
        F.transform(F.arrays_zip("starts", "ends"), lambda x: block(x["starts"], x["ends"])).alias("blocks"),
    )


def _key(text: Column) -> Column:
    return F.sha2(F.translate(F.trim(F.regexp_replace(text, "[ \t]+", " ")), _UPPER, _LOWER), 256)


def reply_order(messages: DataFrame) -> DataFrame:
    """Messages without quotes, with what they answer, in the order of replies."""
    cut = stored(_blocks(_parsed(messages)), "quoted-blocks")  # else each use would parse anew
    quoted = lambda x: x["level"] > 0
    each = cut.select("conv_id", "turn", F.explode("blocks").alias("block")).select("conv_id", "turn", "block.*")
    quotes = each.where("level > 0").distinct()
    origins = each.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    linked = quotes.join(origins, ["conv_id", "key"]).where("origin < turn")
    answers = stored(
        linked.groupBy("conv_id", "turn").agg(
            F.max(F.struct((-F.col("level")).alias("near"), "origin")).alias("best"), F.count("*").alias("n_linked")
        ).select("conv_id", "turn", F.col("best.origin").alias("parent_turn"), "n_linked"),
        "answers",
    )
    chains = _chains(answers)
    rows = cut.join(answers.join(chains, ["conv_id", "turn"]), ["conv_id", "turn"], "left")
    ordered = rows.select(
        "conv_id", "turn", "role", "body",
        F.size(F.filter("blocks", quoted)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("blocks", lambda x: x["level"])), F.lit(0)).cast("bigint").alias("max_level"),
        "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    )
    order = ["conv_id", "root_turn", "turn"]
    return ordered.repartitionByRange(*order).sortWithinPartitions(*order)


def _chains(answers: DataFrame) -> DataFrame:
    """``conv_id, turn, root_turn, depth`` of every message that answers another."""
    steps = answers.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("bigint").alias("depth"))
    while True:
        above = steps.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        joined = steps.join(above, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved"),
        )
        joined = stored(joined, "chains")
        (moved,) = count_of(joined, F.count_if("moved"))
        steps = joined.drop("moved")
        if not moved:
            return steps
