"""Preference formatting: one prompt and two masked completions per pair of conversations.

The prompt is the longest common prefix of turns (equal role and text) of a chosen and a
rejected conversation, rendered once; the turns after it are the completions. A completion is
a list of segments, of which only the assistant's text and its end mark bear loss.

Pairs come from a table of preferences, from conversations that begin alike (``alike_pairs``), or
from every conversation and a branch of it (``branch_sides``): the branch answers as another
conversation does in the place of the last answer.

Native: DataFrame functions only. Prefixes are found by joining turns on their place, so a
conversation is gathered only to be rendered, as one row of the result.

Defined results: turns are read in order of ``turn``, then role, then text, with nulls first
and repeated rows as turns of their own; a null role or text counts as empty; a pair without
common turns has an empty prompt; equal conversations have empty completions; a conversation
without a partner has no pair; a null ``conv_id`` is a conversation of its own; an empty table
gives no rows. A conversation without an answer has no branch, and where all last answers are
equal there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import ranked, same
from tallypanel.session import materialize

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"


def _key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(role, F.lit("\n"), text))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, key`` with places from 0 and a key of role and text."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = ranked(rows, ["turn", "role", "text"], ["conv_id"], "place")
    return rows.select("conv_id", "place", "role", "text", _key(F.col("role"), F.col("text")).alias("key"))


def alike_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected``: conversations with equal first turns, two by two in the order
    of their turns' keys, so that within such a group those that go on alike meet. Of two the one
    with more turns is chosen, of equals the one with the smaller id; one of an odd group is left
    out. Groups are ranked over parts, so one may hold any share of the table."""
    keys = F.array_sort(F.collect_list(F.struct("place", "key")))
    path = F.array_join(F.transform(keys, lambda t: t["key"]), "")
    convs = turns.groupBy("conv_id").agg(path.alias("path"), F.count("*").alias("turns"))
    convs = ranked(convs.withColumn("first", F.left("path", F.lit(32))), ["path", "conv_id"], ["first"], "at")
    pairs = convs.withColumn("pair", F.floor(F.col("at") / 2)).withColumn(
        "preference", F.struct(-F.col("turns"), "conv_id")
    )
    both = pairs.groupBy("first", "pair").agg(
        F.min("preference").alias("best"), F.max("preference").alias("worst"), F.count("*").alias("n")
    )
    both = ranked(both.where("n = 2").drop("n"), ["first", "pair"], out="pair_id")
    return both.select("pair_id", F.col("best.conv_id").alias("chosen"), F.col("worst.conv_id").alias("rejected"))


def branch_sides(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pair_id, chosen, rejected`` and the turns of both sides, from every conversation with an
    answer. Chosen is the conversation up to its last answer; in the rejected branch that answer is
    replaced by the next one in the order of their checksums, given by the conversation
    ``rejected`` (the smallest id). ``pair_id`` counts conversations in order of id."""
    answers = turns.where(F.col("role") == LOSS_ROLE).groupBy("conv_id").agg(
        F.max_by(F.struct("place", "text", F.md5("text").alias("mark")), "place").alias("last")
    )
    answers = answers.select("conv_id", "last.*")
    distinct = answers.groupBy("mark").agg(F.min("conv_id").alias("giver"), F.any_value("text").alias("text"))
    distinct = materialize(ranked(distinct, ["mark"], out="n"), "answers")
    many = distinct.count()
    if many < 2:
        distinct = distinct.limit(0)
    onward = distinct.select("mark", F.pmod(F.col("n") + 1, F.lit(max(1, many))).alias("n"))
    others = onward.join(distinct.select("n", "giver", "text", F.md5("text").alias("other")), "n").drop("n")
    # Only checksums and places meet; one answer may be that of a third of all conversations.
    met = answers.select("conv_id", "place", "mark").join(others.hint("merge"), "mark")
    met = ranked(met, ["conv_id"], out="pair_id")
    met = materialize(met.withColumnRenamed("text", "instead").withColumnRenamed("place", "last"), "branches")
    pairs = met.select("pair_id", F.col("conv_id").alias("chosen"), F.col("giver").alias("rejected"))
    told = turns.alias("t").join(met.alias("m"), same("t", "m", ["conv_id"])).where("t.place <= m.last")
    columns = ["m.pair_id", "t.place", "t.role"]
    chosen = told.select(*columns, "t.text", "t.key", F.lit(True).alias("is_chosen"))
    at_last = F.col("t.place") == F.col("m.last")
    text = F.when(at_last, F.col("m.instead")).otherwise(F.col("t.text"))
    branch = told.select(*columns, text.alias("text"), _key(F.col("t.role"), text).alias("key"), F.lit(False).alias("is_chosen"))
    return pairs, chosen.unionByName(branch)


def _rendered(turn: Column) -> Column:
    return F.concat(F.format_string(OPEN.replace("{role}", "%s"), turn["role"]), turn["text"], F.lit(CLOSE))


def _segments(turns: Column) -> Column:
    """``text, loss`` pieces: the role's mark without loss, the assistant's words with it."""

    def of(turn: Column) -> Column:
        mark = F.format_string(OPEN.replace("{role}", "%s"), turn["role"])
        words = F.concat(turn["text"], F.lit(CLOSE))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(words.alias("text"), (turn["role"] == LOSS_ROLE).alias("loss")),
        )

    return F.flatten(F.transform(turns, of))


def format_pairs(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``pair_id, chosen, rejected, prefix_turns, prompt`` and, for both completions, their
    text, segments and number of characters that bear loss.

    ``pairs`` holds ``pair_id, chosen, rejected``; without it ``alike_pairs`` is used.
    """
    turns = materialize(placed_turns(conversations), "turns")
    pairs = alike_pairs(turns) if pairs is None else pairs.select("pair_id", "chosen", "rejected")
    pairs = materialize(pairs, "pairs")
    sides = pairs.select("pair_id", F.lit(True).alias("is_chosen"), F.col("chosen").alias("conv_id")).unionByName(
        pairs.select("pair_id", F.lit(False).alias("is_chosen"), F.col("rejected").alias("conv_id"))
    )
    told = sides.alias("s").join(turns.alias("t"), same("s", "t", ["conv_id"])).select(
        "s.pair_id", "s.is_chosen", "t.place", "t.role", "t.text", "t.key"
    )
    return format_sides(pairs, told)


def format_branches(conversations: DataFrame) -> DataFrame:
    """``format_pairs`` of every conversation and its branch (``branch_sides``)."""
    return format_sides(*branch_sides(materialize(placed_turns(conversations), "turns")))


def format_sides(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """The formatted ``pairs`` from the turns of their sides, ``pair_id, is_chosen, place, role,
    text, key``."""
    # A place where the two sides differ, or where one has ended, ends the prefix.
    by_place = told.groupBy("pair_id", "place").agg(
        F.max(F.when(F.col("is_chosen"), F.col("key"))).alias("c"), F.max(F.when(~F.col("is_chosen"), F.col("key"))).alias("r")
    )
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    ends = by_place.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("place"))), F.max("place") + 1).alias("prefix_turns")
    )
    marked = told.join(ends, "pair_id")
    turn = F.struct("place", "role", "text")
    own = F.col("place") >= F.col("prefix_turns")
    parts = {
        "prompt": F.col("is_chosen") & ~own,
        "chosen_turns": F.col("is_chosen") & own,
        "rejected_turns": ~F.col("is_chosen") & own,
    }
    gathered = marked.groupBy("pair_id", "prefix_turns").agg(
        *[F.array_sort(F.collect_list(F.when(rule, turn))).alias(name) for name, rule in parts.items()]
    )
    out = pairs.join(gathered, "pair_id", "left")
    nothing = F.array().cast("array<struct<place:bigint,role:string,text:string>>")
    columns = {"prefix_turns": F.coalesce("prefix_turns", F.lit(0)).cast("long")}
    columns["prompt"] = F.array_join(F.transform(F.coalesce("prompt", nothing), _rendered), "")
    for side in ("chosen", "rejected"):
        segments = _segments(F.coalesce(f"{side}_turns", nothing))
        columns[f"{side}_segments"] = segments
        columns[f"{side}_text"] = F.array_join(F.transform(segments, lambda s: s["text"]), "")
        columns[f"{side}_loss_chars"] = F.aggregate(
            segments, F.lit(0).cast("long"), lambda n, s: n + F.when(s["loss"], F.length(s["text"])).otherwise(0)
        )
    return out.select("pair_id", "chosen", "rejected", *[c.alias(k) for k, c in columns.items()])
