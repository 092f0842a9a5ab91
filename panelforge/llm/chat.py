"""Chat formatting: collapse logged snapshots of the same conversation, then render the maximal ones.

A chat log often holds a conversation many times, each time with more turns. The turns of a conversation are put in order and get a rolling hash:
the hash after a turn sums one 64-bit hash per (turn number, role, text) so far, in two halves that cannot overflow. A conversation whose whole
hash is the hash of a shorter prefix of some other one is a snapshot and goes (anti-join); of equal conversations the one with the smallest id
stays. What stays is rendered.

The turns of a conversation are numbered by their place in it, in blocks of ``BLOCK`` places, whatever their turn numbers are: rows without
an id, or with one number for all turns, are cut like any others. A conversation too long for one task is placed piecewise (``ordered.running``: a
range shuffle, and one summary row per piece), since sums can be taken in pieces. Each block is rendered as one part, so no row holds more than ``BLOCK`` texts;
concatenated by ``part`` the parts of a conversation are its text. Repeated rows and shared prefixes are aggregated before the shuffle, so a turn that opens
a third of all conversations is one row per task. All but the last two steps handle hashes only.

Only DataFrame operations. Rows repeated within a conversation (same turn, role and text) are one turn. Turns with the same number are ordered by their
hash; turns without a number come first. All rows with a null id are one conversation of its own. An empty log gives no rows. A null role is rendered as "unknown", a null text as empty,
and both differ from the empty string in comparisons. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import stored
from panelforge.operators.ordered import lookup, running

#: Turns of a part.
BLOCK = 256


def _turns(log: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, h, role, text); c wraps the id in a struct, so that a null id compares equal to itself. h is the hash of all the rest, in hexadecimal digits."""
    turn, role, text = F.col(turn_col).cast("long"), F.col(role_col).cast("string"), F.col(text_col).cast("string")
    written = F.concat(
        F.coalesce(turn.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.length(role).cast("string"), F.lit(":"), role), F.lit("-")), F.lit("|"),
        F.coalesce(F.concat(F.lit("t"), text), F.lit("-")))
    return log.select(
        F.struct(F.col(conv_col).alias("id")).alias("c"), turn.alias("turn"), F.substring(F.md5(written), 1, 16).alias("h"), role.alias("role"), text.alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, h, n, lo, hi): the place of each turn and the rolling hash after it."""
    narrow = stored(turns.select("c", "turn", "h").distinct())
    half = lambda at: F.conv(F.substring("h", at, 8), 16, 10).cast("long")
    totals = {"n": ("sum", F.lit(1)), "lo": ("sum", half(9)), "hi": ("sum", half(1))}
    return running(narrow, totals, ["c"], ["turn", "h"]).select("c", "h", "n", "lo", "hi")


def maximal(rolled: DataFrame) -> DataFrame:
    """(c, total, copies) of the conversations that stay."""
    state = ["n", "lo", "hi"]
    # Equal conversations become one row before they meet the prefixes.
    whole = rolled.groupBy("c").agg(F.max(F.struct(*state)).alias("end")).select("c", "end.*")
    ends = whole.groupBy(*state).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("copies"))
    # A state that more conversations pass through than end with is a prefix of a longer one.
    passing = rolled.groupBy(*[F.col(x).alias(f"{x}_") for x in state]).agg(F.count(F.lit(1)).alias("through"))
    longer = (F.col("n") == F.col("n_")) & (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_")) & (F.col("through") > F.col("copies"))
    return ends.join(passing, longer, "left_anti").select("c", F.col("n").alias("total"), "copies")


def render(turns: DataFrame, places: DataFrame) -> DataFrame:
    """One row per part: the turns of a block, each as <|im_start|>role, a newline, its text, <|im_end|> and a newline."""
    said = turns.groupBy("c", "h").agg(F.first(F.struct("role", "text")).alias("said"))
    joined = places.join(said, ["c", "h"]).withColumn("part", F.floor((F.col("n") - 1) / BLOCK))
    parts = joined.groupBy("c", "part").agg(
        F.first("total").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("n", "said.role", "said.text"))).alias("all"))
    text = F.concat_ws("", F.transform("all", lambda x: F.concat(
        F.lit("<|im_start|>"), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit("<|im_end|>\n"))))
    return parts.select(F.col("c.id").alias("conv_id"), "part", "n_turns", "copies", F.size("all").cast("long").alias("part_turns"), text.alias("text"))


def format_chats(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, copies, part_turns, text) of every maximal conversation; ``copies`` counts the equal ones."""
    turns = _turns(log, conv_col, turn_col, role_col, text_col)
    rolled = stored(prefixes(turns))
    kept = stored(maximal(rolled))
    return render(turns, lookup(rolled.select("c", "h", "n"), kept, ["c"], "inner"))
