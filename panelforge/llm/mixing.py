"""Mixing sources to target weights, with a multivariate-hypergeometric splitting tree over output shards.

Each source is cut into blocks of about ``block_words`` words by a hash of its rows, and its blocks are put into a hashed order, its
permutation. A source whose target is e whole passes and a rest takes every block e times, and the first blocks of its
permutation once more until the rest is met; of the block at the border whole documents are taken in hashed order, and the
first words of one last document, so the words taken equal the target rounded down. The draws of a source are numbered along
its permutation, pass after pass. The tree starts with the draws of each source at its root and gives each half of its
shards a multivariate-hypergeometric share of every source, until each shard has its exact quota per source. A shard takes
the next draws of each source, so draws are disjoint, and orders its documents by a hash.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all sources; a target
stops at ``most`` times its source's size, and the excess is shared by weight among the others until none is above.

Only DataFrame operations. Texts are read once for their size; what is shuffled is ids, sizes and quotas. Windows run over one row per
source, and over one row per block of a source. Null texts have size 0; rows of size 0 take nothing. Rows that repeat are
separate documents. Every hash has a fixed seed, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import stored

MOST = 3
BLOCK_WORDS = 65_536
SHARD_BLOCKS = 64
#: Half width of the inversion sampler, in standard deviations; the mass beyond is under 1e-30.
SPREAD = 12.0


def _size_and_hash(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Words of the text, and the hash that orders the rows of a source."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(17), F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.length(text_col))
    return [words.alias("size"), key.alias("h")]


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target): the capped shares, by the level at which all words are placed.

    A source is capped if most * size / weight is at most the level; sorted by that ratio, the level that leaves
    the first k sources capped is (all words - their caps) / (the weights of the others).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    placed = (
        weighed.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
        .withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    )
    # The level if all sources before this one are capped; the first source that it leaves under its cap settles it.
    level = placed.withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
    settled = level.withColumn("final", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return settled.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total`` things are among the ``marked`` ones: exact inversion around the mode.

    Probabilities relative to the mode follow from ratios of neighbours, so no factorials are needed.
    """
    given = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("m"), u.alias("u"))

    def ranged(g: Column) -> Column:
        n, k, m = g["n"], g["k"], g["m"]
        variance = m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))
        return _let(F.struct(
            F.greatest(F.lit(0.0), m + k - n).alias("low"), F.least(k, m).alias("high"), F.floor((m + 1) * (k + 1) / (n + 2)).cast("double").alias("mode"),
            (F.ceil(F.lit(SPREAD) * F.sqrt(F.greatest(F.lit(0.0), variance))) + 4).alias("reach")), lambda r: centred(g, r))

    def centred(g: Column, r: Column) -> Column:
        mode = F.greatest(r["low"], F.least(r["high"], r["mode"]))
        drawn = _let(F.struct(mode.alias("mode"), F.greatest(r["low"], mode - r["reach"]).alias("first"), F.least(r["high"], mode + r["reach"]).alias("last")), lambda v: picked(g, v))
        return F.when(r["low"] >= r["high"], r["low"]).otherwise(drawn)

    def picked(g: Column, v: Column) -> Column:
        # Walking out from the mode, a state holds p relative to the mode, the sum of all p passed, and the pick.
        n, k, m = g["n"], g["k"], g["m"]
        up, down = _steps(v["mode"] + 1, v["last"]), F.reverse(_steps(v["first"], v["mode"] - 1))
        higher = lambda p, x: p * (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))  # noqa: E731  p(x) from p(x - 1)
        lower = lambda p, x: p * (x + 1) * (n - k - m + x + 1) / ((k - x) * (m - x))  # noqa: E731  p(x) from p(x + 1)
        sums = F.struct(_walk(up, higher)["sum"].alias("above"), _walk(down, lower)["sum"].alias("below"))
        return _let(sums, lambda w: _let(g["u"] * (F.lit(1.0) + w["above"] + w["below"]), lambda aim: (
            F.when(aim <= 1, v["mode"])
            .when(aim <= 1 + w["above"], F.coalesce(_walk(up, higher, aim - 1)["x"], v["last"]))
            .otherwise(F.coalesce(_walk(down, lower, aim - 1 - w["above"])["x"], v["first"])))))

    return _let(given, ranged).cast("long")


def _steps(a: Column, b: Column) -> Column:
    return F.when(a <= b, F.sequence(a.cast("long"), F.greatest(a, b).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _walk(steps: Column, p_of: Callable[[Column, Column], Column], aim: Column | None = None) -> Column:
    aim = F.lit(float("inf")) if aim is None else aim
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("x"))

    def step(s: Column, i: Column) -> Column:
        return _let(p_of(s["p"], i.cast("double")), lambda p: F.struct(
            p.alias("p"), (s["sum"] + p).alias("sum"), F.when(s["x"].isNull() & (s["sum"] + p >= aim), i.cast("double")).otherwise(s["x"]).alias("x")))

    return F.aggregate(steps, start, step)


def split(quotas: Column, draws: Column, *seed: Column) -> Column:
    """Multivariate-hypergeometric counts: of ``draws`` from all the ``quotas`` (array of long), how many each gets."""
    def step(s: Column, q: Column) -> Column:
        got = F.when((q > 0) & (s["draws"] > 0), hypergeometric(s["left"], q, s["draws"], _uniform(*seed, F.size(s["out"])))).otherwise(F.lit(0).cast("long"))
        return _let(got, lambda x: F.struct((s["left"] - q).alias("left"), (s["draws"] - x).alias("draws"), F.concat(s["out"], F.array(x)).alias("out")))

    start = F.struct(F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("left"), draws.cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(quotas, start, step)["out"]


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """(shard, i, n): how many draws of the i-th quota each shard gets. ``quotas`` is one row with an array ``q``.

    Each level is a small table of its own: nodes are at most the shards, a node has one number per source.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.lit(0).alias("first"), F.lit(shards).alias("wide"), "q")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        half = F.floor((F.col("wide") + 1) / 2).cast("int")
        every = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        left = split(F.col("q"), F.floor(every * half / F.col("wide")), F.lit(29), F.col("node"))
        cut = nodes.withColumn("half", half).withColumn("cut", F.when(F.col("wide") > 1, _let(left, lambda x: F.array(x, F.zip_with("q", x, lambda p, r: p - r)))).otherwise(F.array("q")))
        child = cut.select("node", "first", "wide", "half", F.posexplode("cut").alias("side", "q"))
        lone = F.col("wide") == 1
        nodes = stored(child.select(
            F.when(lone, F.col("node")).otherwise(2 * F.col("node") + 1 + F.col("side")).alias("node"), (F.col("first") + F.col("side") * F.col("half")).alias("first"),
            F.when(lone, F.lit(1)).when(F.col("side") == 0, F.col("half")).otherwise(F.col("wide") - F.col("half")).alias("wide"), "q"))
    return nodes.select(F.col("first").alias("shard"), F.posexplode("q").alias("i", "n")).where("n > 0")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) per row, with the columns ``carry`` in a struct ``row`` if any.

    ``draws`` lists (shard, pass, words, place): the output shard, the pass over the source, the words taken from the start of the text,
    and the hash by which the shard orders its documents.
    """
    kept = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), *_size_and_hash(id_col, text_col, source_col), *kept)
    if not carry:
        rows = stored(rows)  # narrow; with texts beside it, reading them again is cheaper than storing them
    narrow = stored(rows.groupBy("source", F.pmod("h", F.lit(1 << 20)).alias("slot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    # One row per source, in order of its name; blocks by the top of the slot range.
    wanted = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = stored(targets(narrow, most).withColumn("si", F.row_number().over(order) - 1).withColumn("wanted", wanted))
    block = F.floor(F.pmod("h", F.lit(1 << 20)) * F.col("wanted") / F.lit(1 << 20)).alias("block")
    same = lambda left: left["source"].eqNullSafe(sources["source"])
    beside = F.broadcast(sources) if sources.count() <= 10_000 else sources
    in_order = Window.partitionBy("si").orderBy(F.col("words") == 0, F.xxhash64(F.lit(5), "si", "block"), "block")
    own = Window.partitionBy("si")
    blocks = (
        narrow.join(beside, same(narrow)).select("si", narrow["size"], F.floor(F.col("slot") * F.col("wanted") / F.lit(1 << 20)).alias("block"), "source_size", "target")
        .groupBy("si", "block", "source_size", "target").agg(F.sum("size").alias("words"))
        .withColumn("p", F.row_number().over(in_order) - 1).withColumn("b", F.count(F.lit(1)).over(own))
        .withColumn("end", F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
        # Words that the last, partial pass takes of this block.
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - (F.col("end") - F.col("words")))))
    )
    blocks = stored(blocks.select("si", "block", "p", "b", "words", "whole", "last"))
    quota = blocks.groupBy("si").agg((F.sum("whole") + F.sum((F.col("last") > 0).cast("long"))).cast("long").alias("q"))
    row = quota.agg(F.transform(F.sort_array(F.collect_list(F.struct("si", "q"))), lambda x: x["q"]).alias("q"))  # one entry per source
    total = quota.agg(F.sum("q")).first()[0] or 0
    per_shard = splitting_tree(row, max(1, math.ceil(total / shard_blocks)))
    along = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = per_shard.withColumn("from", F.coalesce(F.sum("n").over(along), F.lit(0))).select(
        F.col("i").alias("si"), "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("d"))
    counts = blocks.groupBy("si").agg(F.max("b").alias("b"))
    # Draw d is block d mod b of the permutation in pass d div b; those of a last pass are the first ones.
    placed = drawn.join(counts, "si").select("si", "shard", F.expr("d div b").alias("pass"), F.expr("d % b").cast("int").alias("p"))
    found = placed.groupBy("si", "p").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("at"))  # at most one per pass
    plan = blocks.join(found, ["si", "p"], "left").select("si", "block", "whole", "last", "at")
    inside = Window.partitionBy("si", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = rows.join(beside, same(rows)).select("doc_id", rows["source"], "size", "h", "source_size", "target", "si", block, *(["row"] if carry else []))
    whole = placed_rows.join(plan, ["si", "block"]).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("last") - F.col("before")))
    draws = F.transform(F.coalesce("at", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda a: F.struct(
        a["shard"].alias("shard"), a["pass"].alias("pass"), F.when(a["pass"] < F.col("whole"), F.col("size")).otherwise(part).cast("long").alias("words"),
        F.xxhash64(F.lit(11), a["shard"], a["pass"], F.col("h"), F.col("doc_id")).alias("place")))
    out = whole.withColumn("draws", F.filter(draws, lambda x: x["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", *(["row"] if carry else []))


def shards(mixed: DataFrame) -> DataFrame:
    """One row per draw, dealt to its shard and sorted there by ``place``; for writing, ``partitionBy("shard")``."""
    rest = [c for c in mixed.columns if c != "draws"]
    return mixed.select(*rest, F.explode("draws").alias("d")).select(*rest, "d.*").repartition("shard").sortWithinPartitions("shard", "place")
