"""Merkle manifest of a table: a digest per row, a root for all, and a proof for each row that leads from one to the other.

Rows are leaves, ordered within their tree; every ``FAN`` consecutive nodes (the last run may be shorter, even a single one) are
hashed to their parent until one node is left. Trees by group come first, and their roots are the leaves of one last tree.

Going up, each level is one window over the runs: leads at fixed offsets, masked by slot and run length, give a first child its younger
siblings, and the first children's rows become the parents. Going down, lags and leads give every node its siblings on both
sides, and a join by run hands it the siblings of its ancestors. A path of a leaf is therefore its (left, right) siblings level by level,
and each level but the lowest is an eighth of the one below it. A group that holds most rows is spread like any other: places come from ranges of the order and windows hold one run each.

Nulls in any column are written as ``-``; a null group is a tree of its own, the first. Rows that share an id are ordered by their
leaf, so repeated rows give the same result in any order. An empty table gives an empty manifest. Texts of any length are hashed as columns. Columns beyond the named ones, clashing names included, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import remainder, stored

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


def placed(leaves: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (from 0) and ``n`` (rows of the tree). Each range of the order is numbered by itself, so no tree is sorted in one task."""
    ranged = stored(leaves.repartitionByRange(tree, *order).withColumn("_part", F.spark_partition_id()))
    along = Window.partitionBy(tree).orderBy("_part")
    # One row per tree and range.
    starts = ranged.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_rows")).select(
        tree, "_part", (F.sum("_rows").over(along) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(tree)).alias("n"))
    inside = Window.partitionBy(tree, "_part").orderBy(*order)
    return ranged.withColumn("_row", F.row_number().over(inside)).join(starts, [tree, "_part"]).withColumn(
        "pos", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def _runs(nodes: DataFrame) -> DataFrame:
    """Add the place of a node's run, its slot in it and the run's length."""
    return nodes.withColumn("run", F.floor(F.col("pos") / FAN)).withColumn("slot", (F.col("pos") % FAN).cast("int")).withColumn(
        "length", F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN))


def _siblings(column: str) -> tuple[Column, Column]:
    """Digests of the siblings before and after a node, each as one string."""
    run = Window.partitionBy("tree", "run").orderBy("pos")
    before = [F.when(F.col("slot") >= k, F.lag(column, k).over(run)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < F.col("length"), F.lead(column, k).over(run)) for k in range(1, FAN)]
    return F.concat_ws("", *before), F.concat_ws("", *after)


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: one row per run, made of its first child's row."""
    with_rest = _runs(nodes).withColumn("_after", _siblings("digest")[1]).where("slot = 0")
    return with_rest.select(
        "tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.sha2(F.concat("digest", "_after"), 256).alias("digest"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """All levels of all trees, lowest first. A tree ends with the level on which it has one node."""
    found = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        found.append(stored(parents(found[-1].where("n > 1").select("tree", "pos", "n", "digest"))))
        largest = -(-largest // FAN)
    return found


def tops(found: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's last node."""
    each = [level.where("n = 1").select("tree", "digest") for level in found]
    out = each[0]
    for level in each[1:]:
        out = out.unionByName(level)
    return out


def paths(found: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf with ``path``, the (left, right) siblings from its own level up. ``above`` has for each tree the path that goes on from its top.

    Columns of ``above`` but ``tree`` and ``path`` are handed down too.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    below: DataFrame | None = None
    for level in reversed(found):
        top = level.where("n = 1").join(above, "tree")
        if below is None:
            below = top
            continue
        up = below.select("tree", F.col("pos").alias("run"), F.col("path").alias("_path"), *carried)
        left, right = _siblings("digest")
        inner = _runs(level.where("n > 1")).join(up, ["tree", "run"]).withColumn("_left", left).withColumn("_right", right)
        inner = inner.withColumn("path", F.concat(F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))), "_path"))
        below = inner.drop("run", "slot", "length", "_left", "_right", "_path").unionByName(top)
    return below


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def tree_key(group: str) -> Column:
    """Group values as strings that are never null and order with null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", check: dict[str, Column] | None = None
) -> DataFrame:
    """(id, leaf, subroot, root, path, checked): the proof of each row. ``check`` gives other values of columns whose leaf is ``checked``."""
    changed = [(check or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(F.col(id_col).alias("id"), tree_key(group_col).alias("tree"), leaf_digest([F.col(c) for c in columns]).alias("digest"),
                       leaf_digest(changed).alias("checked"))
    # Written once: the leaves of the going up and of the going down are the same rows.
    leaves = stored(placed(rows, "tree", ["id", "digest", "checked"]))
    own = levels(leaves)
    subroots = stored(tops(own).select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"))
    groups = placed(subroots, "tree", ["group"])
    upper = levels(stored(groups))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    above = paths(upper, tops(upper).select("tree", F.col("digest").alias("root"), empty.alias("path")))
    above = stored(above.select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    found = paths(own, above)
    return found.select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", "checked")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))), 256)


def tampered(text_col: str, id_col: str, parts: int = 3) -> Column:
    """The text, its capitals A-Z lowered in rows whose id's checksum is divisible by ``parts``; null ids count as the empty text."""
    return F.when(remainder(id_col, parts) == 0, F.translate(F.col(text_col), _UPPER, _LOWER)).otherwise(F.col(text_col))


def verify(found: DataFrame) -> DataFrame:
    """Add ``folded_root``, to which the checked leaf leads, and ``verified``."""
    return found.withColumn("folded_root", folded(F.col("checked"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
