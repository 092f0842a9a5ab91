"""Ordered work that survives a hot key.

Rolling features, running totals, as-of fills and ranks all need the rows of a
group in order. Where every group is known to be small that is a plain window
(one shuffle). A group that is too long for one task is cut into contiguous
blocks instead: rows are range-partitioned on (keys, order), the partition tag
is checkpointed, and only one summary row per (group, block) crosses block
borders. Both layouts give the same rows, null keys and repeated rows included;
the measured group size decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators import sliding, tied
from panelforge.session import ensure_checkpoint_dir, max_broadcast_rows, max_group_rows

# Range partitioning samples rows per partition on the driver, so their number stops here and blocks grow instead.
MAX_BLOCKS = 20_000
# Frames of fewer rows stay window expressions; longer ones of doubles are slid over by numpy.
SHORT_FRAME = 8
# Largest table that is sent to all tasks, by the width of its columns.
BROADCAST_BYTES = 64_000_000


@dataclass(frozen=True)
class Sizes:
    """Measured rows of a grouping: of its largest group, in all, and the number of groups."""

    largest: int
    total: int
    groups: int


_measured: dict[tuple, Sizes] = {}
_bounds: list[tuple[Callable[[], dict[tuple[str, ...], Sizes]], float]] = []


def group_sizes(df: DataFrame, keys: Sequence[str]) -> Sizes:
    """Count a grouping. It steers the layout only, never the result, so it is remembered per plan."""
    token = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(keys))
    if token not in _measured:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.max("n"), F.sum("n"), F.count("n")).first()
        _measured[token] = Sizes(row[0] or 0, row[1] or 0, row[2] or 0)
    return _measured[token]


def forget_sizes() -> None:
    _measured.clear()


@contextmanager
def bounded_by(sizes: Callable[[], dict[tuple[str, ...], Sizes]], growth: float = 4.0):
    """Name sizes, measured on first need, of the stored table that frames built inside descend from.

    A frame may hold up to ``growth`` times the rows of a group of that table.
    Groups that fit by this bound are not counted again, which would run
    everything upstream of them once more; all others still are.
    """
    _bounds.append((sizes, growth))
    try:
        yield
    finally:
        _bounds.pop()


def fits_one_task(df: DataFrame, keys: Sequence[str]) -> bool:
    limit = max_group_rows(df.sparkSession)
    for sizes, growth in reversed(_bounds):
        # Grouping by more columns never makes a group larger.
        if any(set(named) <= set(keys) and known.largest * growth <= limit for named, known in sizes().items()):
            return True
    return group_sizes(df, keys).largest <= limit


def fits_broadcast(table: DataFrame, on: Sequence[str], one_per_key: bool, row_bytes: int | None = None) -> bool:
    limit = min(max_broadcast_rows(table.sparkSession), BROADCAST_BYTES // (row_bytes or _row_bytes(table.schema)))
    if one_per_key:
        for sizes, _ in reversed(_bounds):
            known = sizes().get(tuple(sorted(on)))
            if known is not None and known.groups <= limit:
                return True
    return group_sizes(table, []).largest <= limit


def _row_bytes(schema: T.StructType) -> int:
    """Width of a row: 8 bytes a number, and a guess for what varies."""
    return sum(64 if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.StringType, T.BinaryType)) else 8 for f in schema.fields) or 1


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal values, where null equals null."""
    named = right.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)], F.lit(True))
    return left.join(named, same, how).drop(*[f"_on_{i}" for i in range(len(on))])


def _tagged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on (keys, order) and store each row's block number in ``_part``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    total = group_sizes(df, keys).total
    wanted = min(math.ceil(2 * total / max_group_rows(spark)), MAX_BLOCKS)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    ranged = df.repartitionByRange(blocks, *keys, *order).withColumn("_part", F.spark_partition_id())
    return ranged.checkpoint()


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_pos`` (0-based place in the group) and ``_size`` (rows in the group)."""
    keys, order = list(keys), list(order)
    if fits_one_task(df, keys):
        return df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1) \
            .withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_part", F.lit(0))
    parts = _tagged(df, keys, order)
    along = Window.partitionBy(*keys).orderBy("_part")
    starts = (
        parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys, "_part",
            F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("_size"),
        )
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        join_same(parts, starts, [*keys, "_part"])
        .withColumn("_pos", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before")
    )


_AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "list": F.collect_list,
}


class Frames:
    """Row-frame values of a series, each computed once however often a stage asks for it.

    The optimizer evaluates every occurrence of a window expression, so repeated
    ones are given a name here and projected before the stage's own columns.
    ``doubles`` names the columns whose long frames are made apart from the windows (``sliding``).
    """

    def __init__(self, spec: WindowSpec, known: dict[str, str], doubles: Collection[str] = (), apart: bool = False):
        self.spec, self.known, self.doubles, self.apart = spec, dict(known), doubles, apart
        self.fresh: dict[str, Column] = {}
        self.slid: dict[str, tuple[str, str, int, int | float]] = {}
        self.lags: dict[str, tuple[str, int]] = {}

    def _named(self, name: str, source: str, value: Column) -> Column:
        if name not in self.known:
            self.known[name] = source
            self.fresh[name] = value
        return F.col(name)

    def _apart(self, name: str, kind: str, x: str, n: int, end: int | float = 0) -> Column:
        if name not in self.known:
            self.known[name] = x
            self.slid[name] = (kind, x, n, end)
        return F.col(name)

    def agg(self, kind: str, x: str, n: int, end: int = 0) -> Column:
        """Aggregate of the ``n`` rows that end ``end`` rows before this one."""
        name = f"_{kind}_{n}_{end}_{x}"
        if n >= SHORT_FRAME and end >= 0 and kind in sliding.KINDS and x in self.doubles:
            return self._apart(name, kind, x, n, end)
        frame = self.spec.rowsBetween(-(n - 1) - end, -end)
        return self._named(name, x, _AGGREGATES[kind](x).over(frame))

    def top_mean(self, x: str, n: int) -> Column:
        """Mean of the five largest of the last ``n`` values."""
        if x in self.doubles:
            return self._apart(f"_top_{n}_{x}", "top", x, n)
        top = F.slice(F.sort_array(self.agg("list", x, n), asc=False), 1, sliding.TOP)
        return F.aggregate(top, F.lit(0.0), lambda a, v: a + v) / sliding.TOP

    def decayed(self, x: str, factor: float, levels: int) -> Column:
        """Sum of the last 2**levels values of a column of doubles, each counting ``factor`` times the one after it."""
        return self._apart(f"_decay_{levels}_{factor!r}_{x}".replace(".", "_"), "decay", x, levels, factor)

    def lag(self, x: str, n: int = 1) -> Column:
        name = f"_lag_{n}_{x}"
        if x not in self.doubles or n < 1:
            return self._named(name, x, F.lag(x, n).over(self.spec))
        if name not in self.known:
            self.known[name] = x
            self.lags[name] = (x, n)
        return F.col(name)

    def lead(self, x: str, n: int = 1) -> Column:
        return self._named(f"_lead_{n}_{x}", x, F.lead(x, n).over(self.spec))

    def place(self) -> Column:
        """Row number, counted from the series or block start."""
        return self._named("_place", "", F.row_number().over(self.spec))

    def add(self, df: DataFrame) -> DataFrame:
        """Add the windows' values, then those of the long frames.

        What numpy made has no known partitioning, so a window after it would shuffle and sort again: once a stage has long frames
        (``apart``), lags are taken with them.
        """
        self.apart = self.apart or bool(self.slid)
        if self.apart:
            self.slid |= {name: ("lag", x, n, 0) for name, (x, n) in self.lags.items()}
        else:
            self.fresh |= {name: F.lag(x, n).over(self.spec) for name, (x, n) in self.lags.items()}
        if self.slid:
            self.place()
        if self.fresh:
            df = df.withColumns(self.fresh)
        if not self.slid:
            return df
        sources = list(dict.fromkeys(x for _, x, *_ in self.slid.values()))
        made = sliding.frames(F.col("_place"), [F.col(x) for x in sources], [(kind, sources.index(x), n, end) for kind, x, n, end in self.slid.values()])
        return df.withColumn("_slid", made).withColumns({name: F.col("_slid").getField(f"f{i}") for i, name in enumerate(self.slid)}).drop("_slid")


Stage = Callable[[Frames], dict[str, Column]]


def over_series(
    df: DataFrame,
    stages: Sequence[Stage],
    lookback: int,
    keys: Sequence[str] = ("ticker",),
    order: Sequence[str] = ("timestamp",),
    lookahead: int = 0,
    long_apart: bool = True,
) -> DataFrame:
    """Evaluate row-frame features per series, stage after stage.

    Each stage maps ``Frames`` to named columns and may read the columns of
    earlier stages, ``_pos`` and ``_size``. ``lookback`` is the number of
    earlier rows a value can depend on over all stages, ``lookahead`` of later
    ones: long series are cut into blocks that carry that many rows of their
    neighbours, so results are the same as on the whole series. Columns named with a leading underscore are
    dropped at the end. Without ``long_apart`` all is left to windows.
    """
    keys, order = list(keys), list(order)
    small = fits_one_task(df, keys)
    out = number_rows(df, keys, order)
    spec = Window.partitionBy(*keys).orderBy(*order)
    if not small:
        length = max(max_group_rows(df.sparkSession) // 2, 2 * (lookback + lookahead), 1)
        inside = F.col("_pos") % length
        out = out.withColumn("_home", F.floor(F.col("_pos") / length)).withColumn(
            "_block",
            F.explode(F.array_compact(F.array(
                F.col("_home"),
                F.when(inside >= length - lookback, F.col("_home") + 1),
                F.when(inside < lookahead, F.col("_home") - 1),
            ))),
        )
        spec = Window.partitionBy(*keys, "_block").orderBy(*order)
    known: dict[str, str] = {}
    apart = False
    for stage in stages:
        doubles = {f.name for f in out.schema.fields if isinstance(f.dataType, T.DoubleType)} if long_apart else ()
        frames = Frames(spec, known, doubles, apart)
        made = stage(frames)
        out = frames.add(out)
        apart = frames.apart
        if made:
            out = out.withColumns(made)
        known = {n: x for n, x in frames.known.items() if x not in made}
    if not small:
        out = out.filter(F.col("_block") == F.col("_home"))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def fill_last(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], backward: bool = False
) -> DataFrame:
    """Replace nulls by the nearest earlier (or, ``backward``, later) non-null value of the group."""
    keys, order, columns = list(keys), list(order), list(columns)
    directed = [F.col(c).desc() if backward else F.col(c).asc() for c in order]

    def filled(scope: list[str]) -> dict[str, Column]:
        spec = Window.partitionBy(*scope).orderBy(*directed).rowsBetween(Window.unboundedPreceding, 0)
        return {c: F.last(c, ignorenulls=True).over(spec) for c in columns}

    if fits_one_task(df, keys):
        return df.withColumns(filled(keys))
    parts = _tagged(df, keys, order)
    pick = F.min_by if backward else F.max_by
    ends = parts.groupBy(*keys, "_part").agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_end_{i}") for i, c in enumerate(columns)]
    )
    along = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if backward else F.col("_part").asc())
    prior = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_part",
        *[F.last(f"_end_{i}", ignorenulls=True).over(prior).alias(f"_carry_{i}") for i in range(len(columns))],
    )
    local = parts.withColumns(filled([*keys, "_part"]))
    out = join_same(local, carry, [*keys, "_part"])
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{i}")) for i, c in enumerate(columns)})
    return out.select(*df.columns)


def running(
    df: DataFrame, totals: dict[str, tuple[str, Column]], keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Running ``sum``, ``product``, ``max`` or ``min`` of expressions: ``{name: (kind, expression)}``."""
    keys, order = list(keys), list(order)
    kinds = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}

    def local(scope: list[str]) -> dict[str, Column]:
        spec = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return {n: kinds[k](e).over(spec) for n, (k, e) in totals.items()}

    if fits_one_task(df, keys):
        return df.withColumns(local(keys))
    parts = _tagged(df, keys, order)
    ends = parts.groupBy(*keys, "_part").agg(*[kinds[k](e).alias(f"_end_{n}") for n, (k, e) in totals.items()])
    prior = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *keys, "_part", *[kinds[k](f"_end_{n}").over(prior).alias(f"_carry_{n}") for n, (k, _) in totals.items()]
    )
    out = join_same(parts.withColumns(local([*keys, "_part"])), carry, [*keys, "_part"])

    def joined(name: str, kind: str) -> Column:
        mine, before = F.col(name), F.col(f"_carry_{name}")
        if kind == "sum":
            return F.coalesce(mine + before, mine, before)
        if kind == "product":
            return F.coalesce(mine * before, mine, before)
        return F.greatest(mine, before) if kind == "max" else F.least(mine, before)

    return out.withColumns({n: joined(n, k) for n, (k, _) in totals.items()}).select(*df.columns, *totals)


def average_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add ``_rank_<c>`` (ascending, ties averaged, null for null) and ``_count_<c>`` (non-null rows) per group.

    Rows may repeat, keys may be null, and values are compared in their own type.
    """
    keys, columns = list(keys), list(columns)
    if keys and len(columns) > 2 and all(isinstance(df.schema[c].dataType, _FITS_DOUBLE) for c in columns):
        return _ranks_of_many(df, columns, keys)
    if fits_one_task(df, keys):
        made: dict[str, Column] = {}
        for c in columns:
            # First and last place of the ties: one sort serves both.
            spec = Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last())
            last = F.count(F.lit(1)).over(spec.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            made[f"_rank_{c}"] = F.when(F.col(c).isNotNull(), (F.rank().over(spec) + last) / 2.0)
            made[f"_count_{c}"] = F.count(c).over(Window.partitionBy(*keys))
        return df.withColumns(made)
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # read twice per column, and for the counts
    out = df
    for c in columns:
        # A rank belongs to a value: distinct values with their counts are placed, and looked up again.
        spread = df.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        placed = running(spread, {"_end": ("sum", F.col("_n"))}, keys, [c])
        ranks = placed.select(*keys, c, (F.col("_end") - (F.col("_n") - 1) / 2.0).alias(f"_rank_{c}"))
        out = join_same(out, ranks, [*keys, c], "left")
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_count_{c}") for c in columns])
    if fits_broadcast(counts, keys, True):
        counts = F.broadcast(counts)
    out = join_same(out, counts, keys, "left")
    return out.select(*df.columns, *[f"{p}_{c}" for c in columns for p in ("_rank", "_count")])


# Types whose values a double holds exactly.
_FITS_DOUBLE = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def _ranks_of_many(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``average_ranks`` of many columns: rows are dealt by the keys once, and a task ranks the columns of its own groups (``tied``).

    Where a group is too large for one task, rows are taken apart into (row, column, value) and the values of all columns are placed by one range shuffle.
    """
    if fits_one_task(df, keys):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
        made = df.withColumn("_place", place).withColumn("_ranked", tied.ranks(F.col("_place"), [F.col(c).cast("double") for c in columns]))
        return made.select(*df.columns, *[F.col(f"_ranked.{p}{i}").alias(f"{name}_{c}") for i, c in enumerate(columns) for p, name in (("r", "_rank"), ("n", "_count"))])
    apart = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_at", "_value")
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    tall = rows.select(*keys, "_row", apart).filter(F.col("_value").isNotNull())
    spread = tall.groupBy(*keys, "_at", "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(spread, {"_end": ("sum", F.col("_n"))}, [*keys, "_at"], ["_value"])
    ranks = placed.select(*keys, "_at", "_value", (F.col("_end") - (F.col("_n") - 1) / 2.0).alias("_rank"))
    each = join_same(tall, ranks, [*keys, "_at", "_value"])
    back = each.groupBy("_row").agg(*[F.max(F.when(F.col("_at") == i, F.col("_rank"))).alias(f"_rank_{c}") for i, c in enumerate(columns)])
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_count_{c}") for c in columns])
    if fits_broadcast(counts, keys, True):
        counts = F.broadcast(counts)
    out = join_same(rows.join(back, "_row", "left"), counts, keys, "left")
    return out.select(*df.columns, *[f"_{p}_{c}" for c in columns for p in ("rank", "count")])


def lookup(
    df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", one_per_key: bool = True, row_bytes: int | None = None
) -> DataFrame:
    """Join a table of one row per key (or, with ``one_per_key=False``, a few).

    Broadcast when its rows are known to be few, else salted when a key of ``df`` is hot. ``row_bytes`` is the width of a
    row of ``table`` where its columns do not tell.
    """
    on = list(on)
    if fits_broadcast(table, on, one_per_key, row_bytes):
        return df.join(F.broadcast(table), on, how)
    if fits_one_task(df, on):
        return df.join(table, on, how)
    ensure_checkpoint_dir(df.sparkSession)
    # Only the hot keys are salted: their rows are dealt to several copies of their entry, all others join plainly.
    limit = max_group_rows(df.sparkSession)
    hot = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*on).checkpoint()
    hot = F.broadcast(hot) if group_sizes(hot, []).total <= max_broadcast_rows(df.sparkSession) else hot
    salts = math.ceil(group_sizes(df, on).largest / limit) * 2
    rest = [c for c in df.columns if c not in on] or on
    salted = df.join(hot, on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = table.join(hot, on, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = df.join(hot, on, "left_anti").join(table, on, how)
    return plain.unionByName(salted.join(copies, [*on, "_salt"], how).drop("_salt"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group as an array column ``edges``."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    if fits_one_task(rows, keys):
        return rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs])).alias("edges"))
    # Distinct values with their counts, so that a value held by most rows is one row.
    spread = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(spread, {"_end": ("sum", F.col("_n"))}, keys, [value])
    sizes = spread.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = lookup(placed, sizes, keys) if keys else placed.withColumn("_size", F.lit(sizes.first()[0]))
    places = [(F.col("_size") - 1) * F.lit(float(p)) for p in probs]

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_end") - F.col("_n")) & (place < F.col("_end")), F.col(value)))

    aggs = []
    for i, h in enumerate(places):
        aggs += [at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"), F.max(h - F.floor(h)).alias(f"_t{i}")]
    edges = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_t{i}") for i in range(len(probs))]
    return placed.groupBy(*keys).agg(*aggs).select(*keys, F.array(*edges).alias("edges"))
