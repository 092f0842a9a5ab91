"""SimHash near-duplicates: all pairs of fingerprints within a few bits, found in Gray-ordered hierarchical indexes.

Distinct fingerprints are dealt to cells by masked bit patterns, the upper nodes of the index: the 64 bits are cut into
``bits + 2`` blocks, and two fingerprints that differ in at most ``bits`` places agree on two whole blocks at least, so
each pair meets in the cell of those two blocks. A cell sorts its fingerprints by Gray rank, which puts
similar ones side by side, and factors what neighbours share into a tree of (mask, pattern) nodes. The search walks pairs of
nodes from the top, and drops a pair of whole groups as soon as the bits on which both are settled differ in
more than ``bits`` places; masks widen downwards, so differences add up. Groups that are one component already are not
compared again, so a family of near copies costs about its size, and a cell emits one edge per linked
fingerprint instead of its pairs. A cell of more than ``cell_rows`` fingerprints is cut into fragments, and every
pair of fragments is a cell of its own: nothing is capped.

Equal texts share a fingerprint and are one node. Null and empty texts have fingerprint zero. A null id is never the
smallest id of its component (null only if no row has one). Repeated ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_bytes, components, hex64, map_texts, stored

CELL_ROWS = 1_024
FANOUT = 8
#: Cells up to this size compare all their pairs at once.
FLAT = 24
_CHUNK = 65_536


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, A-Z lowered; fewer words make one shingle, none make none."""
    split = text.lower().split()  # bytes split on exactly \x20 and \x09-\x0D
    if not split:
        return np.empty(0, dtype=np.uint64)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), 42)], dtype=np.uint64)
    joined = b" ".join(split)
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(split) - words + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(text: bytes, words: int) -> int:
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 16_384):
        part = hashes[i:i + 16_384].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""
    def make(batch: pa.RecordBatch) -> dict:
        return {"fp": [fingerprint(t, words) for t in as_bytes(batch, "_text")]}

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), make, "fp long", "_text", ("_text",))


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks of nearly equal width."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def keyed(fps: DataFrame, bits: int) -> DataFrame:
    """One row for each pair of blocks: ``cell`` holds the number of the pair and the bits of both blocks."""
    blocks = _blocks(bits + 2)
    cells = []
    for i, (s, w) in enumerate(blocks):
        for j, (s2, w2) in list(enumerate(blocks))[i + 1:]:
            one = F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1))
            two = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
            cells.append(F.struct(F.lit(i * len(blocks) + j).alias("p"), F.shiftleft(one, w2).bitwiseOR(two).alias("k")))
    return fps.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.p", "c.k")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray sequence."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Union:
    """Labels of 0..n-1 under the links found so far."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low = np.minimum(x, y)
            np.minimum.at(label, np.maximum(x, y), low)
            while True:  # shorten
                shorter = label[label]
                if np.array_equal(shorter, label):
                    break
                label[:] = shorter


def search(x: np.ndarray, bits: int, union: Union, base: int, side: np.ndarray | None = None) -> None:
    """Link all pairs of the Gray-sorted ``x`` within ``bits``; row i is node ``base + i``. ``side``: see ``linked``."""
    n = len(x)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    masks, patterns = [np.full(n, full)], [x]
    while len(patterns[-1]) > 1:
        starts = np.arange(0, len(patterns[-1]), FANOUT)
        all_one = np.bitwise_and.reduceat(patterns[-1], starts)
        any_one = np.bitwise_or.reduceat(patterns[-1], starts)
        mask = np.bitwise_and.reduceat(masks[-1], starts) & ~(all_one ^ any_one)
        masks.append(mask)
        patterns.append(all_one & mask)
    steps = np.arange(FANOUT)
    top = len(masks) - 1
    stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > _CHUNK:
            stack.append((level, a[_CHUNK:], b[_CHUNK:]))
            a, b = a[:_CHUNK], b[:_CHUNK]
        if level == 0:
            keep = a < b
            if side is not None:
                keep &= side[a] != side[b]
            union.add(base + a[keep], base + b[keep])
            continue
        # Groups whose rows all are one component have nothing left to link.
        spans = np.arange(0, n, FANOUT ** level)
        own = union.label[base:base + n]
        least, most = np.minimum.reduceat(own, spans), np.maximum.reduceat(own, spans)
        busy = ~((least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]))
        a, b = a[busy], b[busy]
        size = len(masks[level - 1])
        a = (a[:, None] * FANOUT + steps)[:, :, None].repeat(FANOUT, axis=2).reshape(-1)
        b = (b[:, None] * FANOUT + steps)[:, None, :].repeat(FANOUT, axis=1).reshape(-1)
        inside = (a <= b) & (b < size)
        a, b = a[inside], b[inside]
        mask, pattern = masks[level - 1], patterns[level - 1]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
        a, b = a[near], b[near]
        for i in range(0, len(a), _CHUNK):
            stack.append((level - 1, a[i:i + _CHUNK], b[i:i + _CHUNK]))


def linked(cell: np.ndarray, x: np.ndarray, side: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, smaller x of the same component) of whole cells that lie one behind the other.

    ``side`` marks the fragment of a row in a cell of two fragments (1 and 2: only pairs across them count there), else 0.
    """
    order = np.lexsort((gray_rank(x), cell))
    cell, x, side = cell[order], x[order], side[order]
    n = len(x)
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[begin, n])
    union = Union(n)
    end = np.repeat(begin + sizes, sizes)
    flat = np.repeat(sizes <= FLAT, sizes)
    rows = np.flatnonzero(flat)
    for d in range(1, FLAT):
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        near = (np.bitwise_count(x[rows] ^ x[rows + d]) <= bits) & ((side[rows] == 0) | (side[rows] != side[rows + d]))
        union.add(rows[near], rows[near] + d)
    for b, s in zip(begin[sizes > FLAT].tolist(), sizes[sizes > FLAT].tolist()):
        own = side[b:b + s]
        search(x[b:b + s], bits, union, b, own if own.any() else None)
    moved = np.flatnonzero(union.label != np.arange(n))
    return x[moved], x[union.label[moved]]


def links(fps: DataFrame, bits: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct edges (a, b) that span the components of the distinct fingerprints ``fp`` under ``bits`` differing bits."""
    rows = keyed(fps, bits)
    # Oversized cells, with the number of their fragments; none in even data.
    hot = stored(rows.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
                 .select("p", "k", F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        cells = rows.select("p", "k", F.lit(0).alias("f"), F.lit(0).alias("g"), "fp", F.lit(0).alias("side"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = (
            rows.join(hot, ["p", "k"], "left").withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
            .select("p", "k", F.least("mine", "other").alias("f"), F.greatest("mine", "other").alias("g"), "fp",
                    F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"))
        )
    cells = cells.repartition("p", "k", "f", "g").sortWithinPartitions("p", "k", "f", "g")
    names = ("p", "k", "f", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the unfinished cell at the end of what came so far

        def done(block: np.ndarray) -> pa.RecordBatch:
            new = np.r_[False, (block[1:, :4] != block[:-1, :4]).any(axis=1)] if len(block) else np.empty(0, dtype=bool)
            a, b = linked(np.cumsum(new), block[:, 4].astype(np.int64).view(np.uint64), block[:, 5], bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in (*names, "fp", "side")], axis=1)
            if held:
                block = np.concatenate([*held, block])
            last = np.flatnonzero((block[:, :4] != block[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [block[cut:]]
            if cut:
                yield done(block[:cut])
        if held:
            yield done(np.concatenate(held))

    return cells.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``; the component's id is its smallest document id."""
    marked = stored(fingerprints(docs, words, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), bits, cell_rows)).withColumnRenamed("node", "fp")
    classes = stored(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = stored(classes.groupBy("root").agg(F.min("first_id").alias("component_id")))  # so that AQE can split the join on a large component
    classes = classes.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", hex64("fp").alias("fingerprint"), "component_id")
