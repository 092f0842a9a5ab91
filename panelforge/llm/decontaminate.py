"""Benchmark decontamination with a distributed positional inverted index.

The training table is indexed in shards of bounded size. A shard lays its documents end to end, with a gap between them, and
stores for each test term the sorted list of its places in the shard, the term's postings, in the shared folder. The index
is partitioned by document, so a frequent term is many lists of bounded length instead of one hot key, and nothing
is shuffled. A search orders the terms of every phrase by their count in the whole corpus. It starts with the postings of
the rarest term, moved back by that term's offset in the phrase, and intersects them with the offset-adjusted postings of the
next rarest, until none is left or all terms agree: the exact starts of the phrase. A proximity search takes the rarest distinct terms of a phrase
(all of a phrase that has fewer) and keeps the places of the rarest one that have each other one within ``slop`` words on either side, in the same
document. Phrases that share their rarest terms are searched once. With a slop of the phrase's length an exact match is a proximity match too.

The test table is taken in blocks of at most ``block_words`` words, each block bounded and sent to all tasks; a larger test table
means more passes, not larger tasks.

Equal item texts are one text of the test table, in one block, however many items hold it; a block is bounded by its distinct words and lists the ids of its items.

Null or wordless documents hit nothing, null or wordless items match nothing, and items with a null id mark words without being listed.
Repeated documents are answered as they stand, one row per document row. Ids of integer types come back as long, all others as strings. An empty table of documents gives no rows,
an empty test table no hits. Other columns of the documents are not returned, so their names cannot clash; texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import _arrow, as_text, slices, stored

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
#: Words of the test table that are searched for at once.
BLOCK_WORDS = 400_000
#: A shard is closed when it holds this many words.
SHARD_WORDS = 500_000
#: Least free places between two documents of a shard; no match reaches over them, since a wider slop widens them.
GAP = 64
#: Proximity matches of the report: the six rarest words of a window, none further from the rarest one than a window reaches.
NEAR_TERMS = 6
SLOP = WINDOW - 1
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[str]:
    return WORDS.findall(text.translate(_LOWER))


class Phrases:
    """Phrases over a bounded vocabulary: rows of term numbers, each kept once, with the numbers of the texts that hold it; ``ids`` are the items of each text."""

    def __init__(self, texts: list[tuple[list[str], str | None]], width: int):
        self.vocabulary: dict[str, int] = {}
        self.holders: dict[tuple[int, ...], set[int]] = {}
        self.ids = [ids for ids, _ in texts]
        for number, (_, text) in enumerate(texts):
            terms = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            for i in range(max(1, len(terms) - width + 1) if terms else 0):
                self.holders.setdefault(tuple(terms[i:i + width]), set()).add(number)
        self.phrases = list(self.holders)


def item_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The test table (item, text) as distinct texts with the list of their items, cut by a hash of the text into blocks of half ``block_words`` words, about."""
    texts = stored(benchmark.where("text is not null").groupBy("text").agg(F.collect_set("item").alias("items")))  # null ids are not listed
    total = texts.agg(F.sum(F.length("text") / 2)).first()[0] or 0  # a word and its separator are two characters at least
    n = max(1, int(np.ceil(2 * total / block_words)))
    return [texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else texts for b in range(n)]


def index(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, gap: int = GAP) -> DataFrame:
    """The inverted index over the terms of ``vocabulary``, in the shared folder.

    A shard is one row with term -1 (arrays ``rows`` and ``ids`` of its documents, ``starts`` and ``lengths`` in words), followed by a row
    per term with its places. The rows of a shard stay together in their partition.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["term", "rows", "ids", "starts", "lengths", "places"]
    longs = pa.list_(pa.int64())
    kind = "long" if isinstance(docs.schema[id_col].dataType, T.IntegralType) else "string"
    ids_type = pa.list_(pa.int64() if kind == "long" else pa.string())

    def shard(rows: list, ids: list, counts: list[int], found: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array(counts, dtype=np.int64)
        starts = np.cumsum(lengths + gap) - lengths - gap
        term = np.concatenate(found)
        place = np.concatenate([p + s for p, s in zip(at, starts.tolist())])
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        edges = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, edges, len(term)].astype(np.int32) if len(term) else np.array([0, 0], dtype=np.int32)), pa.array(place.astype(np.int64)))
        none = [None] * len(edges)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[-1, term[edges]].astype(np.int64)), pa.array([rows, *none], type=longs), pa.array([ids, *none], type=ids_type), pa.array([starts, *none], type=longs),
            pa.array([lengths, *none], type=longs), lists,
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        rows: list[int] = []
        ids: list = []
        counts: list[int] = []
        found: list[np.ndarray] = []
        at: list[np.ndarray] = []
        held = 0
        for batch in slices(batches, "_text"):
            for row, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_text(batch, "_text")):
                split = words(text)
                terms = np.fromiter((number.get(w, -1) for w in split), dtype=np.int64, count=len(split))
                place = np.flatnonzero(terms >= 0)
                rows.append(row)
                ids.append(i)
                counts.append(len(split))
                found.append(terms[place])
                at.append(place)
                held += len(split) + gap
                if held >= shard_words:
                    yield shard(rows, ids, counts, found, at)
                    rows, ids, counts, found, at, held = [], [], [], [], [], 0
        if ids:
            yield shard(rows, ids, counts, found, at)

    schema = f"term long, rows array<long>, ids array<{kind}>, starts array<long>, lengths array<long>, places array<long>"
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast(kind).alias("_id"), F.col(text_col).alias("_text"))
    return stored(numbered.mapInArrow(run, schema))


def term_counts(indexed: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each term in the whole corpus; one number per term of a bounded vocabulary."""
    counts = np.zeros(terms, dtype=np.int64)
    for term, n in indexed.where("term >= 0").groupBy("term").agg(F.sum(F.size("places")).alias("n")).collect():
        counts[term] = n
    return counts


def phrase_starts(postings: dict[int, np.ndarray], terms: np.ndarray, by_rarity: np.ndarray) -> np.ndarray:
    """Places at which the phrase ``terms`` begins; ``by_rarity`` orders its offsets, rarest term first."""
    first = by_rarity[0]
    starts = postings.get(int(terms[first]))
    if starts is None:
        return _NONE
    starts = starts - first
    for offset in by_rarity[1:]:
        other = postings.get(int(terms[offset]))
        if other is None:
            return _NONE
        want = starts + offset
        where = np.searchsorted(other, want)
        where[where == len(other)] = 0
        starts = starts[other[where] == want]
        if not len(starts):
            return _NONE
    return starts


_NONE = np.empty(0, dtype=np.int64)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """The union of (start, end) spans as flat numbers."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def near_places(postings: dict[int, np.ndarray], terms: tuple[int, ...], slop: int) -> np.ndarray:
    """Places of the first (rarest) of ``terms`` that have every other term within ``slop`` words on either side."""
    anchor = postings.get(terms[0], _NONE)
    for term in terms[1:]:
        other = postings.get(term, _NONE)
        if not len(other) or not len(anchor):
            return _NONE
        right = np.searchsorted(other, anchor)
        ahead = other[np.minimum(right, len(other) - 1)] - anchor
        back = anchor - other[np.maximum(right - 1, 0)]
        anchor = anchor[((ahead >= 0) & (ahead <= slop)) | ((back >= 0) & (back <= slop))]
    return anchor


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[list, list, np.ndarray, np.ndarray], dict[int, np.ndarray]]]:
    """(documents of the shard, its postings), shard after shard."""
    head, postings = None, {}
    for batch in batches:
        terms = batch.column(0).to_pylist()
        for row, term in enumerate(terms):
            if term < 0:
                if head is not None:
                    yield head, postings
                rows, ids, starts, lengths = (batch.column(c)[row].as_py() for c in (1, 2, 3, 4))
                head, postings = (rows, ids, np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64)), {}
            else:
                postings[term] = batch.column(5)[row].values.to_numpy()
    if head is not None:
        yield head, postings


def search(indexed: DataFrame, phrases: Phrases, near_terms: int = 0, slop: int = 0) -> DataFrame:
    """(row, doc_id, n_words, hits, items, near_items) per document of the index.

    ``hits`` lists the (start, end) word spans of exact phrases, merged, as flat numbers; ``items`` the items with a phrase there. With
    ``near_terms``, ``near_items`` lists the items of which one phrase has its rarest ``near_terms`` distinct terms (counted in the whole corpus; of
    equal counts the first in the phrase) within ``slop`` words of the rarest; the index must have a wider gap.
    """
    counts = term_counts(indexed, len(phrases.vocabulary))
    plans: list[tuple] = []
    near_plans: dict[tuple[int, ...], set[int]] = {}
    for phrase in phrases.phrases:
        terms = np.array(phrase, dtype=np.int64)
        by_rarity = np.argsort(counts[terms], kind="stable")
        if counts[terms[by_rarity[0]]] == 0:
            continue  # neither the phrase nor its rarest terms occur
        plans.append((terms, by_rarity, phrases.holders[phrase]))
        if near_terms:
            near_plans.setdefault(tuple(dict.fromkeys(terms[by_rarity].tolist()))[:near_terms], set()).update(phrases.holders[phrase])
    sent = indexed.sparkSession.sparkContext.broadcast((plans, near_plans, phrases.ids))
    kind = indexed.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, loose, ids_of = sent.value

        def items(held: list[set[int]]) -> pa.Array:
            return pa.array([sorted({i for t in h for i in ids_of[t]}) for h in held], type=pa.list_(pa.string()))

        for (rows, ids, starts, lengths), postings in shards_of(batches):
            n = len(ids)
            span: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            texts: list[set[int]] = [set() for _ in range(n)]
            near: list[set[int]] = [set() for _ in range(n)]
            for terms, by_rarity, holders in exact:
                found = phrase_starts(postings, terms, by_rarity)
                if len(found):
                    for d, p in zip((np.searchsorted(starts, found, side="right") - 1).tolist(), found.tolist()):
                        span[d].append((p, p + len(terms)))
                        texts[d].update(holders)
            for rare, holders in loose.items():
                for d in np.unique(np.searchsorted(starts, near_places(postings, rare, slop), side="right") - 1).tolist():
                    near[d].update(holders)
            hits = [merged([(a - s, b - s) for a, b in spans]) for spans, s in zip(span, starts.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, type=pa.int64()), pa.array(ids, type=_arrow(kind)), pa.array(lengths), pa.array(hits, type=pa.list_(pa.int64())),
                items(texts), items(near),
            ], names=["row", "doc_id", "n_words", "hits", "items", "near_items"])

    return indexed.mapInArrow(run, f"row long, doc_id {kind.simpleString()}, n_words long, hits array<long>, items array<string>, near_items array<string>")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_words: int = BLOCK_WORDS, near_terms: int = 0, slop: int = 0,
) -> DataFrame:
    """One row per document row: doc_id, n_words, hits (flat (start, end) word spans), items, near_items, row (its number).

    A phrase is ``width`` consecutive words of an item, or all words of a shorter one. Proximity matches are looked for where ``near_terms`` is not 0.
    """
    answers = []
    given = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    for block in item_blocks(given, block_words):
        phrases = Phrases([(r["items"], r["text"]) for r in block.collect()], width)  # distinct texts, bounded by block_words
        indexed = index(docs, phrases.vocabulary, id_col, text_col, gap=max(GAP, slop + 1))
        answers.append(search(indexed, phrases, near_terms, slop))
    if len(answers) == 1:
        return answers[0]
    every = answers[0]
    for more in answers[1:]:
        every = every.union(more)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  a list per block of the test table
    gathered = every.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"), flat("hits"), flat("items"), flat("near_items"))

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [merged(list(zip(h[::2], h[1::2]))) for h in batch.column(3).to_pylist()]
            yield batch.set_column(3, "hits", pa.array(hits, type=pa.list_(pa.int64())))

    return gathered.mapInArrow(join_blocks, gathered.schema).withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("items", "near_items")})


def contaminated(hits_words: Column, n_words: Column) -> Column:
    """The rule of the report and of the filter: a twentieth of the words or more."""
    return (hits_words > 0) & (20 * hits_words >= n_words)


def n_hit() -> Column:
    """Words of a document that lie in some phrase."""
    ends = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)
