"""Quality rules as a short-circuit cascade.

Every rule is run on a bounded sample first, which gives its cost (CPU seconds per document) and its selectivity (share of
documents that it rejects). The rules are then ordered by rejection per cost, and in the full pass a document meets the
next rule only if all earlier ones kept it. The order changes the work, never the verdict: a document is kept if every rule
keeps it. Rules read a shared per-document ``Facts`` whose parts are computed on first use, so a cheap rule that rejects saves
the dearer parts.

Null and empty texts have no words; every rule keeps them, and the base rule (fewer than 20 words) rejects them.
Columns of the input that share a name with a result column are replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_bytes, map_texts, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents, about, on which cost and selectivity are estimated.
SAMPLE_ROWS = 2_000
SAMPLE_TASKS = 16


class Facts:
    """What rules know of one text (UTF-8)."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = np.frombuffer(b"".join(self.words), dtype=np.uint8)
        return int(np.count_nonzero((joined & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(s) for s in (SYMBOLS[i:i + 1] for i in range(len(SYMBOLS))))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.split()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words, WINDOW)

    @cached_property
    def top_word(self) -> int:
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def n_same_next(self) -> int:
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def n_letter_words(self) -> int:
        return sum(1 for w in self.words if _LETTER.intersection(w))


#: Bytes of words with a letter: A-Z, a-z, and all of characters beyond ASCII.
_LETTER = frozenset([*range(65, 91), *range(97, 123), *range(128, 256)])


def repeat_words(words: list[bytes], width: int) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included.

    Windows get exact numbers by doubling: equal numbers of two halves make equal numbers of the whole.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number, _ = pd.factorize(np.array(words, dtype=object))
    size = 1
    while size < width:
        half = len(number) - size
        number = np.unique(number[:half] * np.int64(len(words) + 1) + number[size:], return_inverse=True)[1]
        size *= 2
    seen = np.bincount(number)[number] > 1
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    marks[:n] += seen
    marks[width:] -= seen
    return int(np.count_nonzero(np.cumsum(marks)[:len(words)] > 0))


#: Facts that are returned for every text.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


def rules() -> list[Rule]:
    """All comparisons are of whole numbers, so a twin in SQL decides alike."""
    return [
        Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 14 * f.n_words),
        Rule("symbols", lambda f: 10 * f.n_symbols > 3 * f.n_words),
        Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 5 * len(f.lines)),
        Rule("stutter", lambda f: 100 * f.n_same_next > 30 * f.n_words),
        Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
        Rule("frequent_word", lambda f: 10 * f.top_word > 4 * f.n_words),
        Rule("letters", lambda f: 10 * f.n_letter_words < 6 * f.n_words),
    ]


def base_failed(f: Facts) -> bool:
    return f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words


def hashed_sample(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """``_text`` of at most ``rows`` rows, the same at every run: those with the smallest hashes of id and text.

    Rows alike in both count once, so ids that are null or repeat do not swell it; where most rows are alike it holds fewer, or none.
    """
    share = min(1.0, 2 * rows / max(1, docs.count()))
    hashed = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.length(text_col), F.col(text_col)).alias("_h"), F.col(text_col).alias("_text"))
    some = hashed.where(F.pmod("_h", F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).dropDuplicates(["_h"])
    # About twice as many rows meet here, whatever the table's size, and are dealt to a few tasks.
    return some.orderBy("_h").limit(rows).repartition(SAMPLE_TASKS, "_h").select("_text")


def profile(docs: DataFrame, given: list[Rule], text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, CPU seconds, rejected share) per rule, on a sample. A rule pays for the facts that it needs beyond the reported ones, which every text gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected, rows = dict.fromkeys((r.name for r in given), 0.0), dict.fromkeys((r.name for r in given), 0), 0
        for batch in slices(batches, "_text"):
            for text in as_bytes(batch, "_text"):
                rows += 1
                facts = Facts(text)
                for c in REPORTED:
                    getattr(facts, c)
                for rule in given:
                    began = time.thread_time()
                    rejected[rule.name] += bool(rule.rejects(facts))
                    cost[rule.name] += time.thread_time() - began
        yield pa.RecordBatch.from_pydict({"rule": [*cost], "cpu": [*cost.values()], "bad": [float(x) for x in rejected.values()], "rows": [float(rows)] * len(cost)})

    sample = hashed_sample(docs, id_col, text_col, sample_rows)
    sums = sample.mapInArrow(run, "rule string, cpu double, bad double, rows double").groupBy("rule").agg(F.sum("cpu").alias("cpu"), F.sum("bad").alias("bad"), F.sum("rows").alias("rows"))
    found = {r["rule"]: (r["cpu"] / max(r["rows"], 1.0), r["bad"] / max(r["rows"], 1.0)) for r in sums.collect()}  # a row per rule
    return [(r.name, *found.get(r.name, (0.0, 0.0))) for r in given]


def ordered(given: list[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """Most rejections per second first; ties keep the given order."""
    gain = {name: share / max(cost, 1e-9) for name, cost, share in measured}
    return sorted(given, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, given: list[Rule] | None = None, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed and kept (boolean) to every row."""
    given = rules() if given is None else given
    in_order = ordered(given, profile(docs, given, text_col, id_col, sample_rows))

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in (*REPORTED, "base_failed", "kept")}
        for text in as_bytes(batch, text_col):
            facts = Facts(text)
            failed = base_failed(facts)
            out["kept"].append(not failed and not any(rule.rejects(facts) for rule in in_order))
            out["base_failed"].append(failed)
            for c in REPORTED:
                out[c].append(getattr(facts, c))
        return out

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_texts(docs, make, added, text_col)
