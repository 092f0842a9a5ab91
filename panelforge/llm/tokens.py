"""Cross-tokenizer alignment: where the tokens of two vocabularies cover the same bytes of a text.

Every text is encoded twice, with a byte-level vocabulary (A) and with a piece vocabulary (B), and each token gets its byte range in
``space + text``. Per batch two ``merge_asof`` calls, keyed by document, find for each token start the token of the other
side that covers it; the union of both directions is the list of overlaps. Overlaps with equal ends are the links, and their ends cut the tokens into groups.

A text that is null or empty, or whose tokens of either side do not join to exactly ``space + text``, has no tokens: zeros and no
groups. Repeated rows and rows without ids are aligned row by row. A very long text is held whole by its task. Added columns replace columns of the
same name; other columns are kept. An empty table gives an empty table.

``consistency`` counts each linked id pair over the whole corpus. Of the pairs, those found in at least one ``HOT``-th of all
(row, pair) rows are at most ``HOT`` and are sent to all tasks; all others go through a join on the pair, where none of them can be hot.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_text, map_texts, stored
from panelforge.session import shared_folder

#: Folder of the vocabulary files on every machine, and the two files.
FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes aligned at a time (one longer text still comes whole).
BATCH_BYTES = 2_000_000
#: Most id pairs whose counts are sent to all tasks.
HOT = 50_000

# The pattern that cuts a text before the merges of the byte-level vocabulary.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The fast encoder is used for texts of these characters only; a test shows that both encoders agree on them.
_COMMON = r"[\x00-ɏ–—‘-„…]*"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Sides:
    """Both encoders of a task, and the bytes of every id."""

    def __init__(self, folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B):
        import regex
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path_a = os.path.join(folder, file_a)
        self.exact = Tokenizer.from_file(path_a)
        self.exact.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        letters = _byte_letters()
        special = {t["content"] for t in told.get("added_tokens", [])}
        vocabulary = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
        self.bytes_a = [b""] * (max(told["model"]["vocab"].values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        # Ids that rise with the merges are ranks, which a faster encoder of the same vocabulary takes.
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        order = [vocabulary["".join(m)] for m in merges]
        plain = not told.get("normalizer") and not (told.get("pre_tokenizer") or {}).get("add_prefix_space") and order == sorted(set(order))
        ranks = {self.bytes_a[i]: i for i in vocabulary.values()}
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        self.common = regex.compile(_COMMON)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, file_b))
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.length_a = np.array([len(b) for b in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)
        self.spelled_a, self.spelled_b = pa.array(self.bytes_a, pa.large_binary()), pa.array(self.bytes_b, pa.large_binary())
        self.name_a = pa.array([str(i) for i in range(len(self.bytes_a))])
        self.name_b = pa.array([str(i) for i in range(len(self.bytes_b))])

    def _piece(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return b"" if self.pieces.is_control(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is not None and (text.isascii() or self.common.fullmatch(text)):
            return self.fast.encode_to_numpy(" " + text, disallowed_special=())
        return np.array(self.exact.encode(" " + text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: Sequence[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """(places of the texts that have tokens, their ids of A, their ids of B)."""
        some = [i for i, t in enumerate(texts) if t]
        ids_b = self.pieces.encode_as_numpy([texts[i] for i in some], num_threads=1) if some else []
        whole = [(" " + texts[i]).encode() for i in some]
        same = _spells(ids_b, self.spelled_b, whole)
        some, ids_b, whole = ([x for x, yes in zip(xs, same) if yes] for xs in (some, ids_b, whole))
        ids_a = [self.encode_a(texts[i]) for i in some]
        same = _spells(ids_a, self.spelled_a, whole)
        return tuple([x for x, yes in zip(xs, same) if yes] for xs in (some, ids_a, ids_b))


@lru_cache(maxsize=1)
def sides_of(folder: str, file_a: str, file_b: str) -> Sides:
    """Both encoders, read once by a worker for all its tasks."""
    return Sides(folder, file_a, file_b)


def _spells(ids: list[np.ndarray], spelled: pa.Array, whole: list[bytes]) -> list[bool]:
    """Whether the bytes of each list of ids are the whole text."""
    if not sum(map(len, ids)):
        return [not text for text in whole]
    joined = spelled.take(pa.array(np.concatenate(ids)))
    data = joined.buffers()[2].to_pybytes()
    ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[np.cumsum([len(one) for one in ids])].tolist()
    return [data[begin:end] == text for begin, end, text in zip([0, *ends], ends, whole)]


class Tokens:
    """Tokens of all documents of a batch; byte offsets count on over the documents."""

    def __init__(self, ids: list[np.ndarray], length: np.ndarray):
        self.id = np.concatenate(ids).astype(np.int64)
        self.end = np.cumsum(length[self.id])
        self.start = self.end - length[self.id]
        self.count = np.array([len(one) for one in ids])
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int64), self.count)

    def keyed(self, place: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "start": self.start, place: np.arange(len(self.id))})


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of every pair of tokens that share a byte, each pair once."""
    frame_a, frame_b = a.keyed("a"), b.keyed("b")
    by_a = pd.merge_asof(frame_a, frame_b, on="start", by="doc")
    by_b = pd.merge_asof(frame_b, frame_a, on="start", by="doc")
    over = by_b["a"].to_numpy()
    new = a.start[over] != b.start  # a pair with equal starts is already there
    return np.r_[by_a["a"].to_numpy(), over[new]], np.r_[by_a["b"].to_numpy(), by_b["b"].to_numpy()[new]]


def _lists(values: pa.Array, offsets: np.ndarray, mark: str) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(mark, pa.large_string()))


def _spread(n: int, kept: list[int], values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    out[kept] = values
    return out


def align_batch(texts: Sequence[str], sides: Sides) -> dict:
    """Alignment of each text: counts, ``groups`` as ``a1,a2|b1;a3|b2,b3``, and its linked id pairs with how often they are linked."""
    n = len(texts)
    kept, ids_a, ids_b = sides.encode(texts)
    if not kept:
        zeros = np.zeros(n, dtype=np.int64)
        return {"n_a": zeros, "n_b": zeros, "n_groups": zeros, "n_links": zeros, "n_overlaps": zeros, "groups": [""] * n, "pairs": [[]] * n, "times": [[]] * n}
    a, b = Tokens(ids_a, sides.length_a), Tokens(ids_b, sides.length_b)
    over_a, over_b = overlaps(a, b)
    together = a.end[over_a] == b.end[over_b]
    link_a, link_b = over_a[together], over_b[together]
    docs = len(kept)
    per_doc = lambda x: np.bincount(x, minlength=docs)
    linked = np.zeros(len(a.id), dtype=bool)
    linked[link_a] = True
    ends = a.end[linked]  # in order
    last = np.r_[ends[1:] != ends[:-1], True][:len(ends)]
    ends, group_doc = ends[last], a.doc[linked][last]

    def cut(tokens: Tokens, names: pa.Array) -> pa.Array:
        offsets = np.r_[0, np.searchsorted(tokens.end, ends, side="right")]
        return _lists(names.take(pa.array(tokens.id)), offsets, ",")

    groups = pc.binary_join_element_wise(cut(a, sides.name_a), cut(b, sides.name_b), pa.scalar("|", pa.large_string()))
    told = np.array([""] * n, dtype=object)
    told[kept] = _lists(groups, np.r_[0, np.cumsum(per_doc(group_doc))], ";").to_pylist()

    # Distinct id pairs of each document.
    width = len(sides.bytes_b)
    code = (a.doc[link_a] * len(sides.bytes_a) + a.id[link_a]) * width + b.id[link_b]
    code.sort()
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    times, code = np.diff(np.r_[first, len(code)]), code[first]
    rest, id_b = np.divmod(code, width)
    doc, id_a = np.divmod(rest, len(sides.bytes_a))
    offsets = np.r_[0, np.cumsum(_spread(n, kept, per_doc(doc)))]
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind))
    return {
        "n_a": _spread(n, kept, a.count), "n_b": _spread(n, kept, b.count), "n_groups": _spread(n, kept, per_doc(group_doc)),
        "n_links": _spread(n, kept, per_doc(a.doc[link_a])), "n_overlaps": _spread(n, kept, per_doc(a.doc[over_a])), "groups": told.tolist(),
        "pairs": lists((id_a << 32) | id_b, pa.int64()), "times": lists(times, pa.int32()),
    }


def align(docs: DataFrame, text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_overlaps``, ``groups``, ``pairs`` (id of A, shifted by 32 bits, and id of B) and ``times``."""
    def make(batch: pa.RecordBatch) -> dict:
        return align_batch(as_text(batch, text_col), sides_of(folder, file_a, file_b))

    added = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups string, pairs array<long>, times array<int>"
    return map_texts(docs, make, added, text_col, most_bytes=BATCH_BYTES)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, n_rows, best): how often a pair is linked, in how many rows, and whether no pair of its id of B is linked more often."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("n_rows")))
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id_b")
    # One row per id of B, so no larger than the vocabulary.
    highest = F.broadcast(counts.groupBy(id_b).agg(F.max("n").alias("highest")))
    return counts.select("*", id_b).join(highest, "id_b").select("pair", "n", "n_rows", (F.col("n") == F.col("highest")).alias("best"))


def consistency(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """Replace ``pairs`` and ``times`` by ``n_best`` (links whose pair is the most frequent of its id of B) and ``count_sum`` (counts over links)."""
    rows = _written(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    facts = stored(link_counts(rows))
    total = facts.agg(F.sum("n_rows")).first()[0] or 0
    known = facts.where(F.col("n_rows") * F.lit(hot) >= F.lit(total)).select("pair", "n", "best").orderBy("pair").toArrow()  # at most `hot` rows
    sent = rows.sparkSession.sparkContext.broadcast((
        known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy().astype(np.int64)))

    def make(batch: pa.RecordBatch) -> dict:
        pair, count, best = sent.value
        column = batch.column(batch.schema.get_field_index("pairs"))
        ids = column.flatten().to_numpy()
        times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.minimum(np.searchsorted(pair, ids), max(len(pair) - 1, 0))
        found = pair[at] == ids if len(pair) else np.zeros(len(ids), dtype=bool)
        at, own = at[found], row[found]
        total_of = np.zeros(batch.num_rows, dtype=np.int64)
        best_of = np.zeros(batch.num_rows, dtype=np.int64)
        np.add.at(total_of, own, count[at] * times[found])
        np.add.at(best_of, own, best[at] * times[found])
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))], pa.int32())
        return {"n_best": best_of, "count_sum": total_of, "_pairs": pa.ListArray.from_arrays(offsets, pa.array(ids[~found])),
                "_times": pa.ListArray.from_arrays(offsets, pa.array(times[~found]))}

    sized = rows.withColumn("_weight", F.lit(None).cast("string"))
    half = _written(map_texts(sized, make, "n_best long, count_sum long, _pairs array<long>, _times array<long>", "_weight", ("pairs", "times", "_weight")), "aligned")
    rest = half.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("x")).select("_row", F.col("x._pairs").alias("pair"), F.col("x._times").alias("times"))
    rest = rest.join(facts.select("pair", "n", "best"), "pair").groupBy("_row").agg(
        F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.col("best").cast("long") * F.col("times")).alias("_best"))
    whole = half.join(rest, "_row", "left")
    return whole.withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }).drop("_row", "_pairs", "_times", "_sum", "_best")
