"""Language identification: spans of one language in texts that may mix several.

A word is a letter and the letters and marks that follow it. The script of its first letter narrows the candidates to the languages that
were seen to use that script; each candidate has a score for the word, the log likelihood of its letter runs. A Viterbi pass over the words, with a penalty for each change of
language, labels every word, and runs of one label are the spans. The predicted language is the one whose spans hold most letters.

``learn`` counts letter runs of every text with a language, in one pass. The model is bounded: ``MAX_LANGUAGES`` languages (the most frequent), ``PLACES`` hashed runs each.

A text that is null, empty or has no letter is ``und`` with score 0 and no spans; so is every text where nothing was learned. Letters of a script that no language
uses leave all languages alike, and the most frequent one is named. Ids play no part, so null and repeated ids are rows like others. Ties go to the more frequent language, then to the
smaller name. Texts of any length are labelled whole; the work per word does not grow with the text. Added columns replace columns of the same name, others are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_text, map_texts, slices

MAX_LANGUAGES = 200
BITS = 16
PLACES = 1 << BITS
#: Letter runs of 1 to this many characters, the word's borders included.
LONGEST = 4
#: Log odds that a word of one language stands after a word of another.
SWITCH = 12.0
#: Share of a language's letters that makes a script one of its own.
SCRIPT_SHARE = 0.01
#: Score of a word in a language that does not use its script.
FOREIGN = -40.0

# First code points of the ranges of scripts; a range ends where the next begins, "" holds all else.
RANGES = [
    (0x0000, ""), (0x0041, "latin"), (0x02B0, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, ""), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "syllabics"), (0x1680, ""), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x2E80, "han"),
    (0x3000, ""), (0x3005, "han"), (0x3008, ""), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"),
    (0x3200, ""), (0x3400, "han"), (0xA000, "yi"), (0xA4D0, ""), (0xA640, "cyrillic"), (0xA6A0, ""), (0xA720, "latin"), (0xA800, ""),
    (0xAC00, "hangul"), (0xD800, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"),
    (0xFF00, ""), (0xFF21, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"), (0x32000, ""),
]
SCRIPTS = sorted({name for _, name in RANGES})
_STARTS = np.array([start for start, _ in RANGES])
_NUMBER = np.array([SCRIPTS.index(name) for _, name in RANGES])
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_PLAIN = re.compile(r"[A-Za-z]+")
_LAST = regex.compile(r"(?r)\p{L}[\p{L}\p{M}]*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text; where it holds ASCII alone, its letters are A to Z, which the plainer pattern finds faster."""
    return _PLAIN.findall(text) if text.isascii() else _WORD.findall(text)


class Numbers(dict):
    """Numbers words from 0 in order of first sight: ``numbers[word]`` adds a new one."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def scripts_of(words: Sequence[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    return _NUMBER[np.searchsorted(_STARTS, first, side="right") - 1]


def runs_of(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, word number) of all letter runs of the words, which are lowered and have a border mark on both sides."""
    marked = "".join([f"\x00{w.lower()}\x00" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    borders = np.flatnonzero(codes == 1)
    word = np.repeat(np.arange(len(words)), borders[1::2] - borders[0::2] + 1)
    places, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        # Hash of the n characters from each place on, kept where they end within the word.
        h = (h[: len(codes) - n + 1] + codes[n - 1:]) * _MIX
        h ^= h >> np.uint64(31)
        inside = word[: len(h)] == word[n - 1:]
        if n == 1:
            inside &= codes != 1
        places.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int64) if n > 1 else (h[inside] * _MIX >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(word[: len(h)][inside])
    return np.concatenate(places), np.concatenate(owners)


class Model:
    """Languages, most frequent first; log likelihoods (language, place); and which scripts each language uses."""

    def __init__(self, languages: list[str], runs: np.ndarray, letters: np.ndarray):
        self.languages = languages
        total = runs.sum(axis=1, keepdims=True)
        self.log = np.log((runs + 0.1) / (total + 0.1 * PLACES)).astype(np.float32).T.copy() if languages else np.zeros((PLACES, 0), np.float32)
        uses = letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
        uses &= letters > 0
        self.unknown = ~uses.any(axis=0)  # scripts of no language
        self.uses = uses.T

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """(word, language): log likelihood, averaged over the run lengths, which see the same letters."""
        place, owner = runs_of(words)
        order = np.argsort(owner, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]]
        sums = np.add.reduceat(self.log[place[order]], starts, axis=0) / LONGEST
        script = scripts_of(words)
        sums[~self.uses[script]] += FOREIGN
        sums[self.unknown[script]] = 0.0  # all languages alike
        return sums.astype(np.float64)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_languages: int = MAX_LANGUAGES) -> Model:
    """Counts over every row with a text and a language. What is collected is bounded by languages times places."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    frequent = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(max_languages).collect()
    languages = [r["_lang"] for r in frequent]
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, np.ndarray] = {}
        for batch in slices(batches, "_text"):
            ids = Numbers()
            own: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_text(batch, "_text")):
                if lang in number and text:
                    at = np.array(list(map(ids.__getitem__, words_of(text))), dtype=np.int64)
                    own.setdefault(number[lang], []).append(at)
            if not ids:
                continue
            words = list(ids)
            place, owner = runs_of(words)
            script, length = scripts_of(words), np.array([len(w) for w in words])
            for k, at in own.items():
                times = np.bincount(np.concatenate(at), minlength=len(words))
                if k not in runs:
                    runs[k] = np.zeros(PLACES + len(SCRIPTS), dtype=np.int64)
                runs[k][:PLACES] += np.bincount(place, weights=times[owner], minlength=PLACES).astype(np.int64)
                runs[k][PLACES:] += np.bincount(script, weights=times * length, minlength=len(SCRIPTS)).astype(np.int64)
        for k, counts in runs.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["k", "place", "n"])

    parts = known.mapInArrow(run, "k int, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    table = parts.toArrow() if languages else None
    counts = np.zeros((len(languages), PLACES + len(SCRIPTS)))
    if table is not None:
        counts[table["k"].to_numpy(), table["place"].to_numpy()] = table["n"].to_numpy()
    return Model(languages, counts[:, :PLACES], counts[:, PLACES:])


def viterbi(scores: np.ndarray, words: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word. ``words`` holds the score rows of all texts, one after the other; ``count`` is the words of each text.

    All texts step through their words together, longest first, so a step is a few array operations whatever the number of texts.
    """
    k = scores.shape[1]
    order = np.argsort(-count, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    count = count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # texts with more than t words
    best = np.zeros((len(count), k))
    came = np.zeros((len(words), k), dtype=np.uint8)
    for t in range(longest):
        n = active[t]
        own = scores[words[begin[:n] + t]]
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            least = now[np.arange(n), top] - switch
            moved = now < least[:, None]
            came[begin[:n] + t] = np.where(moved, top[:, None], np.arange(k))
            own = own + np.where(moved, least[:, None], now)
        best[:n] = own
    label = np.zeros(len(words), dtype=np.uint8)
    state = best.argmax(axis=1) if k else np.zeros(len(count), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        label[begin[:n] + t] = state[:n]
        if t:
            state[:n] = came[begin[:n] + t, state[:n]]
    return label


def _certainty(sums: np.ndarray, k: int) -> float:
    """Probability of language ``k`` where ``sums`` are the log likelihoods of all."""
    return float(1.0 / np.exp(np.clip(sums - sums[k], -700, 700)).sum())


class Labeller:
    """Predictions for texts; words seen lately keep their scores."""

    def __init__(self, model: Model, keep: int = 200_000):
        self.model, self.keep = model, keep
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.lengths = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros((0, len(self.model.languages)))

    def label(self, texts: Sequence[str]) -> dict:
        names = self.model.languages
        n = len(texts)
        out = {"lang_pred": ["und"] * n, "score": np.zeros(n), "spans": [""] * n}
        if not names:
            return out
        if len(self.known) > self.keep:
            self._forget()
        before, known = len(self.known), self.known
        places = [np.array(list(map(known.__getitem__, words_of(text))), dtype=np.int64) for text in texts]
        if len(known) > before:
            new = list(known)[before:]
            self.scores = np.r_[self.scores, self.model.scores(new)]
            self.lengths = np.r_[self.lengths, np.array(list(map(len, new)), dtype=np.int64)]
        count = np.array([len(p) for p in places], dtype=np.int64)
        words = np.concatenate(places) if n else np.zeros(0, np.int64)
        labels = viterbi(self.scores, words, count)
        end = np.cumsum(count)
        for i in np.flatnonzero(count):
            at = slice(end[i] - count[i], end[i])
            own, length = labels[at], self.lengths[words[at]]
            held = np.bincount(own, weights=length, minlength=len(names))
            k = int(held.argmax())
            mine = own == k
            out["lang_pred"][i] = names[k]
            out["score"][i] = held[k] / held.sum() * _certainty(self.scores[words[at][mine]].sum(axis=0), k)
            out["spans"][i] = self._spans(texts[i], own)
        return out

    def _spans(self, text: str, labels: np.ndarray) -> str:
        """``lang:start:end`` by code points, end exclusive, comma-joined: from the first letter of a run of one label to its last."""
        names = self.model.languages
        changes = np.flatnonzero(labels[1:] != labels[:-1]) + 1
        if not len(changes):
            return f"{names[labels[0]]}:{_WORD.search(text).start()}:{_LAST.search(text).end()}"
        at = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [0, *changes.tolist()], [*changes.tolist(), len(labels)]
        return ",".join(f"{names[labels[a]]}:{at[a][0]}:{at[b - 1][1]}" for a, b in zip(starts, ends))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (share of the letters in spans of that language, times how certain they are) and ``spans``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES times PLACES numbers
    state: dict = {}
    room = 4_000_000 * 8 // max(8, len(model.languages))

    def make(batch: pa.RecordBatch) -> dict:
        if not state:
            state["labeller"] = Labeller(sent.value)
        return state["labeller"].label(as_text(batch, text_col))

    return map_texts(docs, make, "lang_pred string, score double, spans string", text_col, most_bytes=room)
