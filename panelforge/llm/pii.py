"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels further mentions in a document. Its nodes are the base spans, which
are observed, the tokens outside them that hold a digit or an ``@``, and the tokens that repeat a part of a base span. Its edges
are the chain (next node, at most ``CHAIN`` characters on) and skip edges between distant mentions that are alike: the same letters and digits, the same
last digits of a number, or the name part of an e-mail address. Every mention has an edge to each node alike of known label (a base
span or a "none"), however far off; as their labels are fixed, these edges are counts per key, in linear time. Mentions without a known label are
also linked one to the next of their key. Loopy message passing (sum-product, damped, until it has converged) carries labels along the edges, which
makes a document label its mentions alike: a number written another way, or a name that stands in an
address, gets the label of the mention that a pattern recognised. Tokens that are like no base span only carry context: their label is
"none", as the patterns have seen and refused them. Base spans always stay.

Weights are fitted by penalised pseudo-likelihood on a bounded sample of documents, with base spans as labels. Tokens that are
alike to a base span are left out of the targets, as no one labelled them. Without samples the weights are the prior's.

Offsets count code points, ends are exclusive. Null texts are empty and have no spans. All work on a document is near linear
in its length, whatever its characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import as_text, map_texts, slices
from panelforge.llm.quality_rules import hashed_sample

KINDS = ("email", "ip", "card", "phone")
#: Largest distance in characters between two nodes of a chain edge.
CHAIN = 40
#: Documents on which the weights are fitted, about, and nodes of a document that count there.
SAMPLE_ROWS = 4_000
SAMPLE_NODES = 200
DAMPING = 0.5
#: Message passing ends when no message of a document changes more than this; the damping of documents that swing grows every SETTLE rounds.
CONVERGED = 1e-6
SETTLE = 100
#: A node is a mention if its label other than "none" reaches this marginal.
SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits cannot match where the start of the run did not, so those starts are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Works outwards from each ``@``: a name has none, so any match that uses this one starts at the left end of the run."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _card(match: str) -> bool:
    digits = _digits(match)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _card(m.group())]
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---- the graph of a document

FEATURES = ("bias", "at", "dots", "plus", "hyphens", "letters_digits", "digits", "digits_1_4", "digits_5_8", "digits_9_12", "digits_13_19", "digits_20", "assigned", "no_digit")


def features(token: str) -> list[int]:
    n = sum(map(len, _DIGITS.findall(token)))
    letters = any(c.isalpha() for c in token)
    on = [True, "@" in token, token.count(".") >= 2, "+" in token, "-" in token, letters and n > 0, n > 0 and not letters,
          1 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n >= 20, "=" in token or '"' in token, n == 0]
    return [i for i, x in enumerate(on) if x]


def keys(text: str, email: bool) -> list[str]:
    """What a mention shares with others that are alike."""
    skeleton = "".join(c for c in text.casefold() if c.isalnum())
    out = ["w" + skeleton] if len(skeleton) >= 5 else []
    digits = _digits(text)
    if len(digits) >= 9:
        out.append("n" + digits[-9:])
    if email:
        name = "".join(c for c in text[:text.index("@")].casefold() if c.isalnum())
        if len(name) >= 5:
            out.append("w" + name)
    return out


class Graph:
    """Nodes and edges of one document. ``label`` is the observed label (kind + 1), or 0."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        nodes: list[tuple[int, int, int]] = []  # start, end, label
        taken = []
        for kind, a, b in sorted(base, key=lambda s: (s[1], -s[2], s[0])):
            if not taken or a >= taken[-1][1]:
                taken.append((a, b))
            elif b > taken[-1][1]:
                taken[-1] = (taken[-1][0], b)
            nodes.append((a, b, kind + 1))
        known = {k for a, b, y in nodes for k in keys(text[a:b], y == 1)}
        at = 0
        for m in _TOKEN.finditer(text) if base or _MARKED.search(text) else ():
            token = m.group()
            marked = _MARKED.search(token) is not None
            if not marked and (len(token) < 5 or not known):
                continue
            a, b = m.start(), m.end()
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at < len(taken) and taken[at][0] < b:
                continue
            while a < b and not text[a].isalnum():
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a < b and (marked or not known.isdisjoint(keys(text[a:b], False))):
                nodes.append((a, b, 0))
        nodes.sort()
        self.nodes = nodes
        self.features = [features(text[a:b]) for a, b, _ in nodes]
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CHAIN]
        shared = [sorted(set(keys(text[a:b], y == 1))) for a, b, y in nodes]
        self.alike = [y == 0 and not known.isdisjoint(ks) for (_, _, y), ks in zip(nodes, shared)]
        self.around = _around(shared, [-1 if free else y for free, (_, _, y) in zip(self.alike, nodes)])
        last: dict[str, int] = {}
        skip: dict[tuple[int, int], None] = {}
        for i, ks in enumerate(shared):
            for k in ks if self.alike[i] else ():
                if k in last:
                    skip[(last[k], i)] = None
                last[k] = i
        self.skip = list(skip)


def _around(shared: list[list[str]], label: list[int]) -> list[tuple[int, int, int]]:
    """(node, label, count of other nodes with that known label that share a key with it), where not zero.

    A node that shares several keys counts once: sets of keys are counted too, and added with alternating signs.
    """
    sets = [[(c, 1 if size % 2 else -1) for size in range(1, len(ks) + 1) for c in combinations(ks, size)] for ks in shared]
    count = Counter((c, y) for cs, y in zip(sets, label) if y >= 0 for c, _ in cs)
    out = []
    for i, (cs, own) in enumerate(zip(sets, label)):
        for y in range(len(KINDS) + 1) if cs else ():
            n = sum(sign * count[c, y] for c, sign in cs if (c, y) in count) - (own == y)
            if n:
                out.append((i, y, n))
    return out


class Batch:
    """Graphs laid end to end, as arrays. ``around`` counts the known labels of the nodes alike, ``graph`` numbers the graph of a node."""

    def __init__(self, graphs: list[Graph]):
        base = np.cumsum([0] + [len(g.nodes) for g in graphs])
        self.size = int(base[-1])
        self.label = np.array([y for g in graphs for _, _, y in g.nodes], dtype=np.int64)
        self.alike = np.array([x for g in graphs for x in g.alike], dtype=bool)
        rows = np.array([(n, f) for n, fs in enumerate(fs for g in graphs for fs in g.features) for f in fs], dtype=np.int64).reshape(-1, 2)
        self.x = np.zeros((self.size, len(FEATURES)))
        self.x[rows[:, 0], rows[:, 1]] = 1.0
        pairs = [(a + o, b + o, s) for g, o in zip(graphs, base.tolist()) for s, es in ((0, g.chain), (1, g.skip)) for a, b in es]
        self.edges = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.around = np.zeros((self.size, len(KINDS) + 1))
        for g, o in zip(graphs, base.tolist()):
            for i, y, n in g.around:
                self.around[o + i, y] = n
        self.graph = np.repeat(np.arange(len(graphs)), np.diff(base))


class Model:
    """unary (features x labels), pair (2 x labels x labels): chain and skip."""

    def __init__(self):
        n = len(KINDS) + 1
        self.unary = np.zeros((len(FEATURES), n))
        self.unary[0, 0] = 2.0
        self.unary[FEATURES.index("no_digit"), 0] = 2.0  # a plain word that is also part of an address
        self.pair = np.zeros((2, n, n))
        self.pair[1] = 4.0 * np.eye(n) - 1.0

    def fit(self, batch: Batch, steps: int = 300, rate: float = 0.05, penalty: float = 0.002) -> Model:
        """Penalised pseudo-likelihood: every target given its neighbours' labels, by Adam steps from the prior."""
        target = np.flatnonzero(~batch.alike)
        if not len(target) or not batch.label.any():
            return self
        n = len(KINDS) + 1
        seen = np.eye(n)[batch.label]
        seen[batch.alike] = 0.0
        around = np.stack([np.zeros((batch.size, n)), batch.around])
        chain = batch.edges[batch.edges[:, 2] == 0]
        for a, b in ((0, 1), (1, 0)):
            np.add.at(around[0], chain[:, a], seen[chain[:, b]])
        x, y = batch.x[target], seen[target]
        prior = [self.unary.copy(), self.pair.copy()]
        weight = [self.unary, self.pair]
        first, second = [np.zeros_like(w) for w in weight], [np.zeros_like(w) for w in weight]
        for step in range(1, steps + 1):
            score = x @ weight[0] + around[0][target] @ weight[1][0] + around[1][target] @ weight[1][1]
            p = np.exp(score - score.max(axis=1, keepdims=True))
            gap = (p / p.sum(axis=1, keepdims=True) - y) / len(target)
            pair = np.stack([around[s][target].T @ gap for s in (0, 1)])
            pair = (pair + pair.transpose(0, 2, 1)) / 2
            for w, g, was, m, v in zip(weight, (x.T @ gap, pair), prior, first, second):
                g = g + penalty * (w - was)
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def marginals(self, batch: Batch, rounds: int | None = None) -> np.ndarray:
        """Loopy sum-product over all graphs of the batch at once, each until it has converged (or for ``rounds``); exact where a graph is a tree."""
        own = batch.x @ self.unary + batch.around @ self.pair[1]
        own = own - own.max(axis=1, keepdims=True)
        fixed = (batch.label > 0) | ~batch.alike  # a token that is like no base span is none: its pattern has decided
        own[fixed] = -40.0
        own[fixed, batch.label[fixed]] = 0.0
        edges = batch.edges[~(fixed[batch.edges[:, 0]] & fixed[batch.edges[:, 1]])]
        if not len(edges):
            return _normal(own)
        source = np.r_[edges[:, 0], edges[:, 1]]
        target = np.r_[edges[:, 1], edges[:, 0]]
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        factor = np.exp(self.pair[np.r_[edges[:, 2], edges[:, 2]]])
        message = np.zeros((len(source), own.shape[1]))
        graph = batch.graph[source]
        live, done, damping = np.arange(len(source)), 0, DAMPING
        while len(live) and done != rounds:
            belief = own.copy()
            np.add.at(belief, target[live], message[live])
            out = belief[source[live]] - message[back[live]]
            out = np.log(np.einsum("ei,eij->ej", np.exp(out - out.max(axis=1, keepdims=True)), factor[live]))
            out -= out.max(axis=1, keepdims=True)
            change = np.zeros(len(batch.graph) and int(batch.graph[-1]) + 1)
            np.maximum.at(change, graph[live], np.abs(out - message[live]).max(axis=1))
            message[live] = damping * message[live] + (1 - damping) * out
            done += 1
            if done % SETTLE == 0:
                damping = (1 + damping) / 2
            # Halves of an edge are of one graph, so what stays holds both.
            live = live[change[graph[live]] >= CONVERGED / (1 - damping) * (1 - DAMPING)]
        belief = own.copy()
        np.add.at(belief, target, message)
        return _normal(belief)


def _normal(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_nodes: int = SAMPLE_NODES) -> Model:
    """Weights from a sample of at most ``sample_rows`` documents and the first ``sample_nodes`` mentions of each. Only feature numbers and edges reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            label, alike, feats, edges, around = [], [], [], [], []
            for text in as_text(batch, "_text"):
                g = Graph(text, base_spans(text))
                n = min(len(g.nodes), sample_nodes)
                label.append([y for _, _, y in g.nodes[:n]])
                alike.append([int(v) for v in g.alike[:n]])
                feats.append([i * len(FEATURES) + f for i in range(n) for f in g.features[i]])
                edges.append([(a * n + b) * 2 for a, b in g.chain if b < n])
                around.append([v for e in g.around if e[0] < n for v in e])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=kind) for v in (label, alike, feats, edges, around)], names=["label", "alike", "feats", "edges", "around"])

    sample = hashed_sample(docs, id_col, text_col, sample_rows)
    found = sample.mapInArrow(run, "label array<long>, alike array<long>, feats array<long>, edges array<long>, around array<long>").where(F.size("label") > 0)
    rows = sorted(tuple(map(tuple, r)) for r in found.collect())  # bounded: see sample_rows and sample_nodes
    batch = Batch([])
    sizes = [len(r[0]) for r in rows]
    base = np.cumsum([0] + sizes)
    batch.size = int(base[-1])
    batch.label = np.array([y for r in rows for y in r[0]], dtype=np.int64)
    batch.alike = np.array([v for r in rows for v in r[1]], dtype=bool)
    batch.x = np.zeros((batch.size, len(FEATURES)))
    batch.x.reshape(-1)[[o * len(FEATURES) + f for r, o in zip(rows, base.tolist()) for f in r[2]]] = 1.0
    batch.edges = np.array([(o + e // 2 // n, o + e // 2 % n, e % 2) for r, o, n in zip(rows, base.tolist(), sizes) for e in r[3]], dtype=np.int64).reshape(-1, 3)
    counts = np.array([(o + i, y, c) for r, o in zip(rows, base.tolist()) for i, y, c in zip(r[4][::3], r[4][1::3], r[4][2::3])], dtype=np.int64).reshape(-1, 3)
    batch.around = np.zeros((batch.size, len(KINDS) + 1))
    batch.around[counts[:, 0], counts[:, 1]] = counts[:, 2]
    return Model().fit(batch)


def label(model: Model, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) per text, each by kind and start."""
    bases = [base_spans(t) for t in texts]
    graphs = [Graph(t, b) for t, b in zip(texts, bases)]
    batch = Batch(graphs)
    out, at = [], 0
    p = model.marginals(batch) if batch.size else np.empty((0, len(KINDS) + 1))
    best = p[:, 1:].argmax(axis=1) if batch.size else np.empty(0, dtype=np.int64)
    for g, base in zip(graphs, bases):
        added = []
        for i, (a, b, y) in enumerate(g.nodes):
            if not y and p[at + i, 1 + best[at + i]] >= SURE:
                added.append((int(best[at + i]), a, b))
        at += len(g.nodes)
        out.append((base, sorted({*base, *added})))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (kind:start:end, comma-joined) to every row."""
    model = fit(docs, id_col, text_col, sample_rows)

    def make(batch: pa.RecordBatch) -> dict:
        found = label(model, as_text(batch, text_col))
        return {"base_spans": [digest(b) for b, _ in found], "spans": [digest(s) for _, s in found]}

    return map_texts(docs, make, "base_spans string, spans string", text_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind that starts first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Replace every span in the text by its kind; other columns and null texts stay as they are."""
    model = fit(docs, id_col, text_col, sample_rows)

    def make(batch: pa.RecordBatch) -> dict:
        texts = as_text(batch, text_col)
        valid = batch.column(batch.schema.get_field_index(text_col)).is_valid().to_pylist()
        return {text_col: [redacted(t, s) if v else None for t, v, (_, s) in zip(texts, valid, label(model, texts))]}

    names = docs.columns
    return map_texts(docs, make, f"`{text_col}` string", text_col).select(*names)
