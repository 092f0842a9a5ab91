"""Token alignment, the Merkle manifest and language spans against brute-force versions, and their edge cases."""

import hashlib
import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import catalog, language, manifest, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")
vocabularies = pytest.mark.skipif(not os.path.isdir(tokens.FOLDER), reason="vocabularies not present")


# ---- alignment

TEXTS = [
    "The quick brown fox doesn't jump.", "  two  spaces\tand a tab\n\nlines  ", "", None, "Ünïcödé straße – ‘quoted’ … ¿qué?", "日本語のテキスト and кириллица 🙂👩‍👩‍👧",
    "<|endoftext|> </s> <s> <unk> <0x41>", "a▁b", "x" * 3000, "1234567890 12 3", "The quick brown fox doesn't jump.", "\x00\x01 control \x7f", " ", "　wide space é combining", "ends in space ",
    "don't DON'T we'll I'm", "word " * 700,
]


def slow_sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(os.path.join(tokens.FOLDER, tokens.FILE_A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=os.path.join(tokens.FOLDER, tokens.FILE_B))


def slow_ranges(text):
    """[(id, start, end)] of both sides, or nothing."""
    a, b = slow_sides_cached()
    if not text:
        return [], []
    whole = (" " + text).encode()
    letters = tokens._byte_letters()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    told_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a]
    told_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        told_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in told_a) != whole or b"".join(x for _, x in told_b) != whole:
        return [], []
    out = []
    for told in (told_a, told_b):
        at, rows = 0, []
        for i, x in told:
            rows.append((i, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return out


_SIDES = []


def slow_sides_cached():
    if not _SIDES:
        _SIDES.append(slow_sides())
    return _SIDES[0]


def slow_alignment(texts):
    rows, links_of = [], []
    for t in texts:
        a, b = slow_ranges(t)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links = [(i, j) for i, _, e in a for j, _, f in b if e == f] if len(a) < 2000 else [(i, j) for e in ends for i in [x for x, _, y in a if y == e] for j in [x for x, _, y in b if y == e]]
        groups, last = [], 0
        for e in ends:
            inside = lambda side: ",".join(str(i) for i, _, f in side if last < f <= e)  # noqa: E731, B023
            groups.append(inside(a) + "|" + inside(b))
            last = e
        over = sum(1 for _, s, e in a for _, u, f in b if s < f and u < e) if len(a) < 500 else None
        rows.append({"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(links), "groups": ";".join(groups), "n_overlaps": over})
        links_of.append(links)
    count = Counter(x for links in links_of for x in links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    for row, links in zip(rows, links_of):
        row["n_best"] = sum(count[x] == best[x[1]] for x in links)
        row["count_sum"] = sum(count[x] for x in links)
    return rows


@vocabularies
def test_alignment_against_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("groups", F.lit("clash")).withColumn("extra", F.lit(7))
    want = slow_alignment(TEXTS)
    aligned = tokens.align(docs)
    got = {r["doc_id"]: r for r in aligned.collect()}
    for i, w in enumerate(want):
        assert {k: got[i][k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")} == {k: w[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups")}, TEXTS[i]
        assert w["n_overlaps"] in (None, got[i]["n_overlaps"])
    assert got[0]["extra"] == 7 and want[0]["n_links"] > 5 and want[5]["n_links"] > 5 and want[7]["n_a"] == 0
    for hot in (tokens.HOT, 3, 0):
        whole = {r["doc_id"]: (r["n_best"], r["count_sum"]) for r in tokens.consistency(aligned, hot).collect()}
        assert whole == {i: (w["n_best"], w["count_sum"]) for i, w in enumerate(want)}


@vocabularies
def test_both_encoders_agree_where_the_fast_one_is_used():
    sides = tokens.Sides()
    assert sides.fast is not None
    r = random.Random(3)
    letters = [chr(c) for c in [*range(0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201A, 0x201B, 0x201C, 0x201D, 0x201E, 0x2026] if sides.common.fullmatch(chr(c))]
    assert len(letters) > 590
    texts = [f"a{c}b {c}{c} 1{c}2 \n{c} {c}'s" for c in letters] + ["".join(r.choice(letters + [" ", "e", "\n"] * 40) for _ in range(60)) for _ in range(1500)]
    for t in texts:
        assert sides.encode_a(t).tolist() == sides.exact.encode(" " + t, add_special_tokens=False).ids, repr(t)


@vocabularies
def test_alignment_edge_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert tokens.consistency(tokens.align(empty).select("doc_id", "n_a", "pairs", "times")).count() == 0
    rows = [(None, "same text", "x"), (None, "same text", "x"), (1, None, None), (1, "", None)]
    got = tokens.consistency(tokens.align(spark.createDataFrame(rows, "doc_id long, text string, n_best string"))).collect()
    assert len(got) == 4 and sorted(r["n_links"] for r in got)[:2] == [0, 0]
    # Each pair is linked twice in all, so it is the best of its id unless an id repeats within the text.
    assert all(r["count_sum"] == 2 * r["n_links"] for r in got)


@vocabularies
def test_vocabularies_are_read_once_by_a_worker(monkeypatch):
    made, plain = [], tokens.Sides
    monkeypatch.setattr(tokens, "Sides", lambda *files: made.append(files) or plain(*files))
    tokens.sides_of.cache_clear()
    both = [tokens.sides_of(tokens.FOLDER, tokens.FILE_A, tokens.FILE_B) for _ in range(2)]
    tokens.sides_of.cache_clear()
    assert both[0] is both[1] and len(made) == 1


@vocabularies
def test_spelled_bytes_are_compared_text_by_text():
    """Only the texts whose own tokens spell them are kept, whatever stands beside them; letters beyond ASCII and texts without tokens count."""
    sides = tokens.Sides()
    texts = ["straße", "日本", "plain", "two  spaces"]
    ids = [sides.encode_a(t) for t in texts]
    whole = [(" " + t).encode() for t in texts]
    assert tokens._spells(ids, sides.spelled_a, whole) == [True] * 4
    assert tokens._spells([ids[0], ids[1][:-1], ids[2], ids[2]], sides.spelled_a, whole) == [True, False, True, False]
    none = np.array([], dtype=np.uint32)
    assert tokens._spells([none, ids[2], none], sides.spelled_a, [b"x", whole[2], b""]) == [False, True, True]
    assert tokens._spells([none], sides.spelled_a, [b"x"]) == [False] and tokens._spells([], sides.spelled_a, []) == []
    kept, ids_a, ids_b = sides.encode(["a▁b", "straße", "", "plain"])
    assert kept == [1, 3] and [x.tolist() for x in ids_a] == [ids[0].tolist(), ids[2].tolist()] and len(ids_b) == 2


# ---- manifest

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def slow_manifest(rows):
    """{(id, leaf): (subroot, root, proof, folded, verified)} of rows (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return sha("".join(written(v) for v in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """(root, sibling lists per leaf)."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        steps = []
        for p in range(len(nodes)):
            own = []
            for k, level in enumerate(levels[:-1]):
                at = p // 8 ** k
                run = at // 8 * 8
                own.append((level[run:at], level[at + 1:run + 8]))
            steps.append(own)
        return levels[-1][0], steps

    trees = defaultdict(list)
    for r in rows:
        lowered = r[1]
        if lowered is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0:
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in lowered)
        trees[r[2]].append((r[0], leaf(r, r[1]), leaf(r, lowered)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in order:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        tops[lang] = climb([x[1] for x in trees[lang]])
    root, upper = climb([tops[lang][0] for lang in order])
    out = []
    for i, lang in enumerate(order):
        for (doc, own, check), steps in zip(trees[lang], tops[lang][1]):
            path = steps + upper[i]
            folded = check
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            proof = sha("".join("".join(left) + "".join(right) for left, right in path))
            out.append((doc, own, tops[lang][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 9}, {"en": 65, "de": 1, "": 17, "z": 2, "é": 3}, {str(i): 2 for i in range(11)}, {"en": 513}])
def test_manifest_against_brute_force(spark, sizes):
    r = random.Random(str(sizes))
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "Some Text", "no capitals", "ÄÖ Ü é 日本"])
            rows.append((r.choice([None, i, i, i, 7]), text, lang, r.choice([None, "", "src"]), r.choice([None, len(text or "")])))
            i += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit("clash"))
    found = manifest.verify(manifest.manifest(docs, check={"text": manifest.tampered("text", "doc_id")}))
    got = found.select("id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == slow_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.verify(manifest.manifest(spark.createDataFrame([], DOCS))).count() == 0


@tables
def test_whole_manifest(spark):
    got = catalog.queries()["op12_manifest"](spark, SMALL).collect()
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SMALL}/documents.parquet'").fetchall()
    assert sorted((tuple(r) for r in got), key=str) == slow_manifest(rows)


# ---- language

def path_score(scores, labels, switch):
    return sum(scores[i][k] for i, k in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 3, (40, 3))
    count = np.array([0, 1, 6, 3, 0, 7, 2, 5])
    words = rng.integers(0, 40, count.sum())
    labels = language.viterbi(scores, words, count, 2.5)
    end = np.cumsum(count)
    for i, n in enumerate(count):
        own = scores[words[end[i] - n:end[i]]]
        best = max((path_score(own, p, 2.5) for p in itertools.product(range(3), repeat=int(n))), default=0.0)
        assert path_score(own, labels[end[i] - n:end[i]].tolist(), 2.5) == pytest.approx(best)


def test_letter_runs_against_slices():
    words = ["a", "Été", "xyzzy", "日本"]
    place, owner = language.runs_of(words)
    for i, w in enumerate(words):
        marked = f"\x00{w.lower()}\x00"
        runs = [marked[j:j + n] for n in range(1, language.LONGEST + 1) for j in range(len(marked) - n + 1)]
        assert (owner == i).sum() == len([x for x in runs if x != "\x00"])
    one, two = language.runs_of(["ab"])[0], language.runs_of(["zz", "ab"])
    assert sorted(one) == sorted(two[0][two[1] == 1])


EN, RU, DE = "the cat sat on the mat and the dog ran to the house with a hat", "кошка сидела на ковре и собака бежала домой к своей миске", "der hund lief zu dem haus und die katze blieb auf der matte liegen"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, n) for i, (t, n) in enumerate([(EN, "en"), (EN.upper(), "en"), (RU, "ru"), (DE, "de"), (None, "de"), ("ohne", None), ("", "xx")])]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts(spark, model):
    assert model.languages == ["en", "de", "ru", "xx"]
    mixed = f"{EN}. 12 {RU}!"
    long = f"{EN} {DE} " * 400
    texts = [mixed, EN, RU, DE, None, "", "123 ...", "日本語", long, mixed]
    docs = spark.createDataFrame([(None if i == 9 else i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, other int")
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert got[0]["spans"] == f"en:0:{len(EN)},ru:{len(EN) + 5}:{len(EN) + 5 + len(RU)}" == got[None]["spans"]
    assert [got[i]["lang_pred"] for i in range(4)] == ["en", "en", "ru", "de"] and got[1]["spans"] == f"en:0:{len(EN)}" and got[0]["other"] == 1
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) for i in (4, 5, 6)] == [("und", 0.0, "")] * 3
    assert got[7]["lang_pred"] == "en" and got[7]["score"] == pytest.approx(0.25)
    spans = got[8]["spans"].split(",")
    assert {s.split(":")[0] for s in spans} == {"en", "de"} and 700 <= len(spans) <= 800
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learned_and_no_rows(spark, model):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    nothing = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert [tuple(r) for r in language.identify(docs, nothing).select("lang_pred", "score", "spans").collect()] == [("und", 0.0, "")]
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.learn(spark.createDataFrame([], "text string, lang string")).languages == []


@tables
def test_held_out_languages(spark):
    got = catalog.queries()["op13_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def test_words_of_plain_texts():
    """ASCII texts go through the plainer pattern, which finds the same words; words are numbered in order of first sight."""
    from panelforge.llm import language

    every = "".join(map(chr, range(128)))
    for text in ("", "It's a b2b deal_of x-y. Z", every, every[::-1], "é a1b ǆ", "aͅb  ̀c", "a" * 5000 + "1b"):
        assert language.words_of(text) == language._WORD.findall(text)
    numbers = language.Numbers()
    assert [numbers[w] for w in "b a b c a".split()] == [0, 1, 0, 2, 1] and list(numbers) == ["b", "a", "c"]
