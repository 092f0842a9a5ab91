"""Operators of the text pipeline against brute-force versions, and their edge cases."""

import itertools
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import chat, decontaminate, html_text, mixing, pii, quality_knn, quality_rules, simhash, toxicity, warc
from panelforge.llm.common import components, remainder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="tables not present")


def docs_of(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ---- SimHash

def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, bits):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= bits:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def texts_with_copies():
    texts = []
    for s in range(12):
        words = prose(s, 300)
        texts.append(" ".join(words))
        for j in range(3):
            other = words[:]
            for x in range(1 + 2 * j):
                other[37 * x + s] = f"edit{j}"
            texts.append("  ".join(other).upper() if j == 0 else "\n".join(other))
    return [*texts, "", None, "one two", "ONE\ttwo", "É one", "x " * 5000]


def test_simhash_against_brute_force(spark):
    texts = texts_with_copies()
    want = [slow_fingerprint(t, 4) for t in texts]
    root = slow_components(want, 4)
    for cell_rows in (simhash.CELL_ROWS, 2):
        got = simhash.near_duplicates(docs_of(spark, texts), cell_rows=cell_rows).collect()
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{v:016x}" for i, v in enumerate(want)}
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))
    assert len(set(root)) < len(texts) - 10


def test_simhash_search_of_a_large_cell():
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(60)]
    x = np.array(sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (2**64 - 1) for c in centres for _ in range(9)}), dtype=np.uint64)
    a, b = simhash.linked(np.zeros(len(x), dtype=np.int64), x, np.zeros(len(x), dtype=np.int64), 4)
    want = slow_components([int(v) for v in x], 4)
    parent = {int(v): int(v) for v in x}
    parent.update({int(p): int(q) for p, q in zip(a, b)})

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    groups = [top(int(v)) for v in x]
    assert len(set(groups)) == len(set(want)) == len(set(zip(groups, want)))


def test_simhash_edge_cases(spark):
    empty = docs_of(spark, []).withColumn("fp", F.lit("clash"))
    assert simhash.near_duplicates(empty).count() == 0
    same = spark.createDataFrame([(None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x"), (2, None, None)], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(same).select("doc_id", "component_id").collect()), key=str)
    assert got == [(2, 2), (3, 3), (3, 3), (None, 3)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(51)}}


# ---- quality rules

def slow_repeats(words, k):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i:i + k]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)})


def test_repeat_words_against_brute_force():
    for seed in range(30):
        words = [w.encode() for w in prose(seed, 200, 3)]
        assert quality_rules.repeat_words(words, 8) == slow_repeats(words, 8)
    assert quality_rules.repeat_words([b"a"] * 9, 8) == 9 and quality_rules.repeat_words([], 8) == 0


def test_cascade_order_changes_no_verdict(spark):
    texts = [" ".join(prose(1, 60)), "a b c", None, "", "* # $ " * 20, ("same line here\n") * 30, "x" * 3000 + " y " * 30, " ".join(prose(2, 4000))]
    docs = docs_of(spark, texts).withColumn("kept", F.lit("clash"))
    one = {r["doc_id"]: r for r in quality_rules.cascade(docs).collect()}
    two = {r["doc_id"]: r for r in quality_rules.cascade(docs, quality_rules.rules()[::-1]).collect()}
    assert one == two
    assert [one[i]["kept"] for i in range(8)] == [True, False, False, False, False, False, False, True]
    assert one[5]["n_dup_lines"] == 29 and one[2]["n_words"] == 0
    assert quality_rules.cascade(docs.limit(0)).count() == 0


def test_rules_are_ordered_by_rejection_per_cost():
    given = [quality_rules.Rule(n, lambda f: False) for n in "abc"]
    got = quality_rules.ordered(given, [("a", 1.0, 0.5), ("b", 0.1, 0.2), ("c", 2.0, 0.0)])
    assert [r.name for r in got] == ["b", "a", "c"]


# ---- mixing

def slow_targets(size_of, most):
    names = sorted((n for n in size_of if n is not None)) + ([None] if None in size_of else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped, total = {}, sum(size_of.values())
    while True:
        left = total - sum(capped.values())
        open_ = [n for n in names if n not in capped]
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n: most * size_of[n] for n in open_ if share[n] > most * size_of[n]}
        if not over:
            return {**capped, **share}
        capped.update(over)


def test_mixing_meets_its_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(prose(i, r.choice([0, 3, 40, 200]))) or None, r.choice(["a"] * 8 + ["b", "c", "d", None])) for i in range(300)]
    rows += [(900, "only words here", "zz"), (901, "tiny", "y"), (5, rows[5][1], rows[5][2]), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    for block_words, shard_blocks in ((65_536, 64), (200, 4)):
        mixed = mixing.mix(docs, block_words=block_words, shard_blocks=shard_blocks)
        got = mixed.collect()
        size_of = {}
        for _, t, s in rows:
            size_of[s] = size_of.get(s, 0) + len((t or "").split())
        want = slow_targets(size_of, 3)
        assert len(got) == len(rows)
        for s in size_of:
            mine = [g for g in got if g["source"] == s]
            assert all(abs(g["target"] - want[s]) < 1e-6 and g["source_size"] == size_of[s] for g in mine)
            assert sum(g["taken"] for g in mine) == int(want[s] + 1e-9)
        assert all(g["taken"] <= 3 * g["size"] and g["taken"] == sum(d["words"] for d in g["draws"]) for g in got)
        assert all(len({d["pass"] for d in g["draws"]}) == len(g["draws"]) for g in got)
        again = mixing.mix(docs, block_words=block_words, shard_blocks=shard_blocks).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
        if shard_blocks == 4:
            assert mixing.shards(mixed).select("shard").distinct().count() > 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = [7, 0, 130, 31]
    row = spark.createDataFrame([(quotas,)], "q array<long>")
    got = mixing.splitting_tree(row, 11).collect()
    assert [sum(g["n"] for g in got if g["i"] == i) for i in range(4)] == quotas
    per = [sum(g["n"] for g in got if g["shard"] == s) for s in range(11)]
    assert max(per) - min(per) <= 4 and sum(per) == sum(quotas)


def test_hypergeometric_frequencies(spark):
    from math import comb
    draw = mixing.hypergeometric(F.lit(30), F.lit(12), F.lit(9), mixing._uniform(F.col("id")))
    got = {r["x"]: r["count"] / 20_000 for r in spark.range(20_000).select(draw.alias("x")).groupBy("x").count().collect()}
    for x in range(10):
        assert abs(got.get(x, 0) - comb(12, x) * comb(18, 9 - x) / comb(30, 9)) < 0.015


# ---- decontamination

def slow_contamination(texts, items, width):
    out = []
    split = [decontaminate.words(t or "") for t in texts]
    windows = {}
    for item, text in items:
        w = decontaminate.words(text or "")
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item)
    for w in split:
        hit, names = set(), set()
        for phrase, held in windows.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i:i + len(phrase)]) == phrase:
                    hit.update(range(i, i + len(phrase)))
                    names.update(x for x in held if x is not None)
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_decontamination_against_brute_force(spark):
    items = [(str(i), " ".join(prose(100 + i, 20, 30))) for i in range(12)] + [("40", "w1 w2"), ("41", None), ("42", "..."), (None, "w3 w4 w3"), ("9", "w1 w2")]
    texts = [" ".join(prose(i, 80, 30)) for i in range(30)]
    texts += [f"{texts[0]} {items[3][1].upper()}! {texts[1]}", items[5][1], items[6][1][:60], None, "", "é " + items[2][1] + " é", " ".join([items[1][1]] * 40)]
    docs = docs_of(spark, texts).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("hits", F.lit(1))
    want = slow_contamination(texts, items, 13)
    for block_words in (decontaminate.BLOCK_WORDS, 120):
        got = decontaminate.decontaminate(docs, bench, block_words=block_words).withColumn("n_hit", decontaminate.n_hit()).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == dict(enumerate(want))
    assert sum(1 for _, n, _ in want if n) > 5
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert {r["n"] for r in decontaminate.decontaminate(docs, bench.limit(0)).select(F.size("hits").alias("n")).collect()} == {0}


def test_shards_of_an_index_do_not_run_into_each_other(spark):
    texts = ["a b", "c d", "b c", "a b c d"] * 5
    phrases = decontaminate.Phrases([(["i"], "b c")], 13)
    indexed = decontaminate.index(docs_of(spark, texts).coalesce(1), phrases.vocabulary, shard_words=150)
    found = decontaminate.search(indexed, phrases).collect()
    assert [tuple(r["hits"]) for r in sorted(found, key=lambda r: r["doc_id"])] == [(), (), (0, 2), (1, 3)] * 5
    assert indexed.where("term < 0").count() > 1


def test_proximity(spark):
    texts = ["red x x x blue", "red " + "x " * 30 + "blue", "blue red", "red red"]
    bench = spark.createDataFrame([("i", "red blue")], "item_id string, text string")
    got = decontaminate.decontaminate(docs_of(spark, texts), bench, near_terms=2, slop=5).orderBy("doc_id").collect()
    assert [r["near_items"] for r in got] == [["i"], [], ["i"], []]


def slow_proximity(texts, items, width, terms, slop):
    split = [decontaminate.words(t or "") for t in texts]
    seen = {}
    for w in (x for s in split for x in s):
        seen[w] = seen.get(w, 0) + 1
    near = [set() for _ in texts]
    for item, text in items:
        w = decontaminate.words(text or "")
        for i in range(max(1, len(w) - width + 1) if w else 0):
            rare = sorted(dict.fromkeys(w[i:i + width]), key=lambda x: seen.get(x, 0))[:terms]
            for d, s in enumerate(split):
                if any(s[p] == rare[0] and all(t in s[max(0, p - slop):p + slop + 1] for t in rare[1:]) for p in range(len(s))):
                    near[d].add(item)
    return [sorted(x for x in n if x is not None) for n in near]


@pytest.mark.parametrize("terms, slop", [(4, 5), (6, 12), (3, 150)])
def test_proximity_against_brute_force(spark, terms, slop):
    # Many short documents lie side by side in a shard; a slop beyond the usual gap must not reach over their ends. Short items use all their words.
    items = [(str(i), " ".join(prose(100 + i, 18, 40))) for i in range(10)] + [("short", "w1 w2"), ("one", "w7"), (None, "w3 w4"), ("copy", "w1 w2"), ("none", "zz w1")]
    texts = [" ".join(prose(i, 40, 40)) for i in range(60)] + [" ".join(reversed(items[4][1].split())), None, "w1", "w2", "w7"] * 2
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = slow_proximity(texts, items, 13, terms, slop)
    got = decontaminate.decontaminate(docs_of(spark, texts).coalesce(1), bench, near_terms=terms, slop=slop).collect()
    assert {r["doc_id"]: r["near_items"] for r in got} == dict(enumerate(want))
    assert any("4" in w for w in want[60:]) and any("copy" in w for w in want)


def test_repeated_items_are_one_text_and_ids_keep_their_type(spark):
    same = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(str(i), same) for i in range(500)] + [("other", "nothing of this")], "item_id string, text string")
    blocks = decontaminate.item_blocks(bench.select(F.col("item_id").alias("item"), "text"), 400)
    assert sum(b.count() for b in blocks) == 2 and len(blocks) == 1
    docs = spark.createDataFrame([("a", same), ("b", "nothing"), (None, same)], "doc_id string, text string")
    got = decontaminate.decontaminate(docs, bench, near_terms=6, slop=12).collect()
    assert sorted((r["doc_id"] or "", len(r["items"]), len(r["near_items"])) for r in got) == [("", 500, 500), ("a", 500, 500), ("b", 0, 0)]


# ---- personal data

def slow_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def good(k, m):
        digits = re.sub(r"[^0-9]", "", m)
        if k == 1:
            return all(int(p) <= 255 for p in m.split("."))
        if k == 2:
            ok = [int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(ok) % 10 == 0
        return k == 0 or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if good(k, m.group())]


def test_patterns_against_plain_ones():
    r = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "u_v%@d-e.f.g.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (648) 555-1250",
              "+12", "+1 ((((", "é", " ", "\n", "-", ".", "12", "4425414259157784", "+44.20.7946.0958", "99999999999999999999999", "a@b.c@d.e"]
    for _ in range(600):
        text = "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randrange(12)))
        assert pii.base_spans(text) == slow_spans(text), text


def test_patterns_on_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1 " * 60_000, "a@" * 100_000, "@" * 100_000):
        pii.base_spans(text)


def test_message_passing_is_exact_on_a_chain():
    model = pii.Model()
    text = "1a 22bb 333ccc"
    g = pii.Graph(text, [])
    g.alike = [True] * 3
    g.chain, g.skip = [(0, 1)], [(1, 2)]
    batch = pii.Batch([g])
    got = model.marginals(batch, 60)
    unary, n = batch.x @ model.unary, len(pii.KINDS) + 1
    p = np.zeros((3, n))
    for ys in itertools.product(range(n), repeat=3):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(ys)) + model.pair[0][ys[0], ys[1]] + model.pair[1][ys[1], ys[2]])
        for i, y in enumerate(ys):
            p[i, y] += w
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_alike_mentions_are_labelled_and_others_left_alone(spark):
    text = "Call +1 (648) 555-1250 now. Order 1234567890123456 of version 2.0.1.9999. He wrote from 648-555-1250 again; card 4425414259157784, once 4425.4142.5915.7784."
    (base, spans), (none, clean) = pii.label(pii.Model(), [text, "Order 1234567890123456 of 300.1.1.1 and 12-34"])
    assert {text[a:b] for _, a, b in set(spans) - set(base)} == {"648-555-1250", "4425.4142.5915.7784"}
    assert set(base) <= set(spans) and none == clean == []
    assert "1250" not in pii.redacted(text, spans) and "version 2.0.1.9999" in pii.redacted(text, spans)
    docs = docs_of(spark, [text, None, "", "plain words only"]).withColumn("spans", F.lit("clash"))
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[1]["text"] is None and out[3]["text"] == "plain words only" and "[PHONE]" in out[0]["text"] and out[0]["spans"] == "clash"
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert found[1] == found[2] == found[3] == ""
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 1000])
@pytest.mark.parametrize("gap", [" then ", " and a good deal of other plain words in between "])
def test_every_mention_alike_one_base_span_is_labelled(n, gap):
    after = "Call +1 (648) 555-1250 now." + (gap + "648-555-1250") * n
    for text in (after, ("648-555-1250" + gap) * n + "+1 (648) 555-1250"):
        base, spans = pii.label(pii.Model(), [text])[0]
        assert len(base) == 1 and len(spans) == n + 1 and {k for k, _, _ in spans} == {3}


def test_known_labels_alike_are_counted_once():
    text = "Ask +1 (648) 555-1250, 1-648-555-1250 or 648-555-1250; +1 (648) 555-1250 then 12345678901 a.b.cd@x.com 123456789-01 a-bcd a.b.cd@x.com abcd1 abc-d1"
    g = pii.Graph(text, pii.base_spans(text))
    share = [set(pii.keys(text[a:b], y == 1)) for a, b, y in g.nodes]
    want = {}
    for i, j in itertools.permutations(range(len(share)), 2):
        if share[i] & share[j] and not g.alike[j]:
            want[i, g.nodes[j][2]] = want.get((i, g.nodes[j][2]), 0) + 1
    assert {(i, y): n for i, y, n in g.around} == want and max(want.values()) > 1 and any(g.alike)


# ---- classifiers

@tables
@pytest.mark.parametrize("module, label, parts, held", [(quality_knn, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_held_out_accuracy(spark, module, label, parts, held):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = module.learn(docs, labels.where(remainder("doc_id", parts) != held), label)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "w " * 100_000)], "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    got = module.score(docs.select("doc_id", "text").withColumn("predicted", F.lit("clash")).union(odd), model)
    assert got.where("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count() == docs.count() + 3
    tried = got.join(labels.where(remainder("doc_id", parts) == held), "doc_id")
    right, n = tried.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert right > 0.93 and n > 40
    assert module.score(docs.limit(0), model).count() == 0


def test_rare_toxic_words_are_learned_from_a_full_sample(spark):
    r = random.Random(3)
    n, rare, each = toxicity.SAMPLE_ROWS, 50, 16
    texts = [[f"w{r.randrange(400)}" for _ in range(12)] for _ in range(n)]
    toxic = r.sample(range(n), rare * each)
    for k, i in enumerate(toxic):
        texts[i][r.randrange(12)] = f"{k % rare:03d}bad"
    y = set(toxic)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i in y)) for i in range(n)], "doc_id long, toxic int"), "toxic")
    asked = [[f"w{r.randrange(400)}" for _ in range(11)] + [f"{k:03d}bad" if k < rare else "w1"] for k in range(500)]
    got = toxicity.score(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(asked)], "doc_id long, text string"), model)
    assert got.where(f"doc_id < {rare} and predicted = 1").count() >= 0.9 * rare and got.where(f"doc_id >= {rare} and predicted = 1").count() <= 20


@pytest.mark.parametrize("module", [quality_knn, toxicity])
def test_without_labels_every_score_is_a_half(spark, module):
    docs = docs_of(spark, ["a b", None])
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, y int")
    model = module.learn(docs, labels, "y")
    assert {r["score"] for r in module.score(docs, model).collect()} == {0.5}


def test_nearest_votes_against_brute_force():
    texts = [" ".join(prose(i, 30)).encode() for i in range(40)] + [b"!!! ### $$$ " * (i + 1) for i in range(40)]
    space = quality_knn.fit(texts, [1] * 40 + [0] * 40)
    asked = [b"### !!! $$$ w1", b"w1 w2 w3 w4", b""]
    near = space.project(asked) @ space.vectors.T
    want = []
    for row in near:
        top = np.argsort(-row, kind="stable")[:quality_knn.NEIGHBOURS]
        weight = np.maximum(row[top], 0) ** 4
        want.append(float((weight * space.labels[top]).sum() / weight.sum()) if weight.sum() > 0 else 0.0)
    assert np.allclose(quality_knn.votes(space, asked), want, atol=1e-5)


def test_directions_against_exact_decomposition():
    """Projections on all directions keep every product of the weighted term shares."""
    texts = [" ".join(prose(i, 60, 80)).encode() for i in range(30)]
    space = quality_knn.fit(texts, [1] * 15 + [0] * 15, dims=200)
    x = quality_knn.matrix([quality_knn.terms(t) for t in texts], space.column, len(space.weight)) * space.weight
    u, d, _ = np.linalg.svd(x, full_matrices=False)
    assert space.directions.shape[1] == 30 and np.allclose(space.directions.T @ space.directions, np.eye(30), atol=1e-4)
    want = u * d
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(space.vectors @ space.vectors.T, want @ want.T, atol=1e-3)
    few = quality_knn.leading(x, 5)
    assert np.linalg.norm(x @ few) ** 2 >= 0.98 * (d[:5] ** 2).sum()


def test_labels_that_show_in_the_vocabulary_alone():
    """Both classes have the same word shapes and repetitions; only the words differ."""
    r = random.Random(11)
    words = [[f"{a}{b}{c}e" for a in "bcdf" for b in vowels for c in "lmnr"] for vowels in ("ai", "ou")]
    texts, labels = [], []
    for i in range(300):
        y = i % 2
        texts.append(" ".join(r.choice(words[y]) for _ in range(80)).encode())
        labels.append(y)
    space = quality_knn.fit(texts[:200], labels[:200])
    got = quality_knn.votes(space, texts[200:]) >= 0.5
    assert (got == np.array(labels[200:], dtype=bool)).mean() >= 0.98


def test_sample_is_bounded_where_ids_are_null_or_repeat(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = quality_rules.hashed_sample(rows, "doc_id", "text", 500)
    again = quality_rules.hashed_sample(rows.repartition(7), "doc_id", "text", 500)
    assert got.count() == 500 and sorted(got.collect()) == sorted(again.collect())
    alike = rows.select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert quality_rules.hashed_sample(alike, "doc_id", "text", 500).count() <= 1
    assert quality_rules.hashed_sample(rows.limit(0), "doc_id", "text", 500).count() == 0


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>";</script></head><body class="has-sidebar"><div id="topbar">Site</div>
<nav><ul><li><a href=x>Home</a></ul></nav>%s<aside>side</aside><div class="cookie-notice">We use cookies, do accept them all please.</div>
<form><p>Send us a mail<input></form><section id="comments"><p>Great post, I do agree with every word of it, thanks a lot.</p></section><footer>&copy; 2020</footer></body></html>"""
BODY = "<h2>Head &amp; line</h2><p>A paragraph  of\n<b>so</b>me&nbsp;length, with a <a href=y>link</a> in it.<p>Short.<ul><li>one<li>two</ul><blockquote>Said &lt;so&gt;.</blockquote>"
WANT = "Head & line\nA paragraph of some length, with a link in it.\nShort.\none\ntwo\nSaid <so>."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div id="content"><div>%s</div></div>', "<table><tr><td>%s</td></tr></table>"])
def test_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == WANT


LONG = "<p>A paragraph of the article that is long enough to count as its text, word after word.</p>" * 4


@pytest.mark.parametrize("tag", [
    "div class='content with-sidebar'", "article class='post category-social comments-open'", "div id='search-results'", "div class='no-comments'", "div class=hasSidebar", "div class='widget'", "main class=search",
    "div class='comments'"])
def test_names_do_not_drop_the_article(tag):
    page = f"<nav>Menu</nav><{tag}>{LONG}<div class='share-buttons'>Share this</div></{tag.split()[0]}><div class='site-footer'>Foot of the page</div><div id=sidebar>Side</div>"
    assert html_text.main_text(page) == html_text.main_text(LONG) != ""


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentsArea", "COMMENTS"])
def test_comments_longer_than_the_article_go(name):
    short = "<p>A short article of some words.</p>"
    for page in (f"<article>{short}</article><div id={name}>{LONG}</div>", f"<main>{short}<div class={name}>{LONG}</div></main>"):
        assert html_text.main_text(page) == "A short article of some words."


def test_lines_of_links_in_the_article_stay():
    page = f"<nav><a href=x>Home</a></nav><article><h2><a href=a>Linked heading</a></h2>{LONG}<ul><li><a href=b>First reference</a><li><a href=c>Second reference</a></ul></article>"
    assert html_text.main_text(page).split("\n") == ["Linked heading", *html_text.main_text(LONG).split("\n"), "First reference", "Second reference"]
    assert html_text.main_text("<p><a href=x>All of it is a link</a></p>") == "All of it is a link"


def test_region_holds_all_content():
    lead = "<p>The lead of the article, in which it says what it is about.</p>"
    for page in (f"<div><div>{lead}</div><div>{LONG}</div></div>", f"<main><article>{LONG}</article><article>{lead}</article></main>", f"<article>{LONG}</article><div>{lead}</div>"):
        got = html_text.main_text(page).split("\n")
        assert len(got) == 5 and any("The lead" in x for x in got)


@pytest.mark.parametrize("html, want", [
    ("<p>foo <svg/> bar <script>x</script> baz</p>", "foo bar baz"), ("<p>foo <span hidden>no</span>bar</p><p>x", "foo bar\nx"), ("<div>a <select><option>x<option>y</select> b</div>", "a b"),
    ("<p>Press <button>Go</button> or <label>this</label> now.</p><form><label>Name</label></form>", "Press Go or this now."), ("<p>one<noscript><p>no</p></noscript> two</p>", "one two"),
    ("<p>foo <audio><p>no</audio>bar <video>no</video></p><nav>m<p>n</nav><p>end", "foo bar\nend"), ("<ul><li hidden>x<li>y<li>z</ul>", "y\nz"), ("<p>a<math/>b</p><button>Share</button>", "ab"),
    ("<p>f(x) = <svg><path d=1/><text>no</text></svg>2</p>", "f(x) = 2"),
])
def test_unwanted_elements_within_a_block_do_not_cut_it(html, want):
    assert html_text.main_text(html) == want


def test_pages_without_article(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "just text &eacute;"), (4, "u", "<nav>menu</nav>"), (5, "u", "<p>" * 20_000), (6, "u", "<div>" * 5_000 + "deep text")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("just text é", 11), 4: ("", 0), 5: ("", 0), 6: ("deep text", 9)}


def test_ftrl_against_single_steps():
    """The published update, one coordinate at a time, over features named by tuples instead of places."""
    texts = ["you are kind", "you awful awful fool", "a kind word", "awful, you!", "fool me once", "", "kind kind words and a fool"] * 4
    labels = [0, 1, 0, 1, 1, 0, 0] * 4
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * toxicity.L1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    def features(text):
        w = [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in text.lower().split()]
        found = {("bias",)} | {("word", x) for x in w} | {("start", x[:toxicity.STEM]) for x in w}
        return found | {("pair", a, b) for a, b in zip(w, w[1:])} | {("skip", a, b) for a, b in zip(w, w[2:])}

    def probability(text):
        return 1 / (1 + np.exp(-sum(weight(f) for f in features(text))))

    for _ in range(40):
        for text, y in zip(texts, labels):
            g = probability(text) - y
            moved = {}
            for f in features(text):
                sigma = ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / toxicity.ALPHA
                moved[f] = (z.get(f, 0.0) + g - sigma * weight(f), n.get(f, 0.0) + g * g)
            for f, (a, b) in moved.items():
                z[f], n[f] = a, b
    hasher = toxicity.Hasher()
    got = toxicity.train([np.unique(hasher.places(t.encode())) for t in texts], labels, epochs=40)
    for text in [*texts[:7], "an unseen awful fool", "kind"]:
        total = hasher.total(text.encode(), got)
        assert abs(1 / (1 + np.exp(-total)) - probability(text)) < 1e-9
    assert np.count_nonzero(got) == sum(1 for f in z if weight(f) != 0) > 3


# ---- chats

LOG = "conv_id long, turn long, role string, text string"


def chats():
    base = [("user", "a"), ("assistant", "b"), ("user", "c"), (None, None), ("user", "")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 5), (3, 5), (4, 1), (None, 3)) for t in range(n)]
    rows += [(6, 0, "user", "a"), (6, 1, "assistant", "other"), (7, 0, "user", "z"), (7, 0, "user", "z"), (8, None, "user", "q"), (8, 5, "user", "r"), (8, 5, "user", "s")]
    return rows


def test_snapshots_collapse(spark, monkeypatch):
    log = spark.createDataFrame(chats(), LOG).withColumn("part", F.lit("clash"))
    want = {2: (5, 2), 6: (2, 1), 7: (1, 1), 8: (3, 1)}
    whole = {}
    for size in (256, 2):
        monkeypatch.setattr(chat, "BLOCK", size)
        got = chat.format_chats(log).orderBy("part").collect()
        assert {r["conv_id"]: (r["n_turns"], r["copies"]) for r in got} == want
        texts = {c: "".join(r["text"] for r in got if r["conv_id"] == c) for c in want}
        whole[size] = texts
    assert whole[256] == whole[2]
    assert whole[2][2].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb") and "<|im_start|>unknown\n<|im_end|>" in whole[2][2]
    assert chat.format_chats(log.limit(0)).count() == 0


def test_a_null_conversation_can_stay(spark):
    log = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "user", "a")], LOG)
    assert [(r["conv_id"], r["n_turns"]) for r in chat.format_chats(log).collect()] == [(None, 2)]


def check_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    # A third of the log has no id; its turns have one number, or none. One row is repeated very often.
    rows = [(None, None if i % 2 else 0, "user", f"said {i}") for i in range(300)] + [(None, 0, "user", "again")] * 200
    rows += [(c, t, "user" if t % 2 == 0 else None, f"turn {t}") for c in range(1, 60) for t in range(1 + c % 20)]
    log = spark.createDataFrame(rows, LOG)
    got = chat.format_chats(log).collect()
    ends = {}
    for c in range(1, 60):
        ends.setdefault(c % 20, []).append(c)
    assert {(r["conv_id"], r["n_turns"], r["copies"]) for r in got} == {(None, 301, 1), (min(ends[19]), 20, len(ends[19]))}
    assert max(r["part_turns"] for r in got) == 16 and len(got) == 19 + 2
    parts = sorted((r for r in got if r["conv_id"] is None), key=lambda r: r["part"])
    assert [r["part"] for r in parts] == list(range(19))
    said = "".join(r["text"] for r in parts).split("<|im_end|>\n")[:-1]
    numbered = {f"<|im_start|>user\nsaid {i}" for i in range(0, 300, 2)} | {"<|im_start|>user\nagain"}
    # Turns without a number come first, each turn once.
    assert set(said[150:]) == numbered and len(said) == 301 == len(set(said))
    other = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"] is not None), key=lambda r: r["part"]))
    assert other == "".join(f"<|im_start|>{'user' if t % 2 == 0 else 'unknown'}\nturn {t}<|im_end|>\n" for t in range(20))


def test_chats_without_ids(spark, monkeypatch):
    check_rows_without_ids(spark, monkeypatch)


def test_chats_without_ids_in_pieces(spark, monkeypatch, hot):
    check_rows_without_ids(spark, monkeypatch)


# ---- captures

def test_revisits(spark, hot):
    check_revisits(spark)


def test_revisits_in_one_window(spark):
    check_revisits(spark)


def check_revisits(spark):
    rows = [
        (1, "http://www.A.com:80/x/?b=2&a=1&utm_source=k#f", 10, "response", {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}, "p1"),
        (2, "https://a.com/x?a=1&b=2", 20, "response", {"etag": '"2"'}, "p2"),
        (3, "https://a.com/x/?a=1&b=2", 20, "revisit", {"ETag": 'W/"2"', "Date": "d3", "Content-Type": "z", "Connection": "close"}, None),
        (4, "https://a.com/x?a=1&b=2", 15, "revisit", {"etag": '"1"', "date": "d4"}, None),
        (5, "https://a.com/x?a=1&b=2", 30, "revisit", {"etag": '"1"'}, None),
        (6, "https://a.com/x?a=1&b=2", 5, "revisit", {"etag": '"1"'}, None),
        (7, None, 50, "revisit", {}, "p2"), (8, "https://a.com/x?a=1&b=2", None, "revisit", None, "p2"), (9, "https://a.com/x?a=1&b=2", 60, "revisit", None, "p2"),
        (10, None, 40, "response", {}, "p2"), (11, "https://a.com/x?a=1&b=2", 61, None, None, "p2"),
    ] + [(100 + i, "http://b.org/", i, "response", {}, "p") for i in range(60)] + [(200, "http://b.org", 99, "revisit", {}, "p")]
    records = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, digest string").withColumn("outcome", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve(records).collect()}
    assert {i: (r["outcome"], r["response_id"]) for i, r in got.items()} == {
        3: ("resolved", 2), 4: ("resolved", 1), 5: ("mismatch", None), 6: ("no_response", None), 7: ("no_response", None), 8: ("no_response", None), 9: ("resolved", 2), 200: ("resolved", 159)}
    assert got[4]["headers"] == 'content-type: t\ndate: d4\netag: "1"' and got[3]["headers"] == 'date: d3\netag: "2"'
    assert got[4]["canonical_url"] == "a.com/x?a=1&b=2" and got[4]["digest"] == "p1"
    assert warc.resolve(records.limit(0)).count() == 0


