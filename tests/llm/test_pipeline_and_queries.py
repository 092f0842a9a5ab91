"""The corpus pipeline stage by stage, and the registered text queries against their SQL twins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from panelforge.llm import catalog, decontaminate, html_text, pii

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"pipeline"}))
def test_query(spark, name):
    got = catalog.queries()[name](spark, TINY).toPandas()
    assert len(got) > 0
    if name in SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
        assert compare(got, con.execute(SQL[name]).fetchdf()) == ""


def test_extracted_pages_are_the_articles(spark):
    """The pages table puts each text into an article of a heading and paragraphs; only whole articles may come out."""
    rows = spark.read.parquet(f"{TINY}/pages.parquet").collect()
    for r in rows:
        article = r["html"].split("<article>")[1].split("</article>")[0]
        assert html_text.main_text(r["html"]) == html_text.main_text(f"<article>{article}</article>") != ""


def odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(1).collect()[0]["text"]
    line = "The call of the thing was to be on the other side of a long and plain page in that house near the old mill by the river."
    rows = [(None, line + " One.", "en", None, None), (9001, line + " One.", None, "x", 5), (9001, line + " One.", None, "x", 5), (9002, None, None, None, None), (9003, bench, "en", "x", 1),
            (9004, line + " Write to john.smith@mail.example.com or +1 (648) 555-1250 then.", "en", "x", 9), (9005, "", "en", "x", 0)]
    return docs.union(spark.createDataFrame(rows, docs.schema)).withColumn("score", F.lit("clash")).withColumn("shard", F.lit("clash"))


def test_stages(spark):
    docs = odd_rows(spark)
    names = docs.columns
    ids = lambda df: [r["doc_id"] for r in df.select("doc_id").collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, SMALL)
    assert kept.columns == names
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judged = labels.join(kept.select("doc_id", F.lit(1).alias("stays")), "doc_id", "left")
    assert judged.where("quality = 1 and stays is null").count() <= 6 and judged.where("quality = 0 and stays = 1").count() <= 6

    once = stages["near_dedup"](spark, docs, SMALL)
    assert once.columns == names
    got = ids(once)
    assert len(got) == len(set(got)) and sum(i in got for i in (None, 9001)) == 1 and sum(i in got for i in (9002, 9005)) == 1
    assert once.select("text").distinct().count() == len(got)

    clean = stages["decontamination"](spark, docs, SMALL)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 13]) for w in (decontaminate.words(t) for _, t in items) for i in range(max(1, len(w) - 12))}
    want = []
    for r in docs.collect():
        w = decontaminate.words(r["text"] or "")
        hit = {i + j for k in {len(x) for x in windows} for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in windows for j in range(k)}
        if not hit or 20 * len(hit) < len(w):
            want.append(r["doc_id"])
    assert clean.columns == names and sorted(ids(clean), key=str) == sorted(want, key=str) and 9003 not in want

    safe = stages["pii"](spark, docs, SMALL)
    assert safe.columns == names and safe.count() == docs.count()
    after = {r["doc_id"]: r for r in safe.collect()}
    assert "john.smith@" not in after[9004]["text"] and "555-1250" not in after[9004]["text"] and after[9002]["text"] is None
    for r in docs.collect():
        if not pii.base_spans(r["text"] or ""):
            assert after[r["doc_id"]]["text"] == r["text"]
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"]) for r in after.values())

    mixed = stages["mixing"](spark, docs, SMALL)
    assert set(mixed.columns) == {*names, "doc_shard", "pass", "words", "place"} and {r[0] for r in mixed.select("doc_shard").distinct().collect()} == {"clash"}
    assert mixed.where("size(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', 0)) <> words").count() == 0
    # Whole rows only, as they came in.
    assert 0 < mixed.count() and {tuple(r) for r in mixed.select(*COLUMNS).collect()} <= {tuple(r) for r in docs.select(*COLUMNS).collect()}

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(1).collect()[0]["text"]
    rows = [(i, t, "en", "x", 1) for i in (None, 7) for t in (bench, "a clean text", "another clean text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.decontamination(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("text is null or text like '%clean text'").collect()))


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, TINY)
    first = spark.read.parquet(f"{TINY}/documents.parquet")
    assert set(COLUMNS) <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() < first.count()
    assert out.select("doc_id").distinct().join(first, "doc_id").count() == out.select("doc_id").distinct().count()


def test_pii_counts_by_kind(spark, tmp_path):
    """Each kind's base spans are counted, whatever kinds stand beside them; null and empty texts have none."""
    rows = [(1, "a@b.cd and c.d@e.fg, 10.0.0.1", (2, 1, 0, 0)), (2, "4111 1111 1111 1111 or +49 (30) 1234567", (0, 0, 1, 1)), (2, "+49 30 1234567 +49 30 7654321", (0, 0, 0, 2)), (None, "300.1.1.1", (0, 0, 0, 0)),
            (4, None, (0, 0, 0, 0)), (5, "", (0, 0, 0, 0)), (6, "email:ip card phone", (0, 0, 0, 0))]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["op6_pii"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == sorted((i or 0, *n) for i, _, n in rows)
