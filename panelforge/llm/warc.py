"""Web captures: resolve "not modified" revisits to the response that they confirm.

A crawl that asks with a validator may get status 304 without a body. Each such revisit is joined, as of its time, to the latest earlier full response
of the same canonical URL: responses and revisits are put in one order by (URL, time, record id), and every record takes the last
response before it. That step is ``fill_last``, which cuts a URL with very many captures into blocks. The revisit is resolved if
every validator that both state agrees, and they have one in common: entity tag (weak comparison), time of last change, or payload
digest. Its headers are those of the response, updated by those of the revisit that a 304 may update: not the ones that
describe the body, and none of a single connection.

Bodies are never moved: a resolved revisit carries the id and digest of the response. A null URL matches nothing; a null time comes before all others; equal
times are ordered by record id; a null kind is neither. Header names compare without regard to case and come out in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordered import fill_last

#: Fixed names: fields of a 304 that do not replace those of the stored response.
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that do not select content start so.
_TRACKING = "utm_"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a closing slash, sorted query without tracking parameters; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(pairs, lambda p: (p != "") & ~p.startswith(_TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only the first value stays."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    add = lambda seen, e: F.when(F.map_contains_key(seen, F.lower(e["key"])), seen).otherwise(F.map_concat(seen, F.map_from_entries(F.array(F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))
    return F.aggregate(entries, empty, add)


def resolve(
    records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "time", kind_col: str = "kind", headers_col: str = "headers", digest_col: str = "digest",
) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome, response_id, digest and headers (sorted "name: value" lines).

    ``records`` has a kind, "response" or "revisit"; headers is a map, digest that of the payload. The outcome is "resolved", "mismatch" (a validator
    differs or none is shared), or "no_response".
    """
    url = canonical_url(F.col(url_col))
    plain = records.select(
        F.col(id_col).alias("_id"), url.alias("_url"), F.coalesce(url, F.concat(F.lit("\x00"), F.col(id_col).cast("string"))).alias("_key"),
        F.col(time_col).alias("_time"), F.col(kind_col).alias("_kind"), _lowered(F.col(headers_col)).alias("_headers"), F.col(digest_col).cast("string").alias("_digest"),
    ).where(F.col("_kind").isin("response", "revisit"))
    full = F.when(F.col("_kind") == "response", F.struct(F.col("_id").alias("id"), F.col("_headers").alias("headers"), F.col("_digest").alias("digest")))
    joined = fill_last(plain.withColumn("_from", full), ["_from"], ["_key"], ["_time", "_id"])
    mine, theirs = F.col("_headers"), F.col("_from.headers")

    def agree(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^[Ww]/", "")
    checks = F.filter(F.array(agree(tag(mine), tag(theirs)), agree(mine["last-modified"], theirs["last-modified"]), agree(F.col("_digest"), F.col("_from.digest"))), lambda x: x.isNotNull())
    good = (F.size(checks) > 0) & ~F.exists(checks, lambda x: ~x)
    outcome = F.when(F.col("_from").isNull(), "no_response").when(good, "resolved").otherwise("mismatch")
    update = F.map_filter(mine, lambda k, v: ~k.isin(*NOT_UPDATED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(update, k)), update)
    shown = F.when(outcome == "resolved", merged).otherwise(mine)
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    return joined.where(F.col("_kind") == "revisit").select(
        F.col("_id").alias("record_id"), F.col("_url").alias("canonical_url"), outcome.alias("outcome"),
        F.when(outcome == "resolved", F.col("_from.id")).alias("response_id"), F.when(outcome == "resolved", F.col("_from.digest")).alias("digest"), lines.alias("headers"),
    )


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A log of captures from a table of pages: each page's response, and a later request for its URL that got a 304.

    Page i was fetched at second 10 i and asked for again at second 10 i + 250,003; every fifth second request states another entity tag, every
    seventh is dated before the first page, and every third states no tag but the day of the last change.
    """
    i = F.col(id_col)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col(html_col)), 1, 16), F.lit('"'))
    changed = F.concat(F.lit("day "), F.floor(i / 100).cast("string"))
    answer = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), changed, F.lit("Date"), (10 * i).cast("string"))
    later = F.when(i % 7 == 0, -1 - i).otherwise(10 * i + 250_003)
    again = F.map_filter(F.create_map(
        F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), later.cast("string"),
        F.lit("etag"), F.when(i % 3 == 0, F.lit(None)).when(i % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("last-modified"), F.when(i % 3 == 0, changed)), lambda k, v: v.isNotNull())
    both = F.array(
        F.struct((2 * i).alias("record_id"), (10 * i).alias("time"), F.lit("response").alias("kind"), answer.alias("headers"), F.md5(F.col(html_col)).alias("digest")),
        F.struct((2 * i + 1).alias("record_id"), later.alias("time"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("digest")))
    return pages.select(F.col(url_col).alias("url"), F.explode(both).alias("r")).select("r.record_id", "url", "r.time", "r.kind", "r.headers", "r.digest")
