"""Landed API payloads (one document per row, column ``payload``) to long observations.

Parsing is from_json/from_xml plus explode, so documents spread over the cluster
and no payload passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOOD_FEATURES = ("FAO_FoodPriceIndex", "FAO_MeatPriceIndex", "FAO_DairyPriceIndex", "FAO_CerealsPriceIndex", "FAO_OilsPriceIndex", "FAO_SugarPriceIndex")
FOOD_HEADERS = ("FAO", "2014-2016", "Date,")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (payload)."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "payload")


def read_sdmx_xml(spark: SparkSession, path: str) -> DataFrame:
    """Observation elements of generic SDMX files as struct rows."""
    return spark.read.format("xml").option("rowTag", "Obs").option("ignoreNamespace", True).schema(OBS_SCHEMA).load(path)


def _long(timestamp: Column, ticker: Column, feature: Column, value: Column) -> list[Column]:
    return [timestamp.cast("bigint").alias("timestamp"), ticker.cast("string").alias("ticker"), feature.alias("feature"), value.cast("double").alias("value")]


def _millis(date: Column) -> Column:
    return F.unix_millis(date.cast("timestamp"))


# --- price charts ---------------------------------------------------------
_CHART = """chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>,
  indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>,
                     adjclose: array<struct<adjclose: array<double>>>>,
  events: struct<dividends: map<string, struct<date: bigint, amount: double>>,
                 splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>>"""
_QUOTES = {"Close": "close", "Open": "open", "High": "high", "Low": "low", "Volume": "volume"}


def chart_json(documents: DataFrame) -> DataFrame:
    """Parallel price arrays zipped by position, missing points left out; dividends as amounts, splits as ratios."""
    results = documents.select(F.explode(F.from_json("payload", _CHART)["chart"]["result"]).alias("r"))
    results = results.withColumn("symbol", F.col("r.meta.symbol"))
    empty = F.array().cast("array<double>")
    quote = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))
    adjusted = F.try_element_at(F.col("r.indicators.adjclose"), F.lit(1))["adjclose"]
    arrays = {n: F.coalesce(quote[f], empty) for n, f in _QUOTES.items()} | {"AdjClose": F.coalesce(adjusted, empty)}
    points = results.select("symbol", F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), *[a.alias(n) for n, a in arrays.items()])).alias("p"))
    prices = points.filter("p.ts is not null").select("symbol", "p.ts", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"p.{n}").alias("value")) for n in arrays
    ]))).select(*_long(F.col("ts") * 1000, F.col("symbol"), F.col("feature"), F.col("value")))
    dividends = results.select("symbol", F.explode(F.map_values("r.events.dividends")).alias("e")).select(
        *_long(F.col("e.date") * 1000, F.col("symbol"), F.lit("Dividend"), F.col("e.amount")))
    splits = results.select("symbol", F.explode(F.map_values("r.events.splits")).alias("e")).select(
        *_long(F.col("e.date") * 1000, F.col("symbol"), F.lit("Split"), F.try_divide("e.numerator", "e.denominator")))
    return prices.unionByName(dividends).unionByName(splits).filter("value is not null")


# --- fundamentals ---------------------------------------------------------
def fundamentals_json(documents: DataFrame) -> DataFrame:
    """The first ``meta.type`` names the member that holds the (asOfDate, reportedValue) rows."""
    parsed = F.from_json("payload", "timeseries struct<result: array<map<string, string>>>")
    results = documents.select(F.explode(parsed["timeseries"]["result"]).alias("r"))
    meta = F.from_json(F.col("r")["meta"], "type array<string>, symbol array<string>")
    named = results.select("r", F.try_element_at(meta["type"], F.lit(1)).alias("type"), F.try_element_at(meta["symbol"], F.lit(1)).alias("symbol"))
    rows = F.from_json(F.try_element_at("r", F.col("type")), "array<struct<asOfDate: string, reportedValue: struct<raw: double>>>")
    points = named.filter("type is not null").select("type", "symbol", F.explode(rows).alias("p"))
    return points.select(*_long(_millis(F.to_date("p.asOfDate")), F.col("symbol"), F.col("type"), F.col("p.reportedValue.raw"))).filter(
        "value is not null and timestamp is not null")


# --- SDMX JSON ------------------------------------------------------------
_DIMENSIONS = "array<struct<id: string, values: array<struct<id: string, name: string, start: string>>>>"
_STRUCTURE = f"struct<dimensions: struct<observation: {_DIMENSIONS}, series: {_DIMENSIONS}>>"
_SETS = "array<struct<observations: map<string, array<double>>, series: map<string, struct<observations: map<string, array<double>>>>>>"
_MESSAGE = f"dataSets {_SETS}, structure {_STRUCTURE}, structures array<{_STRUCTURE}>"
_SDMX = f"{_MESSAGE}, data struct<dataSets: {_SETS}, structure: {_STRUCTURE}, structures: array<{_STRUCTURE}>>"


def _message(documents: DataFrame) -> DataFrame:
    """Data set and dimensions, whether wrapped in ``data`` or not, single or listed."""
    m = F.from_json("payload", _SDMX)
    first = lambda a: F.try_element_at(a, F.lit(1))
    structure = F.coalesce(m["structure"], first(m["structures"]), m["data"]["structure"], first(m["data"]["structures"]))
    return documents.select(F.coalesce(first(m["dataSets"]), first(m["data"]["dataSets"])).alias("s"), structure["dimensions"].alias("d"))


def period_start(start: Column, name: Column) -> Column:
    """Epoch ms of a period: its start time, else YYYY, YYYY-MM, YYYY-Qn or YYYY-MM-DD taken at its first day."""
    year = F.substring(name, 1, 4)
    month = F.when(name.rlike(r"^\d{4}-Q[1-4]$"), (F.substring(name, 7, 1).cast("int") - 1) * 3 + 1).when(
        name.rlike(r"^\d{4}-\d{2}"), F.substring(name, 6, 2).cast("int")).otherwise(1)
    day = F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(name, 9, 2).cast("int")).otherwise(1)
    from_name = F.when(name.rlike(r"^\d{4}"), F.make_date(year.cast("int"), month, day))
    return F.coalesce(_millis(F.try_to_timestamp(start)), _millis(from_name))


def _label(dimensions: str, places: Sequence[int], indices: Column, separator: str) -> Column:
    names = [F.try_element_at(F.col(dimensions)[p]["values"], F.try_element_at(indices, F.lit(p + 1)).cast("int") + 1)["name"] for p in places]
    return F.when(names[-1].isNotNull(), F.concat_ws(separator, *names))


def sdmx_json(documents: DataFrame, feature_dims: Sequence[int], time_dim: int, prefix: str = "", separator: str = "_", skip_zero: bool = False) -> DataFrame:
    """Flat observations ``a:b:c -> [value]``; each key part indexes the values of its dimension."""
    rows = _message(documents).select("d", F.explode("s.observations").alias("key", "values"))
    indices = F.split("key", ":")
    rows = rows.select(F.col("d.observation").alias("dims"), indices.alias("i"), F.try_element_at("values", F.lit(1)).alias("value"))
    time = F.try_element_at(F.col("dims")[time_dim]["values"], F.try_element_at("i", F.lit(time_dim + 1)).cast("int") + 1)
    out = rows.select(*_long(period_start(time["start"], time["id"]), F.lit(None), F.concat(F.lit(prefix), _label("dims", feature_dims, F.col("i"), separator)), F.col("value")))
    out = out.filter("value is not null and timestamp is not null and feature is not null")
    return out.filter("value != 0") if skip_zero else out


def sdmx_series_json(documents: DataFrame, feature_dims: Sequence[int], prefix: str = "", separator: str = "_") -> DataFrame:
    """Series key -> time index -> [value]."""
    series = _message(documents).select("d", F.explode("s.series").alias("key", "one"))
    rows = series.select("d", F.split("key", ":").alias("i"), F.explode("one.observations").alias("t", "values"))
    rows = rows.select(F.col("d.series").alias("dims"), F.col("d.observation").alias("times"), "i", F.col("t").cast("int").alias("t"),
                       F.try_element_at("values", F.lit(1)).alias("value"))
    time = F.try_element_at(F.col("times")[0]["values"], F.col("t") + 1)
    out = rows.select(*_long(period_start(time["start"], time["id"]), F.lit(None), F.concat(F.lit(prefix), _label("dims", feature_dims, F.col("i"), separator)), F.col("value")))
    return out.filter("value is not null and timestamp is not null and feature is not null")


# --- SDMX XML -------------------------------------------------------------
OBS_SCHEMA = """ObsKey struct<Value: array<struct<_id: string, _value: string>>>, ObsValue struct<_value: string>,
  Attributes struct<Value: array<struct<_id: string, _value: string>>>"""


def xml_observations(documents: DataFrame) -> DataFrame:
    """Rows of the observation schema from one ``generic:Obs`` element per payload."""
    parsed = F.from_xml(F.col("payload"), OBS_SCHEMA, {"ignoreNamespace": "true", "rowTag": "Obs"})
    return documents.select(parsed.alias("o")).select("o.*")


def _named_values(column: str) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(F.col(column), F.array()), lambda v: F.struct(v["_id"], v["_value"])))


def sdmx_xml(observations: DataFrame, dims: Sequence[str], prefix: str, suffix: str = "", names: Mapping[str, str] | None = None, scaled: bool = False) -> DataFrame:
    """Generic observations; the feature joins the (renamed) codes of ``dims``. ``scaled`` applies the power-of-ten multiplier."""
    rows = observations.select(_named_values("ObsKey.Value").alias("k"), _named_values("Attributes.Value").alias("a"), F.col("ObsValue._value").try_cast("double").alias("v"))
    renamed = F.create_map(*[F.lit(x) for pair in (names or {"": ""}).items() for x in pair])
    codes = [F.col("k")[d] for d in dims]
    parts = [F.coalesce(renamed[c], c) for c in codes]
    power = F.coalesce(F.col("a")["UNIT_MULT"].try_cast("int"), F.lit(0))
    value = F.col("v") * F.pow(F.lit(10.0), power) if scaled else F.col("v")
    feature = F.when(codes[-1].isNotNull(), F.concat(F.lit(prefix), F.concat_ws("_", *parts), F.lit(suffix)))
    period = F.col("k")["TIME_PERIOD"]
    return rows.select(*_long(period_start(F.lit(None).cast("string"), period), F.lit(None), feature, value)).filter(
        "value is not null and timestamp is not null and feature is not null")


# --- monthly CSV ----------------------------------------------------------
def monthly_csv(lines: DataFrame, features: Sequence[str] = FOOD_FEATURES, headers: Sequence[str] = FOOD_HEADERS) -> DataFrame:
    """``YYYY-MM,v1,..,v6`` lines; headers, short lines, other dates and blank or unreadable fields are left out."""
    line = F.trim("payload")
    kept = lines.select(line.alias("line")).filter(F.col("line") != "")
    for h in headers:
        kept = kept.filter(~F.col("line").startswith(h))
    parts = kept.select(F.split("line", ",", -1).alias("p")).filter((F.size("p") >= len(features) + 1) & F.trim(F.col("p")[0]).rlike(r"^\d{4}-\d{2}$"))
    month = F.to_date(F.concat(F.trim(F.col("p")[0]), F.lit("-01")))
    rows = parts.select(month.alias("m"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.trim(F.col("p")[i + 1]).try_cast("double").alias("value")) for i, f in enumerate(features)
    ])))
    return rows.select(*_long(_millis(F.col("m")), F.lit(None), F.col("feature"), F.col("value"))).filter("value is not null and timestamp is not null")


# --- page views -----------------------------------------------------------
def pageviews_json(documents: DataFrame, mapping: DataFrame) -> DataFrame:
    """Daily views per page: total, desktop, and mobile as web plus app. ``mapping``: (page, ticker); pages without ticker get a name prefix."""
    from panelforge.operators.ordered import lookup

    items = documents.select(F.explode(F.from_json("payload", "items array<struct<article: string, timestamp: string, access: string, views: bigint>>")["items"]).alias("i")).select("i.*")
    day = F.to_date(F.substring("timestamp", 1, 8), "yyyyMMdd")
    views = lambda *kinds: F.sum(F.when(F.col("access").isin(*kinds), F.col("views")))
    daily = items.groupBy(F.col("article").alias("page"), day.alias("day")).agg(
        views("all-access").alias("Wiki_Views"), views("desktop").alias("Wiki_Views_Desktop"), views("mobile-web", "mobile-app").alias("Wiki_Views_Mobile"))
    named = lookup(daily, mapping.select("page", F.nullif("ticker", F.lit("")).alias("ticker")), ["page"], "inner")
    tall = named.select("page", "day", "ticker", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in ("Wiki_Views", "Wiki_Views_Desktop", "Wiki_Views_Mobile")
    ])))
    feature = F.when(F.col("ticker").isNull(), F.concat_ws("_", "page", "feature")).otherwise(F.col("feature"))
    return tall.select(*_long(_millis(F.col("day")), F.col("ticker"), feature, F.col("value"))).filter("value is not null")
