"""Provider payloads as rows: nested JSON and CSV texts are parsed by built-in expressions, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.normalize import ZONE, cik, exchange_label, security_type

FACTS = "facts map<string, map<string, struct<units: map<string, array<struct<`end`: string, val: double, form: string, filed: string, accn: string, fy: int, fp: string>>>>>>"
QUOTE = "struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>"
CHART = f"chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<{QUOTE}>, adjclose: array<struct<adjclose: array<double>>>>>>>"
EVENTS = "chart struct<result: array<struct<events: struct<dividends: map<string, struct<amount: double, date: bigint>>, splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>>"


def _local_day(seconds: str | Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), ZONE).cast("date")


def company_facts(payloads: DataFrame, company: str, payload: str) -> DataFrame:
    """Facts of four levels of nesting (taxonomy, metric, unit, entry) as rows. Entries without value or filing day are left out, as are
    payloads that do not parse."""
    parsed = payloads.select(cik(company).alias("source_company_id"), F.from_json(payload, FACTS).alias("p"))
    metrics = parsed.select("source_company_id", F.explode("p.facts").alias("taxonomy", "metrics")).select("source_company_id", "taxonomy", F.explode("metrics").alias("metric_name_raw", "m"))
    units = metrics.select("source_company_id", "taxonomy", "metric_name_raw", F.explode("m.units").alias("metric_unit", "entries"))
    rows = units.select("source_company_id", "taxonomy", "metric_name_raw", "metric_unit", F.explode("entries").alias("e"))
    out = rows.select("source_company_id", "taxonomy", "metric_name_raw", "metric_unit", F.col("e.val").alias("metric_value"), F.col("e.form").alias("form_type"),
                      F.col("e.filed").try_cast("date").alias("filing_date"), F.col("e.end").try_cast("date").alias("fiscal_period_end"))
    return out.where("metric_value IS NOT NULL AND filing_date IS NOT NULL")


def mapped_facts(facts: DataFrame, companies: DataFrame, start: str, end: str) -> DataFrame:
    """``company_facts`` filed in [start, end] with the security_id of their company: ``companies`` has source_company_id, in any form, and security_id. Facts of other
    companies are left out."""
    ids = companies.select(cik("source_company_id").alias("source_company_id"), "security_id").distinct()
    return facts.where(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(ids, "source_company_id")


def chart_prices(payloads: DataFrame, symbol: str, payload: str) -> DataFrame:
    """Parallel arrays of a price chart as rows by New York day. Rows without all four prices are left out, missing volumes are zero,
    and close stands in for adj_close where the payload has none at all."""
    parsed = payloads.select(F.upper(symbol).alias("symbol"), F.from_json(payload, CHART).alias("p")).select("symbol", F.explode("p.chart.result").alias("r"))
    quote = F.get("r.indicators.quote", F.lit(0))
    adjusted = F.get("r.indicators.adjclose", F.lit(0))["adjclose"]
    some = F.exists(F.coalesce(adjusted, F.array().cast("array<double>")), lambda x: x.isNotNull())
    at = F.posexplode("r.timestamp").alias("i", "t")
    rows = parsed.withColumns({"q": quote, "a": F.when(some, adjusted)}).select("symbol", "q", "a", at)
    value = lambda name: F.get(F.col("q")[name], F.col("i")).alias(name)
    out = rows.select("symbol", _local_day("t").alias("trade_date"), *map(value, ("open", "high", "low", "close")), F.coalesce(F.get(F.col("q")["volume"], F.col("i")), F.lit(0)).alias("volume"),
                      F.when(F.col("a").isNull(), F.get(F.col("q")["close"], F.col("i"))).otherwise(F.get("a", F.col("i"))).alias("adj_close"))
    return out.dropna(subset=["open", "high", "low", "close"])


def chart_actions(payloads: DataFrame, symbol: str, payload: str) -> DataFrame:
    """Dividends and splits of a chart payload; a split's ratio is numerator over denominator."""
    parsed = payloads.select(F.upper(symbol).alias("symbol"), F.from_json(payload, EVENTS).alias("p")).select("symbol", F.explode("p.chart.result").alias("r"))
    dividends = parsed.select("symbol", F.explode(F.map_values("r.events.dividends")).alias("e")).select("symbol", F.lit("dividend").alias("event_type"), _local_day("e.date").alias("event_date"), F.lit(None).cast("double").alias("split_ratio"), F.col("e.amount").alias("dividend_amount"))
    splits = parsed.select("symbol", F.explode(F.map_values("r.events.splits")).alias("e")).select("symbol", F.lit("split").alias("event_type"), _local_day("e.date").alias("event_date"), F.try_divide("e.numerator", "e.denominator").alias("split_ratio"), F.lit(None).cast("double").alias("dividend_amount"))
    return dividends.unionByName(splits)


def listing_master(payloads: DataFrame, payload: str) -> DataFrame:
    """A columnar listing, {"fields": [...], "data": [[...], ...]}, as security rows."""
    parsed = payloads.select(F.from_json(payload, "fields array<string>, data array<array<string>>").alias("p"))
    rows = parsed.select("p.fields", F.explode("p.data").alias("row"))
    value = lambda name: F.try_element_at(F.map_from_arrays("fields", "row"), F.lit(name))
    ready = rows.where("size(fields) = size(row)").select(value("cik").alias("cik"), value("name").alias("name"), value("ticker").alias("symbol"), value("exchange").alias("exchange"))
    return ready.where("symbol IS NOT NULL").select(cik("cik").alias("source_company_id"), F.upper("symbol").alias("symbol"), "name", exchange_label("exchange").alias("exchange"), security_type("name").alias("security_type"))


def csv_prices(payloads: DataFrame, symbol: str, payload: str, start: str, end: str) -> DataFrame:
    """CSV texts with a header (Date, Open, High, Low, Close, Volume) as rows of days in [start, end]; adj_close is close."""
    lines = payloads.select(F.upper(symbol).alias("symbol"), F.posexplode(F.split(F.trim(payload), r"\r?\n")).alias("i", "line")).where("i > 0")
    cells = lines.select("symbol", F.from_csv("line", "trade_date date, open double, high double, low double, close double, volume double").alias("c")).select("symbol", "c.*")
    rows = cells.where(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.withColumns({"volume": F.col("volume").cast("bigint"), "adj_close": F.col("close")})
