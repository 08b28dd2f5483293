import json
from datetime import date, datetime

import pytest
from pyspark.sql.types import StructType

from quoin.operators.calendar import calendar_frame, require_label_start
from quoin.operators.features import feature_columns, silver_rows
from quoin.sources.figures import bars, heat_map, lines
from quoin.sources.local import benchmark_source, coerce, local_actions, local_facts, local_market, read_table, select_rows, synthetic_benchmark, synthetic_facts, synthetic_market, validate
from quoin.sources.paged import Page, PagedSource, ProviderError, package, pages, pick_adapter, request_key, sliced, with_retries
from quoin.sources.payloads import chart_actions, chart_prices, company_facts, csv_prices, listing_master, mapped_facts
from quoin.sources.sinks import cached, content_hash, dataset_id, html_report, ingest_once, keep_raw, markdown, read_json, schema_hash, write_json, write_schemas, write_split
from quoin.streaming.ingest import windowed_counts


def payload(spark, value):
    return spark.createDataFrame([("abc", value if isinstance(value, str) else json.dumps(value))], "symbol string, body string")


def test_nested_facts_become_rows(spark):
    body = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2023-12-31", "val": 5.0, "form": "10-K", "filed": "2024-02-01"}, {"end": "2023-12-31", "val": None, "filed": "2024-02-01"}, {"end": "2023-12-31", "val": 6.0}]}}}}}
    rows = company_facts(spark.createDataFrame([("CIK 12-34", json.dumps(body)), ("x", "not json"), ("y", None)], "c string, b string"), "c", "b").collect()
    assert [(r["source_company_id"], r["metric_name_raw"], r["metric_unit"], r["metric_value"], r["filing_date"]) for r in rows] == [("0000001234", "Revenues", "USD", 5.0, date(2024, 2, 1))]


def test_chart_arrays_become_rows(spark):
    quote = {"open": [1.0, 2.0, None], "high": [1.5, 2.5, 3.0], "low": [0.5, 1.5, 2.0], "close": [1.2, 2.2, 2.5], "volume": [10, None, 5]}
    body = {"chart": {"result": [{"timestamp": [1704205800, 1704292200, 1704378600], "indicators": {"quote": [quote], "adjclose": [{"adjclose": [None, None, None]}]}, "events": {"dividends": {"a": {"amount": 0.5, "date": 1704205800}}, "splits": {"b": {"date": 1704292200, "numerator": 2.0, "denominator": 1.0}, "c": {"date": 1704292200, "numerator": 2.0, "denominator": 0.0}}}}]}}
    rows = sorted(chart_prices(payload(spark, body), "symbol", "body").collect(), key=lambda r: r["trade_date"])
    assert [(r["symbol"], r["trade_date"], r["close"], r["adj_close"], r["volume"]) for r in rows] == [("ABC", date(2024, 1, 2), 1.2, 1.2, 10), ("ABC", date(2024, 1, 3), 2.2, 2.2, 0)]
    actions = {(r["event_type"], r["split_ratio"], r["dividend_amount"]) for r in chart_actions(payload(spark, body), "symbol", "body").collect()}
    assert actions == {("dividend", None, 0.5), ("split", 2.0, None), ("split", None, None)}


def test_listing_and_csv_payloads(spark):
    body = {"fields": ["cik", "name", "ticker", "exchange"], "data": [["12", "Big ETF Trust", "bet", "NYSE ARCA"], ["13", "Acme Corp", None, "Nasdaq"]]}
    (row,) = listing_master(payload(spark, body), "body").collect()
    assert (row["source_company_id"], row["symbol"], row["exchange"], row["security_type"]) == ("0000000012", "BET", "NYSE", "etf")
    text = "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n2024-02-02,1,2,0.5,1.5,100\n"
    (row,) = csv_prices(payload(spark, text), "symbol", "body", "2024-01-01", "2024-01-31").collect()
    assert (row["trade_date"], row["close"], row["adj_close"], row["volume"]) == (date(2024, 1, 2), 1.5, 1.5, 100)


def test_local_tables_and_schemas(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"records": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]}))
    assert read_table(spark, str(tmp_path / "t.json")).count() == 2
    (tmp_path / "t.csv").write_text("a,b\n1,2024-01-02\nbad,2024-13-99\n")
    raw = read_table(spark, str(tmp_path / "t.csv"))
    schema = StructType.fromDDL("a bigint, b date, c double")
    rows = sorted(coerce(raw, schema).collect(), key=lambda r: r["a"] or 0)
    assert [tuple(r) for r in rows] == [(None, None, None), (1, date(2024, 1, 2), None)]
    with pytest.raises(ValueError):
        validate(raw, StructType.fromDDL("a bigint NOT NULL, b date"))
    with pytest.raises(ValueError):
        validate(raw, StructType.fromDDL("a bigint"))
    with pytest.raises(ValueError):
        read_table(spark, "x.xml")


def test_row_selection_reports_missing_symbols(spark):
    rows = spark.createDataFrame([("aa", date(2024, 1, 2)), ("bb", date(2023, 1, 2))], "symbol string, d date")
    found, missing = select_rows(rows, ["AA", "BB", "cc"], "symbol", "d", "2024-01-01", "2024-12-31")
    assert found.count() == 1 and {r[0] for r in missing.collect()} == {"BB", "CC"}


def fake_provider(symbols, token):
    start = int(token or 0)
    part = symbols[start : start + 2]
    return Page([{"symbol": s, "n": i + start} for i, s in enumerate(part)], str(start + 2) if start + 2 < len(symbols) else None)


def test_pages_retries_and_the_data_source(spark):
    assert [r["symbol"] for p in pages(lambda t: fake_provider(["A", "B", "C"], t)) for r in p.records] == ["A", "B", "C"]
    with pytest.raises(ProviderError):
        list(pages(lambda t: Page([], "same")))
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ProviderError("busy", 429)
        return "done"

    assert with_retries(flaky, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    with pytest.raises(ProviderError):
        with_retries(lambda: (_ for _ in ()).throw(ProviderError("gone", 404)), sleep=waits.append)
    assert waits == [0.5, 1.0]
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").schema("symbol string, n int").option("provider", "tests.test_sources:fake_provider").option("symbols", "A,B,C,D,E").option("symbols_a_task", "3").load()
    assert sorted(r["symbol"] for r in rows.collect()) == list("ABCDE")
    assert request_key("p", "e", ["b", "A"], "x", "y") == request_key("p", "e", ["a", "B", "b"], "x", "y")
    assert pick_adapter({"x": {"enabled": True, "type": "t"}, "y": {"enabled": True, "type": "u"}}, ["y", "x"], ["t"]) == "x"


def test_ingest_runs_once_and_hashes_ignore_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0)], "i int, s string, v double")
    assert ingest_once(spark, str(tmp_path), "d", "k", lambda: df) is True
    assert ingest_once(spark, str(tmp_path), "d", "k", lambda: 1 / 0) is False
    assert content_hash(df) == content_hash(df.repartition(7).select("v", "s", "i"))
    assert content_hash(df) != content_hash(df.distinct()) and schema_hash(df) != schema_hash(df.drop("v"))
    assert dataset_id("gold", "v1", df).startswith("gold__v1__")
    write_split(df, df.s.isNull().cast("string"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert "&lt;" in lines({"a": [1.0, 2.0, float("nan")]}, "t<") and "<rect" in bars({"x": 1.0, "y": None, "z": -2.0}, "b") and "<rect" in heat_map(["c"], {"r": [0.5]}, "h") and "| 1 | a |" in markdown({"t": df, "u": "text"})
    assert "<td>a</td>" in html_report({"t": df}, {})
    write_json(spark, f"{tmp_path}/d.json", {"a": [1, None]})
    assert read_json(spark, f"{tmp_path}/d.json") == {"a": [1, None]}


def test_synthetic_market_is_the_same_in_any_partitioning(spark):
    cal = calendar_frame(spark, date(2024, 1, 1), date(2024, 3, 1))
    one, two = synthetic_market(spark, cal, 5), synthetic_market(spark, cal.repartition(3), 5)
    assert content_hash(one) == content_hash(two) and one.count() == 5 * cal.count()
    assert one.where("high < greatest(open, close) OR low > least(open, close)").count() == 0
    assert cal.where("session_date = '2024-01-02'").first()["close_utc"] == datetime(2024, 1, 2, 21, 0)


def test_local_rows_get_defaults_and_report_what_is_missing(spark):
    rows = spark.createDataFrame([(" aa", date(2024, 1, 2), None), ("bb", date(2023, 1, 2), "EUR")], "provider_symbol string, trade_date date, currency string")
    found, missing = local_market(rows, ["AA", "BB"], "2024-01-01", "2024-12-31")
    assert [tuple(r) for r in found.select("provider_symbol", "currency", "raw_payload_version").collect()] == [("AA", "USD", "local")] and [r[0] for r in missing.collect()] == ["BB"]
    with pytest.raises(ValueError):
        local_market(rows.drop("provider_symbol"), ["AA"], "2024-01-01", "2024-12-31")
    facts, none = local_facts(spark.createDataFrame([("s1", date(2024, 1, 2))], "security_id string, filing_date date"), ["S1", "S2"], "2024-01-01", "2024-12-31")
    assert facts.first()["metric_unit"] == "USD" and none.count() == 1
    actions = spark.createDataFrame([("s1", date(2024, 1, 2), None), ("s1", date(2024, 1, 2), date(2025, 1, 2))], "security_id string, event_date date, effective_date date")
    assert local_actions(actions, ["s1"], "2024-01-01", "2024-12-31")[0].count() == 1
    market = spark.createDataFrame([(date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5)], "trade_date date, open double, high double, low double, close double")
    assert benchmark_source("proxy", market).count() == 1 == benchmark_source("file", market, market.unionByName(market)).count()
    with pytest.raises(ValueError):
        benchmark_source("file", market)


def lacking(symbols, token):
    return Page([], missing_symbols=[s for s in symbols if s > "B"])


def test_raw_answers_are_kept_and_pages_sliced(spark, tmp_path):
    records = [{"n": i} for i in range(5)]
    answers = list(pages(lambda t: sliced(records, t, 2)))
    assert [r["n"] for p in answers for r in p.records] == [0, 1, 2, 3, 4] and len(answers) == 3 and sliced([], None, 2).next_page_token is None
    answers[0].missing_symbols += ["ZZ", "YY"]
    kept = package(answers)
    assert kept["missing_symbols"] == ["YY", "ZZ"] and kept["pages"][0] == {"records": [{"n": 0}, {"n": 1}]}
    path = keep_raw(spark, str(tmp_path), "d", "k", kept, symbols=["A"])
    assert read_json(spark, path) == kept and keep_raw(spark, str(tmp_path), "d", "k", {"other": 1}) == path and read_json(spark, path) == kept
    calls = []
    assert [cached(spark, str(tmp_path), "u", lambda: calls.append(1) or {"a": 1}) for _ in range(2)] == [{"a": 1}] * 2 and calls == [1]
    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").schema("symbol string").option("provider", "tests.test_sources:lacking").option("symbols", "A,B,C,D").option("rows", "missing").load()
    assert sorted(r[0] for r in rows.collect()) == ["C", "D"]
    write_schemas(spark, str(tmp_path), {"t": spark.createDataFrame([(1,)], "a int")})
    assert read_json(spark, f"{tmp_path}/schemas/t.json")["fields"][0]["name"] == "a"


def test_made_up_tables(spark):
    cal = calendar_frame(spark, date(2024, 1, 1), date(2024, 12, 31))
    assert synthetic_benchmark(cal).where("close IS NULL").count() == 0
    facts = synthetic_facts(cal, 3, ["revenue", "ebit"])
    assert facts.count() == 3 * 2 * 4 and synthetic_facts(cal, 0, ["revenue"]).count() == 0
    assert facts.where("filing_date = '2024-01-30'").first()["acceptance_datetime"] == datetime(2024, 1, 31, 1, 0)
    companies = spark.createDataFrame([("CIK 7", "s7")], "source_company_id string, security_id string")
    own = spark.createDataFrame([("0000000007", date(2024, 2, 1)), ("0000000007", date(2020, 2, 1)), ("0000000008", date(2024, 2, 1))], "source_company_id string, filing_date date")
    assert [r["security_id"] for r in mapped_facts(own, companies, "2024-01-01", "2024-12-31").collect()] == ["s7"]


def test_silver_defaults_feature_sets_and_label_starts(spark):
    rows = spark.createDataFrame([(2.0, 3, None, False), (2.0, 3, 7.0, None)], "close double, volume long, dollar_volume double, is_price_valid boolean")
    assert [tuple(r) for r in silver_rows(rows).select("dollar_volume", "is_price_valid", "data_quality_score").collect()] == [(6.0, False, 1.0), (7.0, True, 1.0)]
    assert silver_rows(rows.drop("dollar_volume")).first()["dollar_volume"] == 6.0
    panel = spark.createDataFrame([], "ret_5 double, roe double, rev_1_x_vol_21 double, label_x double, own double")
    assert feature_columns(panel) == ["ret_5", "roe", "rev_1_x_vol_21"] and feature_columns(panel, "no_interactions") == ["ret_5", "roe"]
    assert feature_columns(panel, "technical", ["own", "label_x", "gone"]) == ["ret_5", "own"]
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 2))], "d date, s date")
    require_label_start(days, "d", "s")
    with pytest.raises(ValueError):
        require_label_start(days, "s", "d")


def test_streamed_windows_count_late_rows_within_the_watermark(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    for i, part in enumerate(([(at(1), "a", 1.0), (at(2), "a", 2.0)], [(at(12), "a", 4.0), (at(3), "a", 8.0)], [(at(50), "a", 0.0)])):
        spark.createDataFrame(part, "ts timestamp, kind string, value double").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = windowed_counts(stream, "ts", "30 minutes", "10 minutes", "10 minutes", "kind")
    query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["window"]["start"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (datetime(2024, 1, 1, 0, 0), 3, 11.0) in got
