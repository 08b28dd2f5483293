"""Calendar, ingest, quality and point-in-time queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.expr import grid
from quoin.operators.calendar import label_windows, session_distance, shift_sessions
from quoin.operators.normalize import EXCHANGES, METRICS as METRIC_ALIASES, normalize_actions, normalize_market, normalize_master, action_problem, available_from, canonical_metric, cik, exchange_label, flag_duplicates, flag_restatements, map_symbols, security_type
from quoin.operators.pit import asof_metrics, build_intervals, coverage, from_the_future
from quoin.operators.quality import FLAGS, fact_issues, issues, market_flags, missing_sessions, scored, summary
from quoin.plans.base import BASE, calendar, grid_sql, market
from quoin.plans.facts import FACTS_SQL, metric_facts
from quoin.plans.features import METRICS, _asof_cte
from quoin.session import table


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in columns})


# calendar -----------------------------------------------------------------------------------------------------------
def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bronze_market").select(F.col("trade_date").alias("day")).distinct()


def session_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next and previous session, and five sessions on, of every day that occurs."""
    cal = calendar(spark, sf_dir)
    out = _days(spark, sf_dir)
    for steps, name in ((1, "next_session"), (-1, "previous_session"), (5, "fifth_session")):
        out = shift_sessions(cal, out, "day", steps, name)
    return _day(out, "day", "next_session", "previous_session", "fifth_session")


def session_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions between the filing and the fiscal period's end of facts."""
    pairs = table(spark, sf_dir, "silver_fundamentals").select("fiscal_period_end", "filing_date").where("filing_date IS NOT NULL").distinct()
    return _day(session_distance(calendar(spark, sf_dir), pairs, "fiscal_period_end", "filing_date", "distance"), "fiscal_period_end", "filing_date")


def label_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(label_windows(calendar(spark, sf_dir), 5), "decision_date", "execution_date", "end_date")


# ingest -------------------------------------------------------------------------------------------------------------
def _master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "security_master").where("symbol IS NOT NULL").select("security_id", "symbol", "listing_date", "delisting_date")


def symbol_map_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions with the security that their symbol meant on the event's day."""
    actions = table(spark, sf_dir, "corporate_actions").select("symbol", "event_date").distinct()
    return _day(map_symbols(actions, _master(spark, sf_dir), symbol="symbol", day="event_date"), "event_date")


def missing_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of actions that no security has."""
    known = _master(spark, sf_dir).select(F.upper(F.trim("symbol")).alias("symbol"))
    wanted = table(spark, sf_dir, "corporate_actions").select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    return wanted.join(known, "symbol", "left_anti")


def metric_name_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "silver_fundamentals")
    return facts.select(F.col("metric_name_canonical").alias("raw"), canonical_metric("metric_name_canonical").alias("canonical")).groupBy("raw", "canonical").agg(F.count(F.lit(1)).alias("rows"))


def available_from_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "silver_fundamentals").select("fact_id", available_from("filing_date", "acceptance_datetime").alias("t")).distinct()
    return facts.select("fact_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("available_from"))


def restatement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "silver_fundamentals").select("fact_id", "source_company_id", "metric_name_canonical", "fiscal_period_end", "available_from").distinct()
    return flag_restatements(facts, ["source_company_id", "metric_name_canonical", "fiscal_period_end"], ["available_from", "fact_id"]).select("fact_id", "restatement")


def duplicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "silver_fundamentals").select("fact_id", "security_id", "metric_name_canonical", "available_from", "metric_value")
    flagged = flag_duplicates(facts, ["security_id", "metric_name_canonical", "available_from", "metric_value"])
    return flagged.where("duplicate").groupBy("fact_id").agg(F.count(F.lit(1)).alias("rows"))


def corp_action_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and quarantined corporate actions by type and reason."""
    actions = table(spark, sf_dir, "corporate_actions").distinct()
    return actions.groupBy(F.lower(F.trim("event_type")).alias("event_type"), action_problem("event_type", "security_id").alias("problem")).agg(F.count(F.lit(1)).alias("rows"))


#: Words that turn a part's name into one that every rule has to decide on, and labels of exchanges, both by part number.
RULE_WORDS = ("", " adr", " Depositary Receipt", " ETF", " trust", " Fund", " portfolio", " preferred", " WARRANT", " unit", " unit common", " Corp")
RULE_LABELS = ("NYSE Arca", " nyse american", "NYSE MKT ", "Nasdaq Global Select", "NASDAQ CAPITAL MARKET", "Cboe BZX", "NYSE", "otc")


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security types inferred from names, and exchange labels, by ordered rules: names of parts with a word that trips a rule, each rule in turn."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), F.pmod("p_partkey", F.lit(len(words))).cast("int"))
    made = names.select("p_partkey", F.concat("p_name", pick(RULE_WORDS)).alias("name"), pick(RULE_LABELS).alias("label"))
    return made.select("p_partkey", security_type("name").alias("security_type"), exchange_label("label").alias("exchange"))


def market_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the raw market by the security that their symbol stands for; unmapped ones are left out."""
    rows = normalize_market(table(spark, sf_dir, "bronze_market").select("record_id", "symbol"), _master(spark, sf_dir), "feed", "v1")
    return rows.select("record_id", "symbol", "security_id", "provider_name", "data_version")


def actions_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize_actions(table(spark, sf_dir, "corporate_actions").distinct(), _master(spark, sf_dir), "v1")
    return _day(rows.select("security_id", "symbol", "event_type", "event_date", "split_ratio", "old_symbol", "new_symbol", "problem"), "event_date")


def master_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize_master(table(spark, sf_dir, "security_master"))
    return rows.groupBy("security_id", "symbol", "exchange", "security_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad_interval").alias("bad"))


def market_qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = missing_sessions(table(spark, sf_dir, "silver_market"), ["security_id"], "trade_date", calendar(spark, sf_dir))
    return summary(scored(_flagged(spark, sf_dir)), missing).withColumn("mean_score", grid("mean_score", 5))


def company_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "silver_fundamentals").select("source_company_id", cik("source_company_id").alias("cik")).distinct()


# quality ------------------------------------------------------------------------------------------------------------
def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bronze_market").select("record_id", "security_id", "provider_name", "trade_date", "open", "high", "low", "close", "volume")
    actions = table(spark, sf_dir, "corporate_actions").where(F.lower("event_type") == "split")
    splits = actions.where("security_id IS NOT NULL").select("security_id", F.coalesce("effective_date", "event_date").alias("split_day"))
    return market_flags(rows, splits, ["security_id", "provider_name"], "trade_date", ["record_id"])


def market_qa_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("record_id", *FLAGS, "extreme_jump", "jump_explained", grid("close_return").alias("close_return"))


def market_qa_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_flagged(spark, sf_dir)).select("record_id", grid("data_quality_score").alias("data_quality_score"), "is_price_valid", "is_volume_valid", "tradable_flag")


def market_qa_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(_flagged(spark, sf_dir), ["record_id"])


def market_qa_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(missing_sessions(table(spark, sf_dir, "silver_market"), ["security_id"], "trade_date", calendar(spark, sf_dir)), "session_date")


def fundamentals_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("fact_id", "security_id", "metric_name_canonical", "metric_value", "metric_unit", "filing_date", "acceptance_datetime")
    return fact_issues(table(spark, sf_dir, "silver_fundamentals").select(*columns).distinct())


def fundamentals_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "silver_fundamentals").select("fact_id", "metric_name_canonical", "metric_value", "fiscal_period_end").distinct()
    return facts.groupBy("metric_name_canonical", F.year("fiscal_period_end").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.count("metric_value").alias("present"))


def fundamentals_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from each security's last availability to the last of all."""
    last = table(spark, sf_dir, "silver_fundamentals").groupBy("security_id").agg(F.max("available_from").alias("last"))
    all_last = last.agg(F.max("last").alias("as_of"))
    return last.join(F.broadcast(all_last)).select("security_id", F.floor((F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 86_400_000_000).alias("stale_days"))


# point in time ------------------------------------------------------------------------------------------------------
def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_facts(spark, sf_dir, "fact_id", "metric_value", "available_from", "available_to").drop("value_type").distinct()


def pit_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_intervals(_facts(spark, sf_dir).drop("available_to"), ["security_id", "metric_name"], "available_from")
    return built.select("fact_id", F.date_format("available_to", "yyyy-MM-dd HH:mm:ss").alias("available_to"), "is_latest")


def _pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar(spark, sf_dir).select(F.col("session_date").alias("date"), F.col("close_utc").alias("as_of"))
    rows = market(spark, sf_dir).select("security_id", "date").join(days, "date", "left")
    facts = _facts(spark, sf_dir).where("available_to IS NULL OR available_to > available_from")
    return asof_metrics(rows, facts, "security_id", "as_of", METRICS, metric="metric_name", value="metric_value", known="available_from", until="available_to")


def pit_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_pit(spark, sf_dir).select("security_id", "date", *METRICS), "date")


def pit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage(_pit(spark, sf_dir), METRICS)
    return out.select("metric_name", "rows", "present", grid("coverage").alias("coverage"))


def pit_future_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that became known after their row's time: none at the close, and many if the same rows had been decided thirty days before."""
    panel = _pit(spark, sf_dir)
    early = panel.withColumn("as_of", F.col("as_of") - F.make_dt_interval(days=F.lit(30)))
    both = [from_the_future(p, "as_of", METRICS).withColumn("decided", F.lit(n)) for n, p in (("close", panel), ("early", early))]
    return both[0].unionByName(both[1])


QUERIES = {f.__name__: f for f in (
    session_shifts, session_distances, label_window, symbol_map_asof, missing_symbols, metric_name_canonical, available_from_policy, restatement_flags, duplicate_facts,
    market_normalised, actions_normalised, master_normalised, market_qa_summary, corp_action_split, name_rules, company_ids, market_qa_flags, market_qa_score, market_qa_issues, market_qa_missing, fundamentals_qa, fundamentals_completeness,
    fundamentals_staleness, pit_intervals, pit_asof_join, pit_coverage, pit_future_guard,
)}

# --- DuckDB ---------------------------------------------------------------------------------------------------------
_D = "strftime({0}, '%Y-%m-%d') AS {0}"
_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in EXCHANGES.items())
_ALIAS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in METRIC_ALIASES.items())
_PLAIN = "replace(regexp_replace(lower(metric_name_canonical), '[^\\p{L}\\p{N}_]', '', 'g'), '__', '_')"
_UP = "(SELECT count(*) FROM trading_calendar c WHERE c.session_date {op} {x})"
_QA = """q0 AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY security_id, provider_name ORDER BY trade_date, record_id), 0) - 1 AS close_return,
  coalesce(high < greatest(open, close, low) OR low > least(open, close, high), false) AS invalid_ohlc, coalesce(least(open, high, low, close) <= 0, false) AS invalid_price_nonpositive,
  coalesce(volume < 0, false) AS invalid_volume, count(*) OVER (PARTITION BY security_id, provider_name, trade_date) > 1 AS duplicate_key FROM bronze_market),
sp AS (SELECT DISTINCT security_id, coalesce(effective_date, event_date) AS trade_date FROM corporate_actions WHERE lower(event_type) = 'split' AND security_id IS NOT NULL),
qa AS (SELECT q0.*, sp.trade_date IS NOT NULL AS jump_explained, coalesce(abs(close_return) > 0.5, false) AS extreme_jump,
  coalesce(abs(close_return) > 0.5, false) AND sp.trade_date IS NULL AS unexplained_jump FROM q0 LEFT JOIN sp USING (security_id, trade_date))"""
_TOTAL = " + ".join(f"{f}::INT" for f in FLAGS)
_PRICE_OK = "NOT (invalid_ohlc OR invalid_price_nonpositive OR unexplained_jump)"
_PIT_CTE = f"WITH {BASE}, {_asof_cte(list(METRICS))}"
_SYMBOLS = "sy AS (SELECT upper(trim(symbol)) AS symbol, min(security_id) AS i FROM security_master WHERE symbol IS NOT NULL AND security_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT security_id) = 1)"
_NAMED = f"(SELECT p_partkey, upper(p_name || ({list(RULE_WORDS)!r})[p_partkey % {len(RULE_WORDS)} + 1]) AS n, upper(trim(({list(RULE_LABELS)!r})[p_partkey % {len(RULE_LABELS)} + 1])) AS l FROM part)"
SQL = {
    "session_shifts": "WITH d AS (SELECT DISTINCT trade_date AS day FROM bronze_market), n AS (SELECT day, "
    + f"{_UP.format(op='<=', x='day')} AS le, {_UP.format(op='<', x='day')} AS lt FROM d) SELECT {_D.format('day')}, strftime(a.session_date, '%Y-%m-%d') AS next_session, "
    + "strftime(b.session_date, '%Y-%m-%d') AS previous_session, strftime(e.session_date, '%Y-%m-%d') AS fifth_session FROM n LEFT JOIN trading_calendar a ON a.session_no = le + 1 "
    + "LEFT JOIN trading_calendar b ON b.session_no = lt LEFT JOIN trading_calendar e ON e.session_no = le + 5",
    "session_distances": f"""WITH p AS (SELECT DISTINCT fiscal_period_end, filing_date FROM silver_fundamentals WHERE filing_date IS NOT NULL)
SELECT {_D.format('fiscal_period_end')}, {_D.format('filing_date')}, CASE WHEN fiscal_period_end = filing_date THEN 0 WHEN fiscal_period_end < filing_date
  THEN (SELECT count(*) FROM trading_calendar c WHERE c.session_date BETWEEN fiscal_period_end AND filing_date) - 1
  ELSE 1 - (SELECT count(*) FROM trading_calendar c WHERE c.session_date BETWEEN filing_date AND fiscal_period_end) END AS distance FROM p""",
    "label_window": "SELECT strftime(a.session_date, '%Y-%m-%d') AS decision_date, strftime(b.session_date, '%Y-%m-%d') AS execution_date, strftime(c.session_date, '%Y-%m-%d') AS end_date "
    + "FROM trading_calendar a JOIN trading_calendar b ON b.session_no = a.session_no + 1 JOIN trading_calendar c ON c.session_no = a.session_no + 6",
    "symbol_map_asof": f"""WITH a AS (SELECT DISTINCT symbol, event_date FROM corporate_actions),
m AS (SELECT DISTINCT upper(trim(symbol)) AS s, security_id, listing_date, delisting_date FROM security_master WHERE symbol IS NOT NULL)
SELECT symbol, {_D.format('event_date')}, CASE WHEN count(DISTINCT security_id) = 1 THEN min(security_id) END AS mapped_id, count(DISTINCT security_id) AS candidates
FROM a LEFT JOIN m ON m.s = upper(trim(a.symbol)) AND (listing_date IS NULL OR listing_date <= event_date) AND (delisting_date IS NULL OR event_date <= delisting_date) GROUP BY symbol, a.event_date""",
    "missing_symbols": "SELECT DISTINCT upper(trim(symbol)) AS symbol FROM corporate_actions WHERE upper(trim(symbol)) NOT IN (SELECT upper(trim(symbol)) FROM security_master WHERE symbol IS NOT NULL)",
    "metric_name_canonical": f"SELECT metric_name_canonical AS raw, CASE {_PLAIN} {_ALIAS} ELSE {_PLAIN} END AS canonical, count(*) AS rows FROM silver_fundamentals GROUP BY 1, 2",
    "available_from_policy": """WITH f AS (SELECT DISTINCT fact_id, filing_date, acceptance_datetime FROM silver_fundamentals),
o AS (SELECT *, CASE WHEN filing_date >= make_date(year(filing_date)::INT, 3, 14) - ((dayofweek(make_date(year(filing_date)::INT, 3, 14))))::INT
  AND filing_date < make_date(year(filing_date)::INT, 11, 7) - (dayofweek(make_date(year(filing_date)::INT, 11, 7)))::INT THEN 4 ELSE 5 END AS hours FROM f)
SELECT fact_id, strftime(greatest(filing_date::TIMESTAMP + INTERVAL '23:59:59' HOUR TO SECOND + to_hours(hours), acceptance_datetime), '%Y-%m-%d %H:%M:%S') AS available_from FROM o""".replace(
        "INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"
    ),
    "restatement_flags": """WITH f AS (SELECT DISTINCT fact_id, source_company_id, metric_name_canonical, fiscal_period_end, available_from FROM silver_fundamentals)
SELECT fact_id, row_number() OVER (PARTITION BY source_company_id, metric_name_canonical, fiscal_period_end ORDER BY available_from, fact_id) > 1 AS restatement FROM f""",
    "duplicate_facts": """WITH f AS (SELECT fact_id, count(*) OVER (PARTITION BY security_id, metric_name_canonical, available_from, metric_value) n FROM silver_fundamentals)
SELECT fact_id, count(*) AS rows FROM f WHERE n > 1 GROUP BY 1""",
    "corp_action_split": """WITH a AS (SELECT DISTINCT * FROM corporate_actions)
SELECT lower(trim(event_type)) AS event_type, CASE WHEN lower(trim(event_type)) NOT IN ('split', 'dividend', 'delisting', 'symbol_change') THEN 'unknown_type'
  WHEN security_id IS NULL THEN 'unmapped_security' END AS problem, count(*) AS rows FROM a GROUP BY 1, 2""",
    "name_rules": f"""SELECT p_partkey, CASE WHEN regexp_matches(n, 'ADR|DEPOSITARY') THEN 'adr' WHEN regexp_matches(n, 'ETF|TRUST|FUND|PORTFOLIO') THEN 'etf'
  WHEN n LIKE '%PREFERRED%' THEN 'preferred' WHEN n LIKE '%WARRANT%' THEN 'warrant' WHEN n LIKE '%UNIT%' AND n NOT LIKE '%COMM%' THEN 'unit' ELSE 'common_stock' END AS security_type,
  CASE l {_CASE} ELSE l END AS exchange FROM {_NAMED}""",
    "company_ids": """SELECT DISTINCT source_company_id, CASE WHEN length(regexp_replace(source_company_id, '[^0-9]', '', 'g')) > 0
  THEN CASE WHEN length(regexp_replace(source_company_id, '[^0-9]', '', 'g')) > 10 THEN regexp_replace(source_company_id, '[^0-9]', '', 'g') ELSE lpad(regexp_replace(source_company_id, '[^0-9]', '', 'g'), 10, '0') END END AS cik FROM silver_fundamentals""",
    "market_qa_flags": f"WITH {_QA} SELECT record_id, {', '.join(FLAGS)}, extreme_jump, jump_explained, {grid_sql('close_return')} AS close_return FROM qa",
    "market_qa_score": f"WITH {_QA} SELECT record_id, {grid_sql(f'greatest(1.0::DOUBLE - 0.2::DOUBLE * ({_TOTAL}), 0)')} AS data_quality_score, {_PRICE_OK} AS is_price_valid, "
    + f"NOT invalid_volume AS is_volume_valid, {_PRICE_OK} AND NOT invalid_volume AND NOT duplicate_key AS tradable_flag FROM qa",
    "market_qa_issues": f"WITH {_QA} " + " UNION ALL ".join(f"SELECT record_id, '{f}' AS issue FROM qa WHERE {f}" for f in FLAGS),
    "market_qa_missing": f"""WITH r AS (SELECT DISTINCT security_id, session_no FROM silver_market JOIN trading_calendar ON session_date = trade_date),
b AS (SELECT security_id, min(session_no) lo, max(session_no) hi FROM r GROUP BY 1)
SELECT security_id, {_D.format('session_date')} FROM b JOIN trading_calendar c ON c.session_no BETWEEN lo AND hi ANTI JOIN r USING (security_id, session_no)""",
    "fundamentals_qa": """WITH f AS (SELECT DISTINCT fact_id, security_id, metric_name_canonical, metric_value, metric_unit, filing_date, acceptance_datetime FROM silver_fundamentals),
u AS (SELECT metric_name_canonical FROM f GROUP BY 1 HAVING count(DISTINCT lower(metric_unit)) > 1)
SELECT fact_id, security_id, 'unparseable_value' AS issue FROM f WHERE metric_value IS NULL
UNION ALL SELECT fact_id, security_id, 'missing_availability' FROM f WHERE filing_date IS NULL AND acceptance_datetime IS NULL
UNION ALL SELECT fact_id, security_id, 'acceptance_before_filing' FROM f WHERE CAST(acceptance_datetime AS DATE) < filing_date
UNION ALL SELECT fact_id, security_id, 'inconsistent_units' FROM f WHERE metric_name_canonical IN (SELECT metric_name_canonical FROM u)""",
    "fundamentals_completeness": """WITH f AS (SELECT DISTINCT fact_id, metric_name_canonical, metric_value, fiscal_period_end FROM silver_fundamentals)
SELECT metric_name_canonical, year(fiscal_period_end) AS year, count(*) AS rows, count(metric_value) AS present FROM f GROUP BY 1, 2""",
    "fundamentals_staleness": """WITH l AS (SELECT security_id, max(available_from) AS last FROM silver_fundamentals GROUP BY 1)
SELECT security_id, floor((epoch_us((SELECT max(last) FROM l)) - epoch_us(last)) / 86400000000.0)::BIGINT AS stale_days FROM l""",
    "pit_intervals": f"""WITH {FACTS_SQL}, i AS (SELECT fact_id, lead(available_from) OVER (PARTITION BY security_id, metric_name ORDER BY available_from) AS t FROM facts)
SELECT fact_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS available_to, t IS NULL AS is_latest FROM i""",
    "pit_asof_join": f"{_PIT_CTE} SELECT security_id, {_D.format('date')}, {', '.join(METRICS)} FROM pm",
    "pit_coverage": f"{_PIT_CTE} " + " UNION ALL ".join(f"SELECT '{m}' AS metric_name, count(*) AS rows, count({m}) AS present, {grid_sql(f'count({m}) / greatest(count(*), 1)')} AS coverage FROM pm" for m in METRICS),
    "pit_future_guard": f"{_PIT_CTE}, pk AS (SELECT t.as_of, {', '.join(f'CASE WHEN f{i}.available_to IS NULL OR t.as_of < f{i}.available_to THEN f{i}.available_from END AS k{i}' for i in range(len(METRICS)))} FROM t "
    + " ".join(f"ASOF LEFT JOIN (SELECT security_id, available_from, available_to FROM ff WHERE metric_name = '{m}') f{i} ON f{i}.security_id = t.security_id AND f{i}.available_from <= t.as_of" for i, m in enumerate(METRICS))
    + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric_name, count(*) FILTER (WHERE k{i} > as_of{back}) AS violations, '{n}' AS decided FROM pk" for i, m in enumerate(METRICS) for n, back in (("close", ""), ("early", " - INTERVAL 30 DAY"))),
    "market_normalised": f"""WITH {_SYMBOLS} SELECT record_id, upper(trim(b.symbol)) AS symbol, i AS security_id, 'feed' AS provider_name, 'v1' AS data_version FROM bronze_market b JOIN sy ON sy.symbol = upper(trim(b.symbol))""",
    "actions_normalised": f"""WITH {_SYMBOLS}, a AS (SELECT DISTINCT * FROM corporate_actions),
n AS (SELECT coalesce(a.security_id, sy.i) AS security_id, upper(trim(a.symbol)) AS symbol, lower(trim(event_type)) AS event_type, event_date, split_ratio, upper(trim(old_symbol)) AS old_symbol, upper(trim(new_symbol)) AS new_symbol
  FROM a LEFT JOIN sy ON sy.symbol = coalesce(upper(trim(a.symbol)), upper(trim(old_symbol))))
SELECT * REPLACE (strftime(event_date, '%Y-%m-%d') AS event_date), CASE WHEN event_type IS NULL OR event_type NOT IN ('split', 'dividend', 'delisting', 'symbol_change') THEN 'unknown_type' WHEN security_id IS NULL THEN 'unmapped_security' END AS problem FROM n""",
    "master_normalised": """SELECT security_id, upper(symbol) AS symbol, upper(exchange) AS exchange, lower(security_type) AS security_type, count(*) AS rows, count(*) FILTER (WHERE delisting_date < listing_date) AS bad
FROM security_master GROUP BY 1, 2, 3, 4""",
    "market_qa_summary": f"""WITH {_QA}, r AS (SELECT DISTINCT security_id, session_no FROM silver_market JOIN trading_calendar ON session_date = trade_date), b AS (SELECT security_id, min(session_no) lo, max(session_no) hi FROM r GROUP BY 1),
x AS (SELECT count(*) AS m FROM b JOIN trading_calendar c ON c.session_no BETWEEN lo AND hi ANTI JOIN r USING (security_id, session_no))
SELECT count(*) AS rows_total, count(*) FILTER (WHERE invalid_ohlc) AS invalid_ohlc_rows, count(*) FILTER (WHERE invalid_volume) AS invalid_volume_rows, count(*) FILTER (WHERE duplicate_key) AS duplicate_rows,
  count(*) FILTER (WHERE unexplained_jump) AS unexplained_jump_rows, {grid_sql(f'avg(greatest(1.0::DOUBLE - 0.2::DOUBLE * ({_TOTAL}), 0))', 5)} AS mean_score, (SELECT m FROM x) AS missing_sessions FROM qa""",
}
