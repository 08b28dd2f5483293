"""Normalisation of ingested records: names, symbols, types and availability, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Exchange labels: fixed values.
EXCHANGES = {"NYSE ARCA": "NYSE", "NYSE AMERICAN": "AMEX", "NYSE MKT": "AMEX", "NASDAQ GLOBAL SELECT": "NASDAQ", "NASDAQ CAPITAL MARKET": "NASDAQ", "CBOE BZX": "CBOE"}
#: Canonical metric of a normalised name: fixed values.
METRICS = {
    "bookequity": "book_equity", "book_equity": "book_equity", "stockholdersequity": "book_equity",
    "netincome": "net_income_ttm", "net_income": "net_income_ttm", "net_income_ttm": "net_income_ttm",
    "revenue": "revenue_ttm", "revenue_ttm": "revenue_ttm",
    "operatingcashflow": "operating_cashflow_ttm", "operating_cashflow_ttm": "operating_cashflow_ttm",
    "grossprofit": "gross_profit_ttm", "gross_profit_ttm": "gross_profit_ttm",
    "operatingincome": "operating_income_ttm", "operating_income_ttm": "operating_income_ttm",
    "totalassets": "total_assets", "total_assets": "total_assets",
    "totaldebt": "total_debt", "total_debt": "total_debt",
    "ebit": "ebit_ttm", "ebit_ttm": "ebit_ttm",
    "interestexpense": "interest_expense_ttm", "interest_expense_ttm": "interest_expense_ttm",
    "currentassets": "current_assets", "current_assets": "current_assets",
    "currentliabilities": "current_liabilities", "current_liabilities": "current_liabilities",
    "sharesoutstanding": "shares_outstanding", "shares_outstanding": "shares_outstanding",
}
ACTIONS = ("split", "dividend", "delisting", "symbol_change")
ZONE = "America/New_York"


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """``table``'s value for ``c``, else ``c``."""
    if not table:
        return c
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*table.items()))), c), c)


def canonical_metric(name: str, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower case, letters, digits and underscores only, double underscores made single, then an alias lookup (METRICS by default)."""
    plain = F.replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", ""), F.lit("__"), F.lit("_"))
    return mapped(plain, METRICS if aliases is None else aliases)


def available_from(filing_date: str, accepted: str) -> Column:
    """The later of the end of the filing day in New York and the acceptance; either may be missing; in UTC."""
    end = F.to_utc_timestamp(F.col(filing_date).cast("timestamp") + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59), secs=F.lit(59)), ZONE)
    return F.greatest(end, F.col(accepted).cast("timestamp"))


def cik(c: str) -> Column:
    """Digits alone, padded to ten; longer ones stay whole; null where there are none."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) > 10, digits).when(F.length(digits) > 0, F.lpad(digits, 10, "0"))


def exchange_label(c: str) -> Column:
    return mapped(F.upper(F.trim(c)), EXCHANGES)


def security_type(name: str) -> Column:
    """Type from a security's name: the first rule that holds."""
    n = F.upper(name)
    has = lambda *words: F.lit(False) if not words else chain_or([n.contains(w) for w in words])
    return (
        F.when(has("ADR", "DEPOSITARY"), "adr").when(has("ETF", "TRUST", "FUND", "PORTFOLIO"), "etf").when(has("PREFERRED"), "preferred").when(has("WARRANT"), "warrant")
        .when(has("UNIT") & ~has("COMM"), "unit").otherwise("common_stock")
    )


def chain_or(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def flag_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """duplicate: another row has the same keys."""
    return df.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def flag_restatements(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """restatement: a row of the same keys came earlier in ``order``."""
    return df.withColumn("restatement", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def action_problem(event_type: str, security_id: str) -> Column:
    """Why a corporate action goes to quarantine; null for a valid one."""
    kind = F.lower(F.trim(event_type))
    return F.when(kind.isNull() | ~kind.isin(*ACTIONS), "unknown_type").when(F.col(security_id).isNull(), "unmapped_security")


def symbol_table(master: DataFrame) -> DataFrame:
    """symbol (upper case, no outer blanks) and mapped_id of the symbols that belong to exactly one security."""
    own = master.select(F.upper(F.trim("symbol")).alias("symbol"), F.col("security_id").alias("i")).where("symbol IS NOT NULL AND i IS NOT NULL")
    return own.groupBy("symbol").agg(F.min("i").alias("mapped_id"), F.max("i").alias("other")).where("mapped_id = other").drop("other")


def normalize_market(rows: DataFrame, master: DataFrame, provider: str, version: str) -> DataFrame:
    """Market rows with upper-case symbol, security_id by symbol, provider_name and data_version; rows whose symbol no single security has are
    left out. Columns of those names are replaced."""
    own = rows.drop("security_id").withColumn("symbol", F.upper(F.trim("symbol")))
    return own.join(symbol_table(master).withColumnRenamed("mapped_id", "security_id"), "symbol").withColumns({"provider_name": F.lit(provider), "data_version": F.lit(version)})


def normalize_actions(rows: DataFrame, master: DataFrame, version: str) -> DataFrame:
    """Corporate actions in lower-case types and upper-case symbols, with dates and numbers parsed (null where they do not parse), an id by symbol, or by
    old symbol, where there is none, and ``problem``, why a row goes to quarantine."""
    up = {c: F.upper(F.trim(c)) for c in ("symbol", "old_symbol", "new_symbol")}
    parsed = {c: F.col(c).cast("string").try_cast("date") for c in ("event_date", "effective_date")} | {c: F.col(c).cast("string").try_cast("double") for c in ("split_ratio", "dividend_amount")}
    own = rows.withColumns(up | parsed | {"event_type": F.lower(F.trim("event_type"))}).withColumn("base_", F.coalesce("symbol", "old_symbol"))
    found = own.join(symbol_table(master).withColumnRenamed("symbol", "base_"), "base_", "left").withColumn("security_id", F.coalesce("security_id", "mapped_id"))
    return found.drop("base_", "mapped_id").withColumns({"data_version": F.lit(version), "problem": action_problem("event_type", "security_id")})


def normalize_master(rows: DataFrame) -> DataFrame:
    """Security rows with upper-case exchange and symbol, lower-case type, and bad_interval: delisted before it was listed."""
    own = rows.withColumns({"exchange": F.upper("exchange"), "symbol": F.upper("symbol"), "security_type": F.lower("security_type")})
    return own.withColumn("bad_interval", F.coalesce(F.col("delisting_date") < F.col("listing_date"), F.lit(False)))


def require_intervals(master: DataFrame) -> DataFrame:
    """``normalize_master`` rows in order of security and symbol; raises if one has a bad interval."""
    if not master.where("bad_interval").isEmpty():
        raise ValueError("a security is delisted before it was listed")
    return master.drop("bad_interval").orderBy("security_id", "symbol")


def map_symbols(rows: DataFrame, master: DataFrame, *, symbol: str, day: str | None = None) -> DataFrame:
    """``rows`` with mapped_id, the one security of that symbol (whose [listed, delisted] covers ``day``, if given), and candidates, how many
    there are; mapped_id is null unless there is exactly one. Symbols compare in upper case without outer blanks."""
    left = rows.withColumns({"row_": F.monotonically_increasing_id(), "symbol_": F.upper(F.trim(symbol))})
    right = master.select(F.upper(F.trim("symbol")).alias("symbol_"), F.col("security_id").alias("id_"), "listing_date", "delisting_date").distinct()
    on = F.col("l.symbol_") == F.col("r.symbol_")
    if day:
        on = on & (F.col("r.listing_date").isNull() | (F.col("r.listing_date") <= F.col(f"l.{day}"))) & (F.col("r.delisting_date").isNull() | (F.col(f"l.{day}") <= F.col("r.delisting_date")))
    hits = left.alias("l").join(right.alias("r"), on, "left")
    keep = [c for c in rows.columns]
    counted = hits.groupBy("l.row_", *(f"l.{c}" for c in keep)).agg(F.count_distinct("r.id_").alias("candidates"), F.min("r.id_").alias("id_"))
    return counted.select(*keep, F.when(F.col("candidates") == 1, F.col("id_")).alias("mapped_id"), "candidates")
