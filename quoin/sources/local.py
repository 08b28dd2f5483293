"""Tables from files, security selection and synthetic data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A .csv, .parquet, .pq or .json file or folder. JSON is a list, one object, or an object with the rows under "records"."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("parquet", "pq"):
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind != "json":
        raise ValueError(f"no reader for {path}")
    found = spark.read.option("multiLine", True).json(path)
    if "records" in found.columns and found.schema["records"].dataType.typeName() == "array":
        found = found.select(F.explode("records").alias("r")).select("r.*")
    return found if schema is None else coerce(found, schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def coerce(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, in its order and types; what does not cast, or is missing, is null, and NaN counts as missing."""
    out = []
    for f in schema:
        kind = f.dataType.simpleString()
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        if kind == "array<string>":
            value = F.coalesce(value.cast("array<string>"), F.array().cast("array<string>")) if f.name in df.columns else F.array().cast("array<string>")
        elif kind == "date":
            value = F.coalesce(value.cast("string").try_cast("date"), value.cast("string").try_cast("timestamp").cast("date"))
        else:
            value = value.cast("string").try_cast(kind) if f.name in df.columns and isinstance(df.schema[f.name].dataType.simpleString(), str) else value.cast(kind)
        if kind in ("double", "float"):
            value = F.nanvl(value, F.lit(None).cast(kind))
        out.append(value.alias(f.name))
    return df.select(*out)


def validate(df: DataFrame, schema: StructType, allow_extra: bool = False) -> DataFrame:
    """``coerce``d rows; raises on missing or unexpected columns and on nulls where the schema has none, all found in one pass."""
    missing = [f.name for f in schema if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.names]
    if missing or (extra and not allow_extra):
        raise ValueError(f"missing columns {missing}, unexpected columns {extra}")
    out = coerce(df, schema)
    required = [f.name for f in schema if not f.nullable]
    if required:
        nulls = out.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).first().asDict()
        if bad := {c: n for c, n in nulls.items() if n}:
            raise ValueError(f"nulls in required columns: {bad}")
    return out


def select_rows(df: DataFrame, symbols: Iterable[str], symbol: str, day: str | Sequence[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the symbols with a day in [start, end], symbols without any). ``day``: the first non-null of these columns counts."""
    wanted = df.sparkSession.createDataFrame(sorted({(s.strip().upper(),) for s in symbols}), "symbol_ string")
    days = [day] if isinstance(day, str) else list(day)
    at = F.coalesce(*days) if len(days) > 1 else F.col(days[0])
    rows = df.withColumn("symbol_", F.upper(F.trim(symbol))).where(at.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(wanted, "symbol_", "left_semi")
    return rows.drop("symbol_"), wanted.join(rows.select("symbol_"), "symbol_", "left_anti")


def local_market(rows: DataFrame, symbols: Iterable[str], start: str, end: str, *, currency: str = "USD", version: str = "local") -> tuple[DataFrame, DataFrame]:
    """(market rows of the symbols in [start, end], symbols without any). The symbol is provider_symbol, or else symbol, and comes out in upper case; a table
    without either raises. Missing currencies and payload versions get the defaults."""
    name = next((c for c in ("provider_symbol", "symbol") if c in rows.columns), None)
    if name is None:
        raise ValueError("neither provider_symbol nor symbol")
    found, missing = select_rows(rows, symbols, name, "trade_date", start, end)
    out = found.withColumn("provider_symbol", F.upper(F.trim(name)))
    return out.withColumns({c: F.coalesce(c, F.lit(d)) if c in out.columns else F.lit(d) for c, d in (("currency", currency), ("raw_payload_version", version))}), missing


def local_facts(rows: DataFrame, ids: Iterable[str], start: str, end: str, *, unit: str = "USD", statement: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(facts of the securities filed in [start, end], securities without any), with defaults for missing units and statement types."""
    found, missing = select_rows(rows, ids, "security_id", "filing_date", start, end)
    return found.withColumns({c: F.coalesce(c, F.lit(d)) if c in found.columns else F.lit(d) for c, d in (("metric_unit", unit), ("statement_type", statement))}), missing


def local_actions(rows: DataFrame, names: Iterable[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(corporate actions whose symbol, or else security_id, is among the names and whose effective date, or else event date, lies in [start, end]; names without
    any)."""
    name = next((c for c in ("symbol", "security_id") if c in rows.columns), None)
    if name is None:
        raise ValueError("neither symbol nor security_id")
    days = [c for c in ("effective_date", "event_date") if c in rows.columns]
    return select_rows(rows, names, name, days, start, end)


def benchmark_source(kind: str, market: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """A benchmark (trade_date, open, high, low, close) that is ``own`` for a kind other than "proxy", one row a day, or made from the market."""
    if kind == "proxy":
        return benchmark_proxy(market)
    if own is None:
        raise ValueError(f"no table for a benchmark of kind {kind}")
    return own.select("trade_date", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close"))).dropDuplicates(["trade_date"])


def select_securities(master: DataFrame, n: int, allowed: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` securities: common stock first, then main exchanges, plain tickers, symbol and id; only ``allowed`` ids, if given."""
    rows = master.where(F.col("security_id").isin(list(allowed))) if allowed else master
    main = F.upper("exchange").isin("NYSE", "NASDAQ")
    order = [F.coalesce("is_common_stock", F.lit(False)).desc(), F.coalesce(main, F.lit(False)).desc(), F.coalesce(F.col("symbol").rlike("^[A-Z]{1,5}$"), F.lit(False)).desc(), F.col("symbol").asc_nulls_last(), F.col("security_id")]
    return rows.orderBy(*order).limit(n)


def benchmark_proxy(market: DataFrame) -> DataFrame:
    """A benchmark from the market itself: mean prices per day."""
    return market.groupBy("trade_date").agg(*(F.avg(c).alias(c) for c in ("open", "high", "low", "close")))


def synthetic_market(spark: SparkSession, calendar: DataFrame, securities: int, seed: int = 42) -> DataFrame:
    """Deterministic prices: a trend and a cycle per security, with noise from a hash of seed, security and session, so any partition of the
    grid makes the same rows. Sessions are exploded per security from one array; nothing is joined."""
    days = calendar.agg(F.array_sort(F.collect_list(F.struct("session_no", "session_date"))).alias("days"))
    ids = spark.range(securities).select(F.col("id").alias("i"), F.format_string("SYN_%06d", "id").alias("security_id"))
    rows = ids.join(F.broadcast(days)).select("i", "security_id", F.explode("days").alias("d")).select("i", "security_id", F.col("d.session_no").alias("t"), F.col("d.session_date").alias("trade_date"))
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "i", "t"), F.lit(1 << 40)) / float(1 << 40)
    noise = F.sqrt(-2 * F.ln(unit(1) + 1e-12)) * F.cos(2 * pi * unit(2))
    close = (25 + 7.5 * F.col("i") + (0.11 + 0.02 * (F.col("i") % 7)) * F.col("t") + 0.7 * F.sin(F.col("t") / 9 + F.col("i"))) * (1 + 0.004 * noise)
    priced = rows.withColumn("close", F.round(F.greatest(close, F.lit(1.0)), 3)).withColumn("open", F.round(F.col("close") * (0.997 + 0.006 * unit(3)), 3))
    high, low = F.round(F.greatest("open", "close") * (1 + 0.004 * unit(4)), 3), F.round(F.least("open", "close") * (1 - 0.004 * unit(5)), 3)
    return priced.select("security_id", "trade_date", "open", high.alias("high"), low.alias("low"), "close", F.floor(1e5 + 9e5 * unit(6)).alias("volume"))


def synthetic_benchmark(calendar: DataFrame) -> DataFrame:
    """A benchmark with a trend and a cycle over the sessions."""
    t = F.col("session_no") - 1
    rows = calendar.select(F.col("session_date").alias("trade_date"), (100 + 0.18 * t + 1.4 * F.sin(t / 10.0)).alias("close"))
    return rows.select("trade_date", (0.999 * F.col("close")).alias("open"), (1.002 * F.col("close")).alias("high"), (0.997 * F.col("close")).alias("low"), "close")


def synthetic_facts(calendar: DataFrame, securities: int, metrics: Sequence[str], *, first: int = 20, every: int = 63) -> DataFrame:
    """One fact per security and metric at every 63rd session from the 20th, known at 20:00 in New York that day; values grow with the session."""
    days = calendar.where(f"session_no >= {first} AND (session_no - {first}) % {every} = 0").select("session_no", "session_date")
    ids = F.explode(F.sequence(F.lit(0), F.lit(max(0, securities - 1)))).alias("i")
    rows = days.select("session_no", "session_date", ids).where(F.col("i") < securities).select("*", F.posexplode(F.array(*map(F.lit, metrics))).alias("m", "metric_name_raw"))
    known = F.to_utc_timestamp(F.col("session_date").cast("timestamp") + F.make_dt_interval(hours=F.lit(20)), "America/New_York")
    return rows.select(F.format_string("SYN_%06d", "i").alias("security_id"), "metric_name_raw", (100.0 + 10 * F.col("i") + F.col("m") + 0.05 * F.col("session_no")).alias("metric_value"), F.col("session_date").alias("filing_date"), known.alias("acceptance_datetime"))
