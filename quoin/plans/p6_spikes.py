"""Problem 6 on the project's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators.spikes import DETAIL, MAD, RETURN, Rules, implausible
from quoin.session import table

RULES = Rules(spiky=("close", "high", "low", "volume"), sticky=("close", "volume"), active="volume", positive=("high", "low", "close"), nonnegative=("volume",), within=(("close", "low", "high"),))


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each implausible row with its reasons."""
    rows = table(spark, sf_dir, "bronze_market")
    found = implausible(rows, ["security_id", "provider_name"], "trade_date", "close", ["data_version", "ingested_at", "record_id"], RULES, ["record_id"])
    return found.select("record_id", "security_id", "provider_name", F.concat_ws(",", "reasons").alias("reasons"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_flags(spark, sf_dir).select("record_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_flags": p6_flags}

# The definition, told another way: a value is out of proportion if it departs, on the same side, from the median of the five days before and
# from that of the five days after by more than the scales, and those two are back at each other.
_SERIES = f"""b AS (SELECT record_id, security_id AS k, provider_name AS p, trade_date AS day, close, high, low, volume::DOUBLE AS volume, data_version, ingested_at FROM bronze_market WHERE close IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY k, p, day ORDER BY data_version DESC, ingested_at DESC, record_id DESC) AS from_last,
  row_number() OVER (PARTITION BY k, p, day ORDER BY data_version, ingested_at, record_id) AS from_first FROM b),
v AS (SELECT record_id, k, p, day, unnest(['close', 'high', 'low', 'volume']) AS m, unnest([close, high, low, volume]) AS v, from_last FROM o),
x AS (SELECT k, p, m, day, ln(v) AS x, ln(v) - lag(ln(v)) OVER (PARTITION BY k, p, m ORDER BY day) AS d FROM v WHERE from_last = 1 AND v > 0),
s AS (SELECT k, p, m, list(x ORDER BY day) AS xs, list(day ORDER BY day) AS ds, {DETAIL} * {MAD} * median(abs(d)) FILTER (WHERE abs(d) > 1e-12) AS t FROM x GROUP BY k, p, m),
n AS (SELECT v.record_id, v.m, ln(v.v) AS x, xs, t, len(list_filter(ds, lambda e: e < v.day)) AS before, len(list_filter(ds, lambda e: e <= v.day)) AS upto FROM v JOIN s USING (k, p, m) WHERE v.v > 0),
w AS (SELECT record_id, m, t, x - list_aggregate(xs[greatest(before - 4, 1):before], 'median') AS a, x - list_aggregate(xs[upto + 1:upto + 5], 'median') AS c FROM n),
spike AS (SELECT record_id, 'spike:' || m AS why FROM w WHERE least(abs(a), abs(c)) > t AND sign(a) = sign(c) AND abs(a - c) <= {RETURN} * least(abs(a), abs(c))),
bad AS (SELECT record_id, 'impossible' AS why FROM b WHERE high <= 0 OR low <= 0 OR close <= 0 OR volume < 0 OR close < low OR close > high)"""


def _stuck(m: str, pick: str) -> str:
    name = f"{m}_{pick}"
    return f"""{name}0 AS (SELECT k, p, day, {m} AS v, volume, row_number() OVER w AS i, {m} IS DISTINCT FROM lag({m}) OVER w OR NOT coalesce(volume > 0 AND lag(volume) OVER w > 0, false) AS fresh
  FROM o WHERE {pick} = 1 WINDOW w AS (PARTITION BY k, p ORDER BY day)),
{name}1 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY k, p ORDER BY day) AS run FROM {name}0),
{name} AS (SELECT k, p, day, v FROM {name}1 QUALIFY count(*) OVER (PARTITION BY k, p, run) >= {RULES.run} AND NOT fresh)"""


_PICKS = [(m, pick) for m in RULES.sticky for pick in ("from_last", "from_first")]
_ALL = (
    f"WITH {_SERIES}, " + ", ".join(_stuck(*x) for x in _PICKS) + ", stuck AS ("
    + " UNION ".join(f"SELECT record_id, 'stuck:{m}' AS why FROM b JOIN {m}_{pick} z ON z.k = b.k AND z.p = b.p AND z.day = b.day AND z.v = b.{m}" for m, pick in _PICKS)
    + "), f AS (SELECT * FROM bad UNION SELECT * FROM spike UNION SELECT * FROM stuck)"
)
_ORDER = ["impossible", *(f"spike:{m}" for m in RULES.spiky), *(f"stuck:{m}" for m in RULES.sticky)]
SQL = {
    "p6_found": f"{_ALL} SELECT DISTINCT record_id FROM f",
    "p6_flags": f"""{_ALL}, g AS (SELECT record_id, string_agg(why, ',' ORDER BY list_position({_ORDER}, why)) AS reasons FROM f GROUP BY 1)
SELECT record_id, k AS security_id, p AS provider_name, reasons FROM g JOIN b USING (record_id)""",
}
