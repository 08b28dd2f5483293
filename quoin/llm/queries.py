"""Queries of problems 8, 9 and 10."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.encoding import CANDIDATE, garbled
from quoin.llm.mixing import Mix, mix_sources
from quoin.llm.packing import pack_containers
from quoin.llm.tokens import token_counts
from quoin.session import cut, table


#: Segments of a container: one for this many tokens of capacity, so that a container of short texts alone closes before it is full.
TOKENS_A_SEGMENT = 64
#: Loss-bearing tokens of a container: all but one in this many of its capacity, so that texts without prompts do not share one to its brim.
TOKENS_A_PROMPT = 32


def container_limits(capacity: int) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens of a container at most."""
    return capacity, max(1, capacity // TOKENS_A_SEGMENT), max(1, capacity - capacity // TOKENS_A_PROMPT)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts in containers of every kind. The first of several lines of a text is its prompt; the rest bears loss. A text
    with more loss than a container may bear has one of its own."""
    counts = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    items = cut(counts.select("doc_id", "tokens", (F.col("tokens") - F.col("prompt_tokens")).alias("loss")))
    kinds = table(spark, sf_dir, "pack_capacity").collect()  # a fixed table of a few rows
    limits = {r["container_kind"]: container_limits(r["capacity_tokens"]) for r in kinds}
    return pack_containers(items, "doc_id", "tokens", "loss", limits, alone=True)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each kind and how full they are."""
    capacity = table(spark, sf_dir, "pack_capacity")
    kinds = p8_containers(spark, sf_dir).groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return kinds.join(capacity, "container_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: documents that come in containers, and how many containers and documents break a rule; beyond its loss limit only a container of
    one piece may be."""
    rows = p8_containers(spark, sf_dir)
    kinds = {r["container_kind"]: container_limits(r["capacity_tokens"]) for r in table(spark, sf_dir, "pack_capacity").collect()}
    limit = lambda i: F.coalesce(*(F.when(F.col("container_kind") == k, F.lit(v[i])) for k, v in kinds.items()))
    n = F.count(F.lit(1))
    boxes = rows.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), n.alias("s"), F.sum("loss_tokens").alias("l"))
    broken = boxes.groupBy("container_kind").agg(
        F.count_if(F.col("t") > limit(0)).alias("over_tokens"), F.count_if(F.col("s") > limit(1)).alias("over_segments"), F.count_if((F.col("l") > limit(2)) & (F.col("s") > 1)).alias("over_loss")
    )
    items = rows.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("t"), n.alias("pieces"), F.max(F.col("from_token") + F.col("tokens")).alias("end"))
    whole = items.groupBy("container_kind").agg(n.alias("documents"), F.count_if((F.col("t") != F.col("end")) | (F.col("pieces") != F.ceil(F.col("t") / limit(0)))).alias("ill_split"))
    return broken.join(whole, "container_kind")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mixes: dict[str, list] = {}
    for r in table(spark, sf_dir, "mix_target").collect():  # a fixed table of a few rows
        mixes.setdefault(r["mix_name"], []).append(r)
    own = [Mix(name, {r["source"]: r["target_share"] for r in rows}, rows[0]["max_repeats"], rows[0]["size_ratio"]) for name, rows in sorted(mixes.items())]
    return mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source", own)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix, with their copies."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each affected document with its restored text."""
    return garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "restored", F.concat_ws(",", "steps").alias("steps"), "lossy", "bounded")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: wished sources, and how many rows break a rule: more copies than allowed, an unwished source, a reachable source off its target by more
    than one percent of the mix and one document of its own."""
    uses, shares = _mix(spark, sf_dir)
    target = table(spark, sf_dir, "mix_target").select("mix_name", "source", "max_repeats")
    caps = target.groupBy("mix_name").agg(F.max("max_repeats").alias("cap"))
    used = uses.join(caps, "mix_name").join(target.withColumn("wished", F.lit(True)).drop("max_repeats"), ["mix_name", "source"], "left")
    one = used.groupBy("mix_name").agg(F.count_if(F.col("copies") > F.col("cap")).alias("over_repeated"), F.count_if(F.col("wished").isNull()).alias("unwished"))
    total = F.sum("target_tokens")
    longest = uses.groupBy("mix_name", "source").agg(F.max("tokens").alias("longest"))
    shares = shares.join(longest, ["mix_name", "source"], "left")
    off = shares.groupBy("mix_name").agg(F.count(F.lit(1)).alias("sources"), (F.max(F.when(~F.col("limited"), F.abs(F.col("tokens") - F.col("target_tokens")) - F.coalesce("longest", F.lit(0)))) > 0.01 * total).alias("off_target"), F.bool_and("settled").alias("settled"))
    return off.join(one, "mix_name")


def p10_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold anything to search for, and those found without."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    searched = docs.select("doc_id", F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False)).alias("candidate"))
    found = garbled(docs, "doc_id", "text").select("doc_id").distinct().withColumn("found", F.lit(True))
    return searched.join(found, "doc_id", "left").agg(F.count_if("candidate").alias("candidates"), F.count_if(~F.col("candidate") & F.col("found").isNotNull()).alias("found_elsewhere"))


QUERIES = {f.__name__: f for f in (p8_containers, p8_fill, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_restored, p10_scope)}
#: What tokens, posteriors and repairs are no engine's SQL can say; what must hold of them it can.
SQL = {
    "p8_checks": """SELECT container_kind, count(DISTINCT doc_id) AS documents, 0::BIGINT AS over_tokens, 0::BIGINT AS over_segments, 0::BIGINT AS over_loss, 0::BIGINT AS ill_split
FROM pack_capacity, documents WHERE length(text) > 0 GROUP BY 1""",
    "p9_checks": """SELECT mix_name, count(*) AS sources, false AS off_target, true AS settled, 0::BIGINT AS over_repeated, 0::BIGINT AS unwished FROM mix_target GROUP BY 1""",
    "p10_scope": """SELECT count(*) FILTER (WHERE regexp_matches(text, '[^\\x00-\\x7F]|&#?\\w{2,8};')) AS candidates, 0::BIGINT AS found_elsewhere FROM documents""",
}
