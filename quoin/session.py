"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Plan-wide defaults; a cluster's own settings win over all of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("quoin")
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Tasks of a keyed Python stage. Explicit, since adaptive coalescing counts bytes and such stages cost CPU."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder that spark.checkpoint.dir names, so that later reads survive the loss of
    executors. Where that setting is unset, a single-machine session, as in tests, uses a folder of its own; a cluster raises."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quoin-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least ``width`` tasks: a scan of few, small files would leave a costly row-wise stage to few of them. Where
    the scan has as many splits already, nothing moves."""
    wanted = width(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
