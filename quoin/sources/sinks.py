"""Sinks, idempotent ingest, lineage hashes and small reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.session import cut


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small document, through the cluster's file system."""
    text = json.dumps(value, sort_keys=True, indent=2, default=str)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """One small document, through the cluster's file system."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_split(df: DataFrame, problem, good: str, bad: str) -> None:
    """Rows without a problem to ``good``, the others with it to ``bad``."""
    flagged = cut(df.withColumn("problem", problem))  # computed once
    write_table(flagged.where("problem IS NULL").drop("problem"), good)
    write_table(flagged.where("problem IS NOT NULL"), bad)


def ingest_once(spark: SparkSession, root: str, dataset: str, key: str, fetch: Callable[[], DataFrame]) -> bool:
    """Write what ``fetch`` gives under ``key``, unless its manifest is there already; the manifest is written last, so a run that
    broke off is done again. True if it ran."""
    manifest = f"{root}/manifests/{dataset}/{key}.json"
    if exists(spark, manifest):
        return False
    path = f"{root}/bronze/{dataset}/{key}"
    write_table(fetch(), path)
    stored = spark.read.parquet(path)
    write_json(spark, manifest, {"dataset": dataset, "key": key, "path": path, **lineage(stored)})
    return True


def keep_raw(spark: SparkSession, root: str, dataset: str, key: str, payload: dict, **about) -> str:
    """Writes what a provider sent, unchanged, beside a manifest that says what was asked and what its hash is; a payload that is there already stays. Its path."""
    path = f"{root}/raw/{dataset}/{key}.json"
    if not exists(spark, path):
        write_json(spark, path, payload)
        text = json.dumps(payload, sort_keys=True, default=str)
        write_json(spark, f"{root}/raw/{dataset}/manifests/{key}.json", {"dataset": dataset, "key": key, "sha256": hashlib.sha256(text.encode()).hexdigest(), "path": path, **about})
    return path


def cached(spark: SparkSession, root: str, key: str, call: Callable[[], dict]) -> dict:
    """What ``call`` gives, from the folder where it was kept if it was called before under the same key."""
    path = f"{root}/responses/{hashlib.sha256(key.encode()).hexdigest()}.json"
    if not exists(spark, path):
        write_json(spark, path, call())
    return read_json(spark, path)


def write_schemas(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """The schema of each table as JSON, one file a table."""
    for name, df in tables.items():
        write_json(spark, f"{root}/schemas/{name}.json", {"name": name, "fields": json.loads(df.schema.json())["fields"], "hash": schema_hash(df)})


def content_hash(df: DataFrame) -> str:
    """Hash of the rows, whatever their order and partitioning: distributed sums of row hashes. Columns go by name."""
    names = sorted(df.columns)
    h = F.xxhash64(*(F.to_json(c) if df.schema[c].dataType.typeName() in ("map", "struct") else F.col(c) for c in names), *(F.col(c).isNull() for c in names))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([names, one["n"], one["x"], str(one["s"])]).encode()).hexdigest()


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(json.dumps(sorted((f.name, f.dataType.simpleString()) for f in df.schema)).encode()).hexdigest()


def lineage(df: DataFrame) -> dict:
    return {"rows": df.count(), "content_hash": content_hash(df), "schema_hash": schema_hash(df), "columns": df.columns}


def profile(df: DataFrame) -> DataFrame:
    """(column_name, rows, nulls) of every column, from one scan."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("rows_"), *((n - F.count(c)).alias(f"n{i}") for i, c in enumerate(df.columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows_").alias("rows"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)))
    return one.select(F.explode(cells).alias("c")).select("c.*")


def dataset_id(layer: str, version: str, df: DataFrame) -> str:
    return f"{layer}__{version}__{content_hash(df)[:12]}__{schema_hash(df)[:12]}"


#: Rows of a result table that a report holds; a longer table says how many it has.
REPORT_ROWS = 200


def _shown(body: DataFrame) -> tuple[list, str]:
    rows = body.limit(REPORT_ROWS + 1).collect()
    return rows[:REPORT_ROWS], f"{body.count()} rows; the first {REPORT_ROWS} are shown" if len(rows) > REPORT_ROWS else ""


def markdown(sections: dict[str, str | DataFrame]) -> str:
    """A report of texts and result tables."""
    out = []
    for title, body in sections.items():
        out.append(f"## {title}\n")
        if isinstance(body, str):
            out.append(body)
        else:
            rows, note = _shown(body)
            out += ["| " + " | ".join(body.columns) + " |", "|" + "---|" * len(body.columns)] + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
            if note:
                out += ["", note]
        out.append("")
    return "\n".join(out)


def html_report(sections: dict[str, str | DataFrame], figures: dict[str, str]) -> str:
    """The same sections as a page, with the figures after them."""
    out = ["<!doctype html><meta charset='utf-8'><title>Report</title>"]
    for title, body in sections.items():
        out.append(f"<h2>{escape(title)}</h2>")
        if isinstance(body, str):
            out.append(f"<pre>{escape(body)}</pre>")
        else:
            rows, note = _shown(body)
            cells = lambda kind, values: "<tr>" + "".join(f"<{kind}>{escape('' if v is None else str(v))}</{kind}>" for v in values) + "</tr>"
            out.append("<table>" + cells("th", body.columns) + "".join(cells("td", r) for r in rows) + f"</table>{escape(note)}")
    return "\n".join([*out, *figures.values()])
