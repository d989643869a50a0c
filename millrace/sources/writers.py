"""Sinks: JSON lines, partitioned and routed output, replace-by-rename, round checkpoints, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.readers import exists


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "json") -> None:
    """One folder per key; a rerun replaces only the keys it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def routed(df: DataFrame, path: str, column: str) -> None:
    """Rows into one folder per value of ``column`` (train and val, say)."""
    partitioned(df, path, [column])


def replace(df: DataFrame, path: str, fmt: str = "parquet", backup: bool = False) -> str | None:
    """Write beside the target, then rename over it; the old data stay as a backup on request."""
    spark = df.sparkSession
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    fs, target = _fs(spark, path)
    kept = None
    if fs.exists(target):
        kept = f"{path}.bak-{uuid.uuid4().hex}"
        fs.rename(target, _fs(spark, kept)[1])
    fs.rename(_fs(spark, staged)[1], target)
    if kept and not backup:
        fs.delete(_fs(spark, kept)[1], True)
        kept = None
    return kept


def round_path(folder: str, k: int) -> str:
    return f"{folder.rstrip('/')}/round={k}"


def write_round(df: DataFrame, folder: str, k: int) -> None:
    df.write.mode("overwrite").parquet(round_path(folder, k))


def finished_rounds(spark: SparkSession, folder: str) -> int:
    """Rounds 0 .. k - 1 that are there without a gap."""
    k = 0
    while exists(spark, f"{round_path(folder, k)}/_SUCCESS"):
        k += 1
    return k


def wide_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def manifest_json(docs: DataFrame, culture: str) -> DataFrame:
    """One JSON row describing the arms found in ``docs`` (arm, lang, domain)."""
    arms = docs.groupBy("arm").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_set("domain")).alias("domains"), F.count("*").alias("docs"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("arm", F.struct("lang", "domains", "docs").alias("v")))))
    return arms.agg(F.to_json(F.struct(F.lit(culture).alias("culture"), entries.alias("arms"))).alias("value"))


def markdown(df: DataFrame, columns: list[str], width: int = 80, rows: int = 200) -> str:
    """A short report table: at most ``rows`` rows, and a last line if there are more; long cells cut with an ellipsis."""
    cell = lambda c: F.coalesce(F.when(F.length(F.col(c).cast("string")) > width, F.concat(F.substring(F.col(c).cast("string"), 1, width - 1), F.lit("…"))).otherwise(F.col(c).cast("string")), F.lit(""))
    body = [" | ".join(v.replace("\n", " ").replace("|", "\\|") for v in r) for r in df.select(*[cell(c).alias(c) for c in columns]).limit(rows + 1).collect()]
    more = [f"(more than {rows} rows)"] if len(body) > rows else []
    return "\n".join([" | ".join(columns), " | ".join(["---"] * len(columns)), *body[:rows], *more])
