"""Scans: JSON lines in three tolerances, manifests, nested specifications, numbered files, CSV."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.corpus import CorpusError, missing_fields

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "source", "license", "lang", "domain", "url")] + [T.StructField("year", T.IntegerType())])


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def json_strict(spark: SparkSession, path: str, schema=DOCUMENT, required: list[str] | None = None) -> DataFrame:
    """Every line must parse and hold the required fields; an empty file is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise CorpusError(f"no documents in {path}")
    bad = df.where(F.size(missing_fields(df, required)) > 0).limit(3).collect()
    if bad:
        raise CorpusError(f"{path}: required fields are missing in {[r.asDict() for r in bad]}")
    return df


def json_lenient(spark: SparkSession, path: str, schema) -> DataFrame:
    """Lines that do not parse (a truncated last line, say) are skipped; a missing file has no rows."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_plain(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("mode", "FAILFAST").json(path)


MANIFEST = "culture string, language string, arms map<string, struct<file: string, lang: string, register: string, domains: array<string>, value_laden: boolean, min_year: int, max_year: int>>, twin_matching struct<token_ratio_tolerance: double, require_same_language: boolean, require_same_register: boolean>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per declared arm of a manifest file, defaults filled in."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    arms = m.select("culture", "language", "twin_matching", F.explode("arms").alias("arm", "a"))
    twin = F.col("twin_matching")
    return arms.select(
        "culture", "language", "arm", "a.*", F.coalesce(twin["token_ratio_tolerance"], F.lit(0.2)).alias("token_ratio_tolerance"),
        F.coalesce(twin["require_same_language"], F.lit(True)).alias("require_same_language"), F.coalesce(twin["require_same_register"], F.lit(True)).alias("require_same_register"),
    )


SCENARIO = "struct<scenario_id: string, scenario_description: string, volume: int>"
TOPIC = f"struct<topic_id: string, topic_description: string, scenarios: array<{SCENARIO}>>"


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario rows of a specification, topics at the top (``topics``) or in ``part_*`` sections."""
    raw = spark.read.text(path, wholetext=True)
    parts = raw.select(F.explode(F.from_json("value", f"map<string, array<{TOPIC}>>")).alias("key", "topics"))
    part = F.when(F.col("key").startswith("part_"), F.concat(F.lit("part_"), F.get(F.split("key", "_"), F.lit(1))))
    topics = parts.where((F.col("key") == "topics") | F.col("key").startswith("part_")).select(part.alias("part"), F.explode("topics").alias("t"))
    rows = topics.select("part", "t.topic_id", "t.topic_description", F.explode("t.scenarios").alias("s"))
    return rows.select("part", "topic_id", "topic_description", "s.*")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(category, volume, source, source_volume) of a specification's nested categories."""
    shape = "struct<categories: map<string, struct<volume: int, description: string, sources: array<struct<name: string, volume: int>>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("v"))
    c = raw.select(F.explode("v.categories").alias("category", "c"))
    return c.select("category", F.col("c.volume").alias("volume"), F.explode("c.sources").alias("s")).select("category", "volume", F.col("s.name").alias("source"), F.col("s.volume").alias("source_volume"))


def one(df: DataFrame, column: str, value: str) -> DataFrame:
    """Point lookup; nothing found is an error."""
    row = df.where(F.col(column) == value).limit(1)
    if row.isEmpty():
        raise KeyError(f"{column} = {value}")
    return row


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y) of a JSON map name -> [x, y]."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("name", "xy"))
    return raw.select("name", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))


def numbered(spark: SparkSession, folder: str, prefix: str, schema) -> DataFrame:
    """Rows of ``prefix<k>.json`` files with their number ``k``."""
    df = spark.read.schema(schema).json(os.path.join(folder, f"{prefix}*.json"))
    return df.withColumn("k", F.regexp_extract(F.col("_metadata.file_name"), re.escape(prefix) + r"(\d+)\.json$", 1).cast("int"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def configs(frames: dict[str, DataFrame], order: str) -> DataFrame:
    """Union of several configurations with a running index over (configuration, row), from 1."""
    from functools import reduce

    from pyspark.sql import Window as W

    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("config", F.lit(k)) for k, df in sorted(frames.items())])
    own = F.row_number().over(W.partitionBy("config").orderBy(order))
    sizes = together.groupBy("config").agg(F.count("*").alias("m"))  # one row a configuration
    before = F.coalesce(F.sum("m").over(W.orderBy("config").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return together.withColumn("own", own).join(sizes.select("config", before.alias("before")), "config").withColumn("idx", F.col("before") + F.col("own")).drop("own", "before")
