"""Resumable incremental processing with Structured Streaming.

An append-only folder is the log; a checkpoint holds the progress; every batch is
applied with an idempotent sink, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import shared_dir


def work_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived, batch by batch, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def keep_batch(out: str, run: str = "a") -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own: a batch that is tried again replaces itself, and nothing else does."""
    return lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/run={run}/batch={k}")


def kept(spark: SparkSession, out: str, schema, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What the batches of a folder amount to: all rows, the last batch (``complete``), or the last row of each key (``update``)."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(out)):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, run string, batch long").parquet(out)
    if mode == "complete":
        return rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0)).drop("run", "batch")
    if mode == "update":
        rest = [f.name for f in schema if f.name not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")
    return rows.drop("run", "batch")


def consume(spark: SparkSession, log: str, schema, out: str, keys: list[str], step: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int | None = None, glob: str | None = None) -> None:
    """Rows of the log not yet in ``out`` (by key) go through ``step`` into it, a folder a batch; a batch tried again (of the same progress) does not see what it wrote itself."""
    run = "r" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def sink(batch: DataFrame, k: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if fs.exists(path):
            done = spark.read.parquet(out).where((F.col("run") != run) | (F.col("batch") != k)).select(*keys)
            fresh = fresh.join(done, keys, "left_anti")
        keep_batch(out, run)(step(fresh), k)

    run_available(reader.parquet(log), sink, checkpoint)


def windowed_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def fill_to_target(attempts: DataFrame, key: str, ok: str, target: int, give_up: int) -> DataFrame:
    """Stateful fill per key: counts successes up to a target, gives up after so many failures in a row.

    Returns (key, filled, failures, state) each time a key's state changes. Rows of a key are
    taken in the order of ``seq`` within a batch, batches as they come.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        filled, failures = state.get if state.exists else (0, 0)
        # a key's rows come in several Arrow batches: their order is that of all of them
        parts = [b[["seq", ok]] for b in batches]
        for good in pd.concat(parts).sort_values("seq", kind="stable")[ok] if filled < target and failures < give_up else ():
            if filled >= target or failures >= give_up:
                break
            filled, failures = (filled + 1, 0) if good else (filled, failures + 1)
        state.update((filled, failures))
        word = "filled" if filled >= target else "given up" if failures >= give_up else "open"
        yield pd.DataFrame({key: [k[0]], "filled": [filled], "failures": [failures], "state": [word]})

    kind = dict(attempts.dtypes)[key]
    return attempts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, filled long, failures long, state string", "filled long, failures long", "update", GroupStateTimeout.NoTimeout)


def retry_until_done(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], keys: list[str], status: str, passes: int) -> DataFrame:
    """Passes over the rows that are not ``ok`` until all are, at most ``passes``; the last status of a key counts."""
    from millrace.operators.relational import override_union
    from millrace.session import checkpoint

    state = rows
    for k in range(passes):
        open_ = state.where(F.col(status) != "ok")
        if open_.isEmpty():
            break
        state = checkpoint(override_union([state, attempt(open_, k)], keys, [F.lit(0)]))
    return state
