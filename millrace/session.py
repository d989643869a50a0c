"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WORK: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application (the driver serves the archive)."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="millrace-")
    _OWN.append(folder)
    archive = os.path.join(folder, "millrace_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._millrace_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting is
    unset and the master is this machine (tests) an own temporary folder is made and
    removed at exit; on a cluster without the setting there is no such folder, and
    this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found:
        if not jdir.isDefined():  # versions that do not read the setting themselves
            spark.sparkContext.setCheckpointDir(found)
        return found
    if jdir.isDefined():
        return jdir.get()
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder all executors share (master {master})")
    path = tempfile.mkdtemp(prefix="millrace-")
    _OWN.append(path)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (lineage ends there).

    All tables of an application lie in one folder, which goes when the session ends: at
    exit for a driver that ends in order, or by ``clean`` at any time.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    """The application's folder for intermediate tables."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/millrace-{sc.applicationId}"
    if not any(p == path for _, p in _WORK):
        _WORK.append((spark, path))
    return path


def clean(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; what was read from them must have been written elsewhere."""
    for owner, path in [x for x in _WORK if x[0] is spark]:
        jpath = owner._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(owner._jsc.hadoopConfiguration()).delete(jpath, True)
        _WORK.remove((owner, path))


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are dear to work on, over all cores.

    A file of one row group is read by one task, however many cores there are. Only a table
    with fewer splits than cores is dealt out anew; it decides the layout, nothing else.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@atexit.register
def _remove_own() -> None:
    for spark, _ in list(_WORK):
        try:
            if spark.sparkContext._jsc is not None:
                clean(spark)
        except Exception:  # the session has ended; its folder is removed by whoever runs the cluster
            pass
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)
