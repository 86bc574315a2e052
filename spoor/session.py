"""What every part of the package needs from a Spark session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_spoor_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spoor-"), f"spoor-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._spoor_shipped = True


def small_batches(spark: SparkSession, megabytes: int = 2) -> None:
    """Bound the bytes of the batches that go to Python workers, unless the session has a lower bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not now or not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= megabytes << 20:
        spark.conf.set(key, f"{megabytes << 20}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A folder of this machine is made only where neither is set and all runs on this machine, as in tests.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spoor-shared-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str, by: str | None = None, path: str | None = None, split: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts its lineage. by: a column to partition by, split: a value of it
    in as many tasks and files as its rows need; path: where, if not in a folder of its own."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = (df.hint("rebalance", F.col(by)) if split else df.repartition(by)).write.partitionBy(by) if by else df.write
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and that no later plan reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
