"""Cutting lineage through tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query with this setting when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode where none is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext.getCheckpointDir()
    if here:
        return here.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinmark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def own_shuffles(spark: SparkSession):
    """What runs inside takes its shuffle files along when it ends: a table that was written needs them no more."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    """The folders of all jobs go when the driver ends; their results are read lazily, so not before."""
    for root, spark in _open.items():
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the JVM may be gone
            return


class Scratch:
    """Tables of one job in the shared folder. An executor's loss costs at most the stage at work: what was written stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinmark-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        _open[self.root] = spark

    def write(self, df: DataFrame) -> DataFrame:
        """Write df and read it back with its columns and no lineage."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        with own_shuffles(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            path = self.paths.pop(id(t), None) if t is not None else None
            if path:
                _delete(self.spark, path)
