"""Tables in the folder that all executors share; they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a single machine
    (where it is unset, as in tests) a new temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """A job's tables in the shared folder. One is dropped with :meth:`drop` once a later stored
    table has replaced it; those that a result reads stay until the caller drops them (:meth:`drop_since`)
    or the driver's process ends."""

    FREE_EVERY = 5.0
    _freed = 0.0
    #: Paths of the tables stored in this process and not dropped yet.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.unregister(_drop_all)
        atexit.register(_drop_all, spark.sparkContext._jvm)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_path = path
        Stored.made.append(path)
        self.free()
        return out

    def free(self) -> None:
        """Lets Spark's cleaner find the shuffle files and broadcasts of finished jobs now rather than
        at some later collection; a chain of large shuffles would fill the disks meanwhile."""
        if time.monotonic() - Stored._freed < self.FREE_EVERY:
            return
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        Stored._freed = time.monotonic()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the given tables; frames that no put() returned are passed over."""
        self._delete(filter(None, (vars(t).get("_stored_path") for t in tables)))

    def drop_since(self, mark: int, *but: DataFrame) -> None:
        """Drops what was stored since `Stored.made` had `mark` tables, of all jobs, but the given ones."""
        keep = {vars(b).get("_stored_path") for b in but}
        self._delete([p for p in Stored.made[mark:] if p not in keep])

    def _delete(self, paths) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            if p in Stored.made:
                Stored.made.remove(p)


def _drop_all(jvm) -> None:
    """Deletes what is stored still when the driver's process ends."""
    with contextlib.suppress(Exception):  # the JVM may be gone before
        conf = jvm.org.apache.hadoop.conf.Configuration()
        for p in Stored.made:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: sort-merge at every size, which Spark
    spills and splits where it is skewed, rather than a broadcast while it is small."""
    return df.hint("merge")
