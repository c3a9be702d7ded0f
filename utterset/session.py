"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app_name: str = "utterset", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose data with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="utterset-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator below the shared folder, each dropped when its last reader is done.

    ``keep`` writes a table and reads it back, as ``cut_lineage`` does; ``drop``
    deletes it.  Drop a table only when everything made from it has been written:
    a lost executor's work is then redone from the later tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = scratch_path(spark, name)
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{len(self._paths):02d}-{name}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned; others are left alone."""
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_others(self, *kept: DataFrame) -> None:
        """Delete every table but these."""
        self.drop(*[t for t, _ in list(self._paths.values()) if all(t is not k for k in kept)])

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now, not at the driver's next garbage collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame) -> DataFrame:
    """Cache a derived lookup side so that the planner knows its true size.

    After this the planner broadcasts the side only when its real size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
    """
    cached = df.persist()
    cached.count()
    return cached


def slots(spark: SparkSession, rows: int, rows_per_task: int = 1_000_000) -> int:
    """Number of input partitions for ``rows`` generated rows."""
    return int(max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task)))
