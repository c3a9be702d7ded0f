"""Progress of streams as a table: every micro-batch, with totals, rate and time left.

A listener stores each batch as it is reported, so nothing depends on how many
batches the query remembers or on whether it still runs.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, name string, batch long, rows long, seconds double, at timestamp"


class ProgressTable(StreamingQueryListener):
    """Stores (run, name, batch, rows, seconds, at) of all batches of the session's queries below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802  (Spark's names)
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {
            "run": str(p.runId), "name": p.name, "batch": int(p.batchId), "rows": int(p.numInputRows),
            "seconds": int(p.batchDuration) / 1000.0, "at": str(p.timestamp),
        }
        self._store(f"{row['run']}-{row['batch']:012d}", row)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def _store(self, name: str, row: dict) -> None:
        """One small file per batch; a batch reported twice overwrites itself."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.json")
        stream = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            stream.write(bytearray((json.dumps(row) + "\n").encode()))
        finally:
            stream.close()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Return when the end of a stopped query has been reported, and so every batch of it."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no end reported for query {query.runId}")
            time.sleep(0.05)


def read_progress(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """(run, name, batch, rows, seconds, total, elapsed, rate, eta_seconds) of each batch.

    ``total`` and ``elapsed`` run through a query's batches, ``rate`` is their
    ratio, and ``eta_seconds`` what is left of ``expected_rows`` at that rate
    (null without an expectation or before the first row).
    """
    stored = spark.read.schema(SCHEMA).json(path).dropDuplicates(["run", "batch"])
    # one row per micro-batch of a query
    so_far = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    summed = stored.withColumn("total", F.sum("rows").over(so_far)).withColumn("elapsed", F.sum("seconds").over(so_far))
    rate = F.when(F.col("elapsed") > 0, F.col("total") / F.col("elapsed"))
    left = F.greatest(F.lit(expected_rows).cast("long") - F.col("total"), F.lit(0))
    return summed.withColumn("rate", rate).withColumn("eta_seconds", F.when(F.col("rate") > 0, left / F.col("rate")))
