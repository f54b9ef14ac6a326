"""Stateless decode and projection streams (ST1-ST3).

The reference decodes records one at a time while streaming a large file.
Here the same decode is a Structured Streaming query: a file source, the
same column expressions as the batch path (enum maps, stream-static
broadcast lookups against bounded codebooks), and a Parquet sink with a
checkpoint under the cluster's shared checkpoint folder. No state is kept,
so no watermark is needed; ``observe`` publishes a running row count with
every micro-batch (the reference's progress counter).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstat.session import shared_path


# the recent updates' observed metrics of the last run, and where it wrote all of them, by stream name (ST3)
LAST_PROGRESS: dict[str, list] = {}
PROGRESS_TABLES: dict[str, str] = {}
PROGRESS = "batch long, rows long, at string"


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, checkpoint) folders for one run, inside the shared checkpoint dir."""
    base = shared_path(spark, f"stream-{name}")
    return base + "/sink", base + "/checkpoint"


def with_progress(df: DataFrame, name: str = "progress") -> DataFrame:
    """Per-batch row count as an observed metric (ST3)."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def run_available(df: DataFrame, name: str, fmt: str = "parquet", poll: float = 1.0) -> str:
    """Run a streaming DataFrame over everything available, then stop (ST1).
    Returns the sink path, readable as a batch table.

    Every micro-batch's observed count is appended to a table beside the sink (ST3,
    ``progress``), as it becomes known: the query itself remembers only its recent updates."""
    spark = df.sparkSession
    sink, chk = stream_paths(spark, name)
    log = f"{sink.rsplit('/', 1)[0]}/progress"
    q = (df.writeStream.format(fmt).option("path", sink).option("checkpointLocation", chk)
         .trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:6]}").start())
    written = -1
    while True:
        ended = q.awaitTermination(poll)  # availableNow ends by itself; a failure is raised here
        written = _append_progress(spark, q.recentProgress or [], written, log)
        if ended:
            break
    LAST_PROGRESS[name] = [p.get("observedMetrics", {}) for p in (q.recentProgress or [])]
    PROGRESS_TABLES[name] = log
    return sink


def _append_progress(spark: SparkSession, updates: list, written: int, log: str) -> int:
    """Appends the batches after ``written`` to the progress table; returns the last one."""
    new: dict[int, tuple] = {}
    for p in updates:
        counts = [m["rows"] for m in (p["observedMetrics"] or {}).values()]
        if p["batchId"] > written and counts and counts[0] is not None:
            new[p["batchId"]] = (p["batchId"], int(counts[0]), str(p["timestamp"]))
    if new and min(new) > written + 1:
        raise RuntimeError(f"progress of batches {written + 1} to {min(new) - 1} is lost: poll more often")
    if new:
        spark.createDataFrame([new[k] for k in sorted(new)], PROGRESS).coalesce(1).write.mode("append").parquet(log)
    return max([written, *new])


def progress(spark: SparkSession, name: str) -> DataFrame:
    """Batches of a stream's last run: batch, rows, at, and the running ``total``."""
    rows = spark.read.schema(PROGRESS).parquet(PROGRESS_TABLES[name])
    # one row per micro-batch
    return rows.withColumn("total", F.sum("rows").over(Window.orderBy("batch")))


def milestones(rows: DataFrame, every: int = 10_000) -> DataFrame:
    """The batches at which the running total passes a multiple of ``every``."""
    before = F.col("total") - F.col("rows")
    return rows.where(F.floor(F.col("total") / every) > F.floor(before / every))


def decode_stream(source: DataFrame, decode) -> DataFrame:
    """Apply a batch decode function to a streaming DataFrame - the decode
    is pure column work, so the same function serves batch and stream."""
    return with_progress(decode(source))
