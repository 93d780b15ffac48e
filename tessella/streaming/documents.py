"""Document state, progress and idle hints as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import scratch_dir


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """The files of a folder as a stream; ``per_batch`` of them in a micro-batch, all there are by default."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def run_to_table(df: DataFrame, label: str, mode: str = "append", by_batch=None) -> str:
    """Runs a stream over all available input and returns the folder it wrote."""
    base = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    if by_batch is None:
        query = writer.format("parquet").start(out)
    else:
        query = writer.foreachBatch(lambda batch, n: by_batch(batch, n, out)).start()
    query.awaitTermination()
    return out


def palette_updates(ops: DataFrame) -> DataFrame:
    """Latest colour per document and region, emitted when a batch touches it (update mode)."""
    return ops.groupBy("doc_id", "region_id").agg(
        F.max_by(F.struct("r", "g", "b"), "seq").alias("c"), F.max("seq").alias("seq")
    )


def write_batch(batch: DataFrame, n: int, out: str) -> None:
    """One folder per batch: a repeated batch overwrites itself."""
    batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")


def stroke_sessions(events: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Spans of activity per document that ended with more than ``gap`` without an event."""
    return (
        events.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", late)
        .groupBy("doc_id", F.session_window("at", gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("doc_id", "session_window.start", "session_window.end", "events")
    )


def coverage_deltas(changes: DataFrame) -> DataFrame:
    """Covered pixels per region from signed changes of dirty tiles; undo sends negative ones.

    ``changes`` holds ``doc_id, region_id, tile, delta``; use update mode with a 500 ms trigger.
    """
    return changes.groupBy("doc_id", "region_id").agg(F.sum("delta").alias("covered"))
