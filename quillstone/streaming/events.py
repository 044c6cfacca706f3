"""Event streams: windowed counts with watermarks (extensions), and the outbox pump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quillstone.sources.log import Log

def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16, at: str | None = None) -> DataFrame:
    """Files as a stream; ``at`` names the event time, which watermarks take as a timestamp with a zone."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found if at is None else found.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """event_type, window_start, n, total."""
    found = events.withWatermark(at, late).groupBy("event_type", F.window(at, width).alias("w"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """user_id, session_start, session_end, n."""
    found = events.withWatermark(at, late).groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that is there now, appended to a table under ``folder``: of windows those that the watermark has closed."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def pump(events: DataFrame, target: str, checkpoint: str, key: str, version: str) -> StreamingQuery:
    """Apply events to a projection in batches: the highest version of each key stays, batches replayed after a failure change nothing.

    A batch writes a segment of its own keys, named by its number, and segments
    of like size are merged, so that what is written grows with the events.
    """
    log = Log(events.sparkSession, target, [key], version)

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), version).alias("e")).select("e.*")
        log.append(last, f"batch-{number}")
        log.settle()
        log.clean()

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, target: str, schema: StructType, key: str, version: str) -> DataFrame:
    """The projection as it is now; before the first batch it is empty. schema: of the events."""
    log = Log(spark, target, [key], version)
    return log.read().select(schema.names) if log.version() else spark.createDataFrame([], schema)
