"""Structured Streaming jobs: windowed counts and routing; and the batch forms of the stateful ones.

Each job runs with an availableNow trigger and ends by itself. Checkpoints and outputs live
in the shared folder, so a restarted driver or a lost executor continues from the last batch.
Every batch writes to a path named by its batch id and overwrites it, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import Scan
from ..session import new_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a Parquet table as a stream; the table may be a folder of part files or a single file.

    The path is given as a pattern that matches nothing else: a plain one would have to be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def slot_counts(events: DataFrame, key: str, ts: str, slide: str, label: str) -> DataFrame:
    """(slot, key, n) over all rows of a stream, whatever their order: counts per key and tumbling slot.

    Counts are additive, so every micro-batch writes those of its own rows and the reader sums them up. No row can be too late: there is
    no watermark and no state to drop it from.
    """
    spark, base = events.sparkSession, new_path(events.sparkSession, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        n = batch.groupBy(F.window(ts, slide).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
        n.select(F.col("w.start").alias("slot"), key, "n").write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    events.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    schema = T.StructType([T.StructField("slot", T.TimestampType()), events.schema[key], T.StructField("n", T.LongType()), T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    return written.groupBy("slot", key).agg(F.sum("n").alias("n"))


def sliding(slots: DataFrame, key: str, slots_per_window: int, slide: str) -> DataFrame:
    """(start, key, n): windows of so many slots, one starting at every slot; windows without a row are left out."""
    back = F.sequence(F.lit(0), F.lit(slots_per_window - 1))
    starts = F.transform(back, lambda i: F.col("slot") - i * F.expr(f"INTERVAL {slide}"))
    return slots.select(F.explode(starts).alias("start"), key, "n").groupBy("start", key).agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, key: str, ts: str, slots_per_window: int, slide: str, label: str) -> DataFrame:
    """Sliding event-time counts per key over all rows of a stream."""
    return sliding(slot_counts(events, key, ts, slide, label), key, slots_per_window, slide)


def route(stream: DataFrame, code: str, label: str) -> DataFrame:
    """Send rows to one folder per code; returns the union of what was written."""
    spark = stream.sparkSession
    base = new_path(spark, label)
    fields = [f for f in stream.schema.fields if f.name != code]

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(code).parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    schema = T.StructType([*fields, T.StructField("batch", T.LongType()), T.StructField(code, T.StringType())])
    return spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")


# --- batch forms of the stateful operators ---------------------------------------------------


def transitions(rows: DataFrame, key: str, ts: str, tie: str, label: str) -> DataFrame:
    """Rows whose label differs from the previous one of their key, which may be of any length."""
    s = Scan(rows, [key], [ts, tie]).previous(label, "prev").done()
    return s.where(F.col("prev").isNotNull() & (F.col("prev") != F.col(label)))


def failure_streaks(runs: DataFrame, key: str, order: str, ok: str, escalate: int = 3) -> DataFrame:
    """Consecutive failures up to each run, and whether that run escalates: failures so far less those up to the last success."""
    s = Scan(runs, [key], [order]).total((~F.col(ok)).cast("long"), "_bad").latest(F.when(F.col(ok), F.col("_bad")), "_then").done()
    s = s.withColumn("streak", F.col("_bad") - F.coalesce("_then", F.lit(0)))
    return s.withColumn("escalate", F.col("streak") >= escalate).drop("_bad", "_then")


def run_lengths(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Length of the unbroken run of consecutive indices each row ends; one row per key and period."""
    w = Window.partitionBy(*keys).orderBy(index)
    r = rows.withColumn("_g", F.col(index) - F.row_number().over(w))
    return r.withColumn("run", F.row_number().over(Window.partitionBy(*keys, "_g").orderBy(index)).cast("long")).drop("_g")
