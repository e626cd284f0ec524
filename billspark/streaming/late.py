"""A gate before streams with windows: late rows are counted and kept instead of being dropped unseen.

Spark drops rows behind the watermark inside its stateful operators and says only how many. The gate decides
before them: for every batch it knows the latest time of the batches before (written beside the rows, so a
batch that is replayed is judged the same), takes the watermark from it, and writes the batch once, in two parts.
Streams read the accepted part; their own watermark, from the same rows and the same delay, cannot be ahead of
the gate's, so they drop nothing. The late part is the ledger's source and can be worked in later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from billspark.streaming.windows import WATERMARK


def admit(
    events: DataFrame, out: str, progress: str, time: str = "ts", watermark: str = WATERMARK, once: bool = True
):
    """Write ``events`` to ``out`` by accepted and late rows; rows without a time are accepted.

    A row is late if ``time`` is not after the latest time of all earlier batches less ``watermark``.
    """
    schema = events.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = spark.read.schema("reached timestamp").parquet(f"{out}/reached/batch={batch_id - 1}").first()[0] if batch_id else None
        behind = F.col(time) <= F.lit(reached).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        marked = batch.withColumns({"late": F.coalesce(behind, F.lit(False)), "batch": F.lit(batch_id)})
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("late", "batch").parquet(f"{out}/rows")
        newest = _rows(spark, out, schema).filter(F.col("batch") == batch_id).agg(F.max(time).alias("reached"))
        newest = newest.select(F.greatest(F.col("reached"), F.lit(reached).cast("timestamp")).alias("reached"))
        newest.write.mode("overwrite").parquet(f"{out}/reached/batch={batch_id}")

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")
    return writer.start()


def _rows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    full = StructType(list(schema.fields)).add("late", BooleanType()).add("batch", IntegerType())
    return spark.read.schema(full).parquet(f"{out}/rows")


def accepted_rows(spark: SparkSession, out: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """The rows that ``admit`` let through, as a stream."""
    full = StructType(list(schema.fields)).add("batch", IntegerType())
    files = spark.readStream.schema(full).option("maxFilesPerTrigger", files_per_trigger)
    return files.parquet(f"{out}/rows/late=false").select(*schema.names)


def late_rows(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The rows that came too late, each with its ``batch``."""
    return _rows(spark, out, schema).filter("late").drop("late")


def late_ledger(spark: SparkSession, out: str, schema: StructType, length: str = "1 hour", time: str = "ts") -> DataFrame:
    """``batch, start, end, n_late``: how many late rows each batch brought to each window."""
    found = late_rows(spark, out, schema).groupBy("batch", F.window(time, length).alias("w")).agg(F.count(F.lit(1)).alias("n_late"))
    return found.select("batch", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_late")
