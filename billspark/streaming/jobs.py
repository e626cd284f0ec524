"""Running streams: landing folder to invoices (T8), saved sessions (T9), bounded runs to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.plans.extraction import validated_invoices
from billspark.session import shared_folder
from billspark.sources.documents import BINARY, pending_documents
from billspark.functions.files import decode_text, detect_file_type, file_kind_six, reject_reason
from billspark.functions.fixed_values import MAX_FILE_BYTES


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there now and return it as a table (exactly-once file sink)."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress")
    writer.trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def landing_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    files = (
        _for_small_files(spark).readStream.format("binaryFile")
        .schema(BINARY)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.withColumn("file_type", detect_file_type(F.col("path"), F.col("content")))


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A copy of the session in which a trigger's files are listed and read by about as many tasks as there are cores.

    Spark lists every file or folder in a task of its own and reads at most 32 files in a task; for small files starting
    the tasks is nearly all of the time. Large files are still read by as many tasks as their bytes ask for.
    """
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.files.openCostInBytes", "64k")
    return own


def landing_stream(
    spark: SparkSession, folder: str, out: str, progress: str, as_of: str, once: bool = True
):
    """New files -> kind -> text -> invoices; rejects and files that need a reader beside them.

    The rules are set up once, over the stream; a batch only writes what they gave. Every batch writes its own folder
    and overwrites it when replayed, so a retry adds nothing twice.
    """
    files = landing_files(spark, folder)
    path, length, kind = F.col("path"), F.col("length"), F.col("file_type")
    reason = reject_reason(path, length, MAX_FILE_BYTES)
    good = (length <= MAX_FILE_BYTES) & (file_kind_six(path) != "unknown")
    marked = files.select(
        F.xxhash64(path).alias("doc_id"), path, length.alias("_length"), kind.alias("_file_type"), good.alias("_good"),
        reason.alias("_reject_reason"), F.when(good & (kind == "text"), decode_text(F.col("content"))).alias("text"),
    )
    found, marks = validated_invoices(marked, as_of), ["_length", "_file_type", "_good", "_reject_reason"]

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        texts = batch.filter(F.col("_good") & (F.col("_file_type") == "text")).drop(*marks)
        texts.write.mode("overwrite").parquet(f"{out}/invoices/batch={batch_id}")
        bare = batch.select("path", *[F.col(m).alias(m[1:]) for m in marks])
        bad = bare.filter(F.col("reject_reason").isNotNull()).select("path", "length", "reject_reason")
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        pending_documents(bare.filter("good")).write.mode("overwrite").parquet(f"{out}/pending/batch={batch_id}")
        batch.unpersist()

    writer = found.writeStream.foreachBatch(each).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")
    return writer.start()


def state_sync(
    changes: DataFrame, out: str, progress: str, keys: list[str], order: list[str],
    every: str = "60 seconds", once: bool = False, compact_every: int = 16,
):
    """Latest state per key of each interval, written at most once per interval.

    Every ``compact_every`` intervals what has been written is merged into one row per key, and the parts that
    this covers are deleted. ``current_state`` so reads one base and fewer than ``compact_every`` intervals,
    however many there have been.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        latest = _latest(batch, keys, order)
        latest.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _compact(batch.sparkSession, out, keys, order, batch_id)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", progress)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return latest.select(*keys, "_r.*")


def _folder(spark: SparkSession, path: str):
    """A folder and its file system, through the cluster's own Hadoop settings."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``batch=`` folders that were written to the end."""
    at, files = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [(entry.getPath(), entry.getPath().getName()) for entry in files.listStatus(at)]
    done = [(p, n) for p, n in names if n.startswith("batch=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for _, n in done)


def _parts(spark: SparkSession, out: str, until: int | None = None) -> list[str]:
    """The newest base and the intervals after it, up to interval ``until``."""
    bases = [n for n in finished_batches(spark, f"{out}/base") if until is None or n < until]
    since = bases[-1] if bases else -1
    later = [n for n in finished_batches(spark, f"{out}/changes") if n > since and (until is None or n <= until)]
    return [f"{out}/base/batch={n}" for n in bases[-1:]] + [f"{out}/changes/batch={n}" for n in later]


def _compact(spark: SparkSession, out: str, keys: list[str], order: list[str], batch_id: int) -> None:
    if batch_id not in finished_batches(spark, f"{out}/base"):  # a replay after the merge only has to tidy up
        merged = _latest(spark.read.parquet(*_parts(spark, out, batch_id)), keys, order)
        merged.write.mode("overwrite").parquet(f"{out}/base/batch={batch_id}")
    for kind, covered in (("changes", batch_id + 1), ("base", batch_id)):
        for n in finished_batches(spark, f"{out}/{kind}"):
            if n < covered:
                at, files = _folder(spark, f"{out}/{kind}/batch={n}")
                files.delete(at, True)


def current_state(spark: SparkSession, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over everything ``state_sync`` has written to ``out``."""
    return _latest(spark.read.parquet(*_parts(spark, out)), keys, order)
