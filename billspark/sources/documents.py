"""Folders of files and logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions.files import decode_text, detect_file_type, file_kind_six, reject_reason
from billspark.functions.fixed_values import MAX_FILE_BYTES
from billspark.schemas import EVENT_LOG

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def scan_documents(
    spark: SparkSession, paths: str | list[str], glob: str = "*", recursive: bool = True,
) -> DataFrame:
    """Files of a folder, or of a list of folders and files, with their kind.

    The kind comes from the extension, from the content only where that is unknown.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", str(recursive).lower()
    )
    return reader.load(paths).withColumn("file_type", detect_file_type(F.col("path"), F.col("content")))


def split_supported(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files to process, rejects with a reason).

    The size is a plain filter on ``length``, which the file source applies before it opens a file; rejects
    select no content. Together with ``pending_documents`` every file has exactly one fate: text,
    pending or reject.
    """
    path, length = F.col("path"), F.col("length")
    good = files.filter(length <= max_bytes).filter(file_kind_six(path) != "unknown")
    marked = files.select("path", "length", reject_reason(path, length, max_bytes).alias("reject_reason"))
    return good, marked.filter(F.col("reject_reason").isNotNull())


def pending_documents(files: DataFrame) -> DataFrame:
    """Supported files whose text must come from elsewhere (a PDF reader, OCR): path, kind and why."""
    return files.filter(F.col("file_type") != "text").select(
        "path", "length", "file_type", F.lit("needs_text_extraction").alias("pending_reason")
    )


def text_documents(files: DataFrame) -> DataFrame:
    """Decoded text of the text files; ``doc_id`` is a hash of the path. See ``pending_documents`` for the rest."""
    return files.filter(F.col("file_type") == "text").select(
        F.xxhash64("path").alias("doc_id"), "path", decode_text(F.col("content")).alias("text")
    )


def parse_event_lines(lines: DataFrame, schema: str = EVENT_LOG) -> DataFrame:
    """JSON log lines in ``value`` -> columns; a line that does not parse is marked ``rejected``.

    ``rescued`` holds the line as it came if it does not parse or if a declared field is there but not of
    its type (and so is missing in its column): nothing is lost.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    parsed = lines.withColumn("_e", F.from_json("value", schema)).withColumn(
        "rejected", F.try_parse_json("value").isNull()
    )
    lost = F.col("rejected")
    for f in fields:
        lost = lost | (F.col("_e")[f].isNull() & F.get_json_object("value", f"$.{f}").isNotNull())
    return parsed.select(
        "*", *[F.when(~F.col("rejected"), F.col("_e")[f]).alias(f) for f in fields], F.when(lost, F.col("value")).alias("rescued")
    ).drop("_e")


def scan_event_log(spark: SparkSession, folder: str, schema: str = EVENT_LOG) -> DataFrame:
    return parse_event_lines(spark.read.text(folder), schema)


def stream_event_log(
    spark: SparkSession, folder: str, schema: str = EVENT_LOG, files_per_trigger: int = 1000
) -> DataFrame:
    """As ``scan_event_log``, for log files that keep coming."""
    return parse_event_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), schema)
