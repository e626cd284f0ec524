"""Stored invoices (S9, S10): header columns beside a JSON body, in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_json_body(invoices: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in invoices.columns if c not in keys]
    return invoices.select(*keys, F.to_json(F.struct(*rest)).alias("data"))


def current_invoices(stored: DataFrame, body_schema: str) -> DataFrame:
    return stored.withColumn("body", F.from_json("data", body_schema)).drop("data")


def write_invoices(invoices: DataFrame, folder: str, partition: str | None = None) -> None:
    """Appends invoices; a date partition lets later reads and overwrites touch few files."""
    writer = invoices.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)


def read_invoices(spark: SparkSession, folder: str, schema, **equals) -> DataFrame:
    """Stored rows; equality filters reach the Parquet scan."""
    df = spark.read.schema(schema).parquet(folder)
    for column, value in equals.items():
        df = df.filter(F.col(column) == value)
    return df


def overwrite_partitions(current: DataFrame, folder: str, partition: str) -> None:
    """Replaces only the partitions that occur in ``current``."""
    current.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).parquet(folder)
