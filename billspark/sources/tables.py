"""Parquet tables of one folder, read with only the columns a query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_lines(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """One row per (order, line): repeats resolve to the last by ship date, ties by all columns.

    ``partitions``: the orders are spread over so many, for readers that group by order next; lines are then
    shuffled and sorted once. Rows (a struct is compared) are aggregated by sorting, not by hashing.
    """
    rest = [
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus",
    ]
    lines = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", *rest)
    if partitions:
        lines = lines.repartition(partitions, "l_orderkey")
    return (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.max(F.struct(*rest)).alias("v"))
        .select("l_orderkey", "l_linenumber", "v.*")
    )


def item_amount() -> "F.Column":
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    keep = 1 - F.col("l_discount").cast("decimal(4,2)")
    return F.bround(price * keep, 2).cast("decimal(18,2)")
