"""Invoice numbers in batch (A14) and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billspark.operators.slices import row_numbers


def assign_invoice_numbers(
    new: DataFrame, existing: DataFrame, order: list[str], start: int = 1000, **slicing
) -> DataFrame:
    """``prefix-N`` with N = start + existing of that prefix + position.

    One prefix usually holds everything, so positions come from a sliced scan, and the existing
    rows are only counted.
    """
    have = existing.groupBy("prefix").agg(F.count(F.lit(1)).alias("_have"))
    numbered = row_numbers(new, ["prefix"], order, "_k", **slicing)
    n = F.lit(start) + F.coalesce("_have", F.lit(0)) + F.col("_k") - 1
    return numbered.join(have, "prefix", "left").withColumn(
        "invoice_number", F.concat_ws("-", "prefix", n.cast("string"))
    ).drop("_k", "_have")


def list_by_user(rows: DataFrame, user: int, limit: int = 10, offset: int = 0) -> DataFrame:
    """Newest first for one user; the filter reaches the scan."""
    mine = rows.filter(F.col("user_id") == user)
    return mine.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def page_per_user(rows: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The same page for every user; ranks above the page are dropped before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    ranked = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= offset + limit)
    return ranked.filter(F.col("position") > offset)


def upsert_latest(
    changes: DataFrame, keys: list[str], order: list[str], deleted: str | None = None
) -> DataFrame:
    """Current rows from append-only changes: the last change per key, without tombstones."""
    columns = [c for c in changes.columns if c not in keys]
    out = changes.groupBy(*keys).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    ).select(*keys, "_r.*")
    return out.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def documents_of_invoices(invoices: DataFrame, documents: DataFrame, how: str = "left") -> DataFrame:
    """Each invoice with its source document; Spark picks the join from the sizes it sees."""
    return invoices.join(documents, invoices["source_document"] == documents["document_id"], how)
