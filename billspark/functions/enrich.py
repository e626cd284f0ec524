"""Enrichment (E1-E5): fill missing amounts, infer tax codes, run clean-validate-enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions.normalize import clean_invoice, clean_money, with_fields
from billspark.functions.validate import expected_vat, validate_invoice

SUM = "decimal(38,6)"


def items_total(items: Column) -> Column:
    """Sum of item amounts, null when it is not above zero (A2, nested form)."""
    total = F.aggregate(
        items,
        F.lit(0).cast(SUM),
        lambda acc, i: (acc + F.coalesce(i["amount"], F.lit(0).cast("decimal(24,6)"))).cast(SUM),
    )
    return F.when(total > 0, total.cast("decimal(24,6)"))


def fill_financials(
    subtotal: Column, vat: Column, rate: Column, cis: Column, total: Column, items_sum: Column,
    zero_rate_is_zero: bool = False,
) -> dict[str, Column]:
    """Subtotal from items, then VAT, then total: each only where missing."""
    zero = F.lit(0).cast("decimal(24,6)")
    sub = F.coalesce(subtotal, items_sum)
    tax = F.coalesce(vat, F.bround(expected_vat(sub, rate, zero_rate_is_zero), 2))
    due = F.coalesce(total, sub + F.coalesce(tax, zero) - F.coalesce(cis, zero))
    return {"subtotal": sub, "vat_amount": tax, "total_due": due}


def infer_vat_code(code: Column, vat: Column) -> Column:
    return F.coalesce(code, F.when(vat > 0, "S").when(vat == 0, "Z").otherwise("N"))


def infer_cis_code(code: Column, cis: Column) -> Column:
    return F.coalesce(code, F.when(cis > 0, "L"))


def recompute_total(subtotal: Column, vat: Column, cis: Column) -> Column:
    return subtotal + vat - cis


def enrich_invoice(df: DataFrame, zero_rate_is_zero: bool = False) -> DataFrame:
    fin = F.col("financials")
    filled = fill_financials(
        fin["subtotal"], fin["vat_amount"], fin["vat_rate"], fin["cis_deduction"],
        fin["total_due"], items_total(F.col("work_items")), zero_rate_is_zero,
    )
    df = df.withColumn(
        "financials", with_fields(fin, **{k: clean_money(v) for k, v in filled.items()})
    )
    fin = F.col("financials")
    return df.withColumn(
        "financials",
        with_fields(
            fin,
            vat_code=infer_vat_code(fin["vat_code"], fin["vat_amount"]),
            cis_code=infer_cis_code(fin["cis_code"], fin["cis_deduction"]),
        ),
    )


def enrich_flat(df: DataFrame, there: Column, zero_rate_is_zero: bool = False) -> DataFrame:
    """``enrich_invoice`` over flat fields, where there is a block of financials; adds the tax codes."""
    amounts = [F.col(n) for n in ("subtotal", "vat_amount", "vat_rate", "cis_deduction", "total_due")]
    filled = fill_financials(*amounts, items_total(F.col("work_items")), zero_rate_is_zero)
    none = F.lit(None).cast("string")
    df = df.withColumns({k: F.when(there, clean_money(v)) for k, v in filled.items()})
    return df.withColumns({
        "vat_code": infer_vat_code(none, F.col("vat_amount")), "cis_code": infer_cis_code(none, F.col("cis_deduction")),
    })


def validate_and_clean(
    df: DataFrame, as_of: str, do_clean: bool = True, do_validate: bool = True,
    do_enrich: bool = True, zero_rate_is_zero: bool = False,
) -> DataFrame:
    """Clean, validate, enrich, in that order: validation sees values before enrichment."""
    if do_clean:
        df = clean_invoice(df)
    if do_validate:
        df = validate_invoice(df, as_of, zero_rate_is_zero)
    if do_enrich:
        df = enrich_invoice(df, zero_rate_is_zero)
    return df
