"""Answers of extraction models as text: JSON out of fences, fields to invoices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billspark.functions.text import strip
from billspark.schemas import MODEL_JSON

MONEY = "decimal(18,2)"
FLAT_TEXT = [
    "contractor_name", "contractor_email", "contractor_address", "contractor_utr", "contractor_ni",
    "bank_account", "sort_code", "invoice_number", "invoice_date", "work_start_date", "work_end_date",
]
FLAT_MONEY = ["subtotal", "vat_amount", "cis_amount", "total"]


def strip_fences(c: Column) -> Column:
    s = F.regexp_replace(strip(c), r"^```(?:json)?", "")
    return strip(F.regexp_replace(s, r"```$", ""))


def parse_model_json(c: Column, schema: str = MODEL_JSON) -> Column:
    """struct<data, error>: the parsed object, or the reason there is none."""
    body = strip_fences(c)
    bad = F.try_parse_json(body).isNull()
    data = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    return F.struct(
        F.when(~bad, data).alias("data"),
        F.when(bad, "Failed to parse response").alias("error"),
    )


def json_to_flat_invoice(data: Column, source: str) -> dict[str, Column]:
    """Flat invoice: missing text is '', bad or missing amounts are 0, a zero total is worked out."""
    out = {f: F.coalesce(data[f], F.lit("")) for f in FLAT_TEXT}
    zero = F.lit(0).cast(MONEY)
    money = {f: F.coalesce(data[f].try_cast(MONEY), zero) for f in FLAT_MONEY}
    worked_out = (money["subtotal"] + money["vat_amount"] - money["cis_amount"]).cast(MONEY)
    out |= money
    out["total"] = F.when(money["total"] == 0, worked_out).otherwise(money["total"])
    out["source"] = F.lit(source)
    return out


def json_to_invoice(data: Column) -> Column:
    """Item-level invoice with defaults: unknown customer, quantity 1, price 0, USD."""
    kind = "decimal(18,4)"

    def item(i):
        rate = i["tax_rate"].try_cast(kind)
        quantity = F.coalesce(i["quantity"].try_cast(kind), F.lit(1).cast(kind))
        price = F.coalesce(i["unit_price"].try_cast(kind), F.lit(0).cast(kind))
        return F.struct(
            F.coalesce(i["description"], F.lit("Item")).alias("description"),
            quantity.alias("quantity"), price.alias("unit_price"),
            (quantity * price).cast("decimal(28,4)").alias("amount"),
            F.when(rate != 0, rate).alias("tax_rate"),
        )

    empty = F.array().cast(
        f"array<struct<description:string,quantity:{kind},unit_price:{kind},amount:decimal(28,4),tax_rate:{kind}>>"
    )
    return F.struct(
        data["invoice_number"].alias("invoice_number"),
        F.coalesce(data["customer_name"], F.lit("Unknown Customer")).alias("customer_name"),
        F.lower(data["customer_email"]).alias("customer_email"),
        F.upper(F.coalesce(data["currency"], F.lit("USD"))).alias("currency"),
        F.coalesce(F.transform(data["items"], item), empty).alias("items"),
    )
