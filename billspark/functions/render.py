"""Invoices as text and HTML (S11). Pure string columns, written with the text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V


def two_places(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(18,2)").cast("string")


def cut(c: Column, n: int) -> Column:
    """First n characters, dots only where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def or_else(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def currency_symbol(code: Column) -> Column:
    out = None
    for k, v in V.CURRENCY_SYMBOLS.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(code)


def has_tax(items: Column) -> Column:
    return F.exists(items, lambda i: F.coalesce(i["tax_rate"] != 0, F.lit(False)))


def _numbered(items: Column, body) -> Column:
    return F.transform(items, lambda x, i: body(x, (i + 1).cast("string")))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def display_text(row: dict[str, Column]) -> Column:
    """Short summary; lines without content are left out."""
    def given(c):
        return F.coalesce(c, F.lit("")) != ""

    items = _numbered(
        row["work_items"],
        lambda x, n: F.concat(
            F.lit("  "), n, F.lit(". "), F.substring(x["description"], 1, 30), F.lit("... - £"),
            two_places(x["amount"]),
        ),
    )
    return F.concat_ws(
        "\n",
        _labelled("👤 *Contractor:* ", row["contractor_name"]),
        _labelled("📧 *Email:* ", row["contractor_email"]),
        _labelled("🏠 *Address:* ", cut(row["contractor_address"], 50)),
        F.when(given(row["contractor_utr"]), _labelled("🆔 *UTR:* ", row["contractor_utr"])),
        F.when(given(row["contractor_ni"]), _labelled("🔢 *NI:* ", row["contractor_ni"])),
        F.when(
            given(row["bank_account"]),
            F.concat(F.lit("💳 *Bank:* "), row["bank_account"], F.lit(" | Sort: "), row["sort_code"]),
        ),
        _labelled("📄 *Invoice #:* ", row["invoice_number"]),
        _labelled("📅 *Date:* ", row["invoice_date"]),
        F.when(
            given(row["work_start_date"]),
            F.concat(F.lit("📆 *Period:* "), row["work_start_date"], F.lit(" to "), row["work_end_date"]),
        ),
        F.lit("🔨 *Work Items:*"),
        F.when(F.size(items) > 0, F.array_join(items, "\n")),
        F.when(given(row["operative_names"]), _labelled("👷 *Operatives:* ", row["operative_names"])),
        F.lit("💰 *Financial Summary:*"),
        _labelled("  Subtotal: £", two_places(row["subtotal"])),
        _labelled("  VAT: £", two_places(row["vat_amount"])),
        _labelled("  CIS Deduction: £", two_places(row["cis_amount"])),
        F.concat(F.lit("  *Total: £"), two_places(row["total"]), F.lit("*")),
    )


def summary_text(row: dict[str, Column], missing: str = "N/A", width: int = 40) -> Column:
    """Full summary for confirmation; ``missing='Not found'`` gives the extracted-data form."""
    items = _numbered(
        row["work_items"],
        lambda x, n: F.concat(
            F.lit("  "), n, F.lit(". "), cut(or_else(x["description"], missing), width),
            F.lit(" - £"), two_places(x["amount"]),
        ),
    )

    def v(name):
        return or_else(row[name], missing)

    return F.concat_ws(
        "\n",
        F.lit("📋 *Invoice Summary*"),
        _labelled("👤 Name: ", v("contractor_name")),
        _labelled("📧 Email: ", v("contractor_email")),
        _labelled("🏠 Address: ", cut(v("contractor_address"), 60)),
        _labelled("🆔 UTR: ", v("contractor_utr")),
        _labelled("🔢 NI: ", v("contractor_ni")),
        F.concat(F.lit("💳 Bank: "), v("bank_account"), F.lit(" | Sort: "), v("sort_code")),
        _labelled("📄 Number: ", v("invoice_number")),
        _labelled("📅 Date: ", v("invoice_date")),
        F.concat(F.lit("📆 Period: "), v("work_start_date"), F.lit(" to "), v("work_end_date")),
        F.lit("*Work Items:*"),
        F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise("  No work items added"),
        _labelled("  Subtotal: £", two_places(row["subtotal"])),
        _labelled("  VAT: £", two_places(row["vat_amount"])),
        _labelled("  CIS Deduction: £", two_places(row["cis_amount"])),
        F.concat(F.lit("  *TOTAL: £"), two_places(row["total"]), F.lit("*")),
    )


def html_document(row: dict[str, Column]) -> Column:
    """One HTML page per invoice: header, parties, item table, totals."""
    def cell(c, css=""):
        return F.concat(F.lit(f"<td{css}>"), F.coalesce(c, F.lit("")), F.lit("</td>"))

    items = _numbered(
        row["work_items"],
        lambda x, n: F.concat(
            F.lit("<tr>"), cell(n), cell(x["description"]),
            cell(F.concat(F.lit("£"), two_places(x["amount"])), ' class="amount"'), F.lit("</tr>"),
        ),
    )

    def p(label, name):
        return F.concat(F.lit(f"<p><strong>{label}:</strong> "), or_else(row[name], "N/A"), F.lit("</p>"))

    def total(label, name, sign=""):
        return F.concat(
            F.lit(f'<tr><td>{label}:</td><td class="amount">{sign}£'), two_places(row[name]),
            F.lit("</td></tr>"),
        )

    none = '<tr><td colspan="3">No work items</td></tr>'
    return F.concat_ws(
        "\n",
        F.lit('<!DOCTYPE html><html><head><meta charset="UTF-8"></head><body><h1>INVOICE</h1>'),
        p("Invoice Number", "invoice_number"), p("Invoice Date", "invoice_date"),
        p("Name", "contractor_name"), p("Address", "contractor_address"),
        p("Email", "contractor_email"), p("UTR", "contractor_utr"), p("NI Number", "contractor_ni"),
        p("Bank Account", "bank_account"), p("Sort Code", "sort_code"),
        F.lit("<table>"),
        F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(none),
        F.lit("</table><table>"),
        total("Subtotal", "subtotal"), total("VAT", "vat_amount"),
        total("CIS Deduction", "cis_amount", "-"), total("TOTAL", "total"),
        F.lit("</table></body></html>"),
    )


def write_rendered(df: DataFrame, folder: str, body: str = "body") -> None:
    """Rendered documents, one folder per format. The text sink takes one string column."""
    df.select("format", body).write.mode("append").partitionBy("format").text(folder, lineSep="\f")
