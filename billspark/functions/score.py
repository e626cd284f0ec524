"""Scores (C1-C5), acceptance bands (P8), validity predicates (P1-P3) and confidence merging (A4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billspark.functions.text import is_garbage, is_valid_text

VERIFY_FROM, ACCEPT_ABOVE = 0.6, 0.85


def _points(*tests: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for test, points in tests:
        total = total + F.when(test, points).otherwise(0.0)
    return total


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _non_zero(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


def nested_row() -> dict[str, Column]:
    """What the scores read, from the columns of the nested row."""
    c, fin = F.col("contractor"), F.col("financials")
    return {
        "invoice_number": F.col("invoice_number"), "invoice_date": F.col("invoice_date"), "name": c["name"],
        "street": c["address"]["street"], "utr": c["utr"],
        **{n: fin[n] for n in ("subtotal", "vat_amount", "total_due")},
        "has_contractor": c.isNotNull(), "has_financials": fin.isNotNull(), "n_items": F.size("work_items"),
    }


def completeness(row: dict[str, Column] | None = None) -> Column:
    """Points over the blocks that are present; ``row`` as ``nested_row`` or ``fields.flat_row`` gives it."""
    r = row or nested_row()
    n = r["n_items"]
    score = (
        _points(
            (_filled(r["invoice_number"]), 1.0),
            (r["invoice_date"].isNotNull(), 1.0),
            (_filled(r["name"]), 1.0),
            (_filled(r["street"]), 0.5),
            (_filled(r["utr"]), 0.5),
            (_non_zero(r["subtotal"]), 1.0),
            (r["vat_amount"].isNotNull(), 0.5),
            (_non_zero(r["total_due"]), 1.0),
        )
        + F.when(n > 0, F.least(n * 0.5, F.lit(2.0))).otherwise(0.0)
    )
    out_of = F.lit(2.0) + _points((r["has_contractor"], 2.0), (n > 0, 2.0), (r["has_financials"], 2.5))
    return score / out_of


def extraction_confidence(text: Column, row: dict[str, Column] | None = None) -> Column:
    r = row or nested_row()
    n = r["n_items"]
    score = _points(
        (_filled(r["invoice_number"]), 0.15),
        (r["invoice_date"].isNotNull(), 0.15),
        (_filled(r["name"]), 0.15),
        (_non_zero(r["subtotal"]) | _non_zero(r["total_due"]), 0.2),
        (r["vat_amount"].isNotNull(), 0.1),
    ) + F.when(n > 0, F.least(n * 0.1, F.lit(0.25))).otherwise(0.0)
    return F.when(_filled(text), F.least(score, F.lit(1.0))).otherwise(0.0)


def heuristic_quality(
    name: Column, email: Column, address: Column, number: Column, date: Column,
    subtotal: Column, total: Column,
) -> Column:
    """Ten-point rubric over the flat invoice."""
    def found(c):
        return _filled(c) & (c != "Not found")

    named = found(name) & (F.length(name) > 2)
    name_points = F.when(named & is_valid_text(name), 2.0).when(named, 0.5).otherwise(0.0)
    rest = _points(
        (_filled(email) & email.contains("@") & email.contains("."), 2.0),
        (found(address) & (F.length(address) > 5), 1.0),
        (found(number), 1.5),
        (found(date), 1.0),
        (F.coalesce(subtotal > 0, F.lit(False)), 1.25),
        (F.coalesce(total > 0, F.lit(False)), 1.25),
    )
    return (name_points + rest) / 10.0


def field_fill_quality(
    raw_text: Column, text_fields: list[Column], amounts: list[Column],
    has_data: Column | None = None,
) -> Column:
    """min(1, filled/8), times 0.6 with any issue; 0.1 when there is no data at all."""
    filled = F.lit(0)
    for c in text_fields:
        filled = filled + F.when(_filled(c), 1).otherwise(0)
    for c in amounts:
        filled = filled + F.when(_non_zero(c), 1).otherwise(0)
    issue = (filled < 3) | (_filled(raw_text) & is_garbage(raw_text))
    base = F.least(F.lit(1.0), filled / 8.0)
    nothing = filled == 0 if has_data is None else ~has_data
    return F.when(nothing, 0.1).when(issue, base * 0.6).otherwise(base)


def quarter_confidence(*fields: Column) -> Column:
    filled = F.lit(0)
    for c in fields:
        filled = filled + F.when(c.isNotNull(), 1).otherwise(0)
    return filled / F.lit(float(len(fields)))


def accept_band(confidence: Column) -> Column:
    return (
        F.when(confidence > ACCEPT_ABOVE, "auto")
        .when(confidence >= VERIFY_FROM, "verify")
        .otherwise("manual")
    )


def merge_confidence(score: Column) -> Column:
    """Aggregate: sum of squares over sum, 0 when there is nothing to weigh."""
    return F.coalesce(F.sum(score * score) / F.nullif(F.sum(score), F.lit(0.0)), F.lit(0.0))


def is_valid_invoice(row: dict[str, Column] | None = None) -> Column:
    r = row or nested_row()
    money = r["subtotal"].isNotNull() | r["total_due"].isNotNull()
    return r["invoice_number"].isNotNull() | (r["name"].isNotNull() & money)


REQUIRED_FIELDS = [
    ("contractor_name", "Contractor Name"), ("contractor_address", "Contractor Address"),
    ("contractor_email", "Contractor Email"), ("invoice_number", "Invoice Number"),
    ("invoice_date", "Invoice Date"),
]


def is_complete() -> Column:
    """Flat invoice: name, address, number and date filled, at least one item."""
    ok = F.size("work_items") > 0
    for field in ["contractor_name", "contractor_address", "invoice_number", "invoice_date"]:
        ok = ok & _filled(F.col(field))
    return ok


def missing_fields() -> Column:
    labels = [F.when(~_filled(F.col(f)), label) for f, label in REQUIRED_FIELDS]
    no_items = F.when(F.coalesce(F.size("work_items"), F.lit(0)) <= 0, "Work Items")
    return F.array_compact(F.array(*labels, no_items))


def collected_fields(required: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(_filled(F.col(f)), f) for f in required]))


def pending_fields(required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in required]), collected_fields(required))
