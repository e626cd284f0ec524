"""The batch path: text -> nested invoice -> attempt -> choice -> clean, validate, enrich -> statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions.enrich import enrich_flat
from billspark.functions.fixed_values import RAW_TEXT_CHARS
from billspark.functions.fields import contractor_name, extract_flat, flat_row, has_contractor, has_money, nest
from billspark.functions.normalize import clean_flat
from billspark.functions.score import completeness
from billspark.functions.text import strip
from billspark.functions.validate import financial_warnings, invoice_errors
from billspark.operators.attempts import ALL_FAILED, GATE, LOW_CONFIDENCE
from billspark.operators.items import item_count, plot_labels, plots_part, work_items

INVOICE = ["invoice_number", "invoice_date", "contractor", "work_period", "work_items", "financials"]
TEXT_METHOD, PAGED_METHOD = "text_extraction", "paged_extraction"
NO_TEXT = "No text extracted from file"


def _read(docs: DataFrame, text: str = "text", paged: bool = False) -> DataFrame:
    """``extract_flat_invoices`` with the text and its cleaned forms still beside the fields."""
    lined, plots, labels = F.col("_lined"), F.col("_plots"), F.col("_labels")
    flat = extract_flat(docs, text, paged).withColumn("_plots", plots_part(lined)).withColumn("_labels", plot_labels(plots))
    flat = flat.withColumns({"work_items": work_items(lined, plots, labels), "n_items": item_count(lined, labels)})
    return flat.withColumn("extraction_confidence", completeness(flat_row())).drop("_plots", "_labels")


def extract_flat_invoices(docs: DataFrame, text: str = "text", paged: bool = False) -> DataFrame:
    """Flat fields, items, their number and the completeness per document; the text itself is not carried on.

    Scores read flat columns, so a reader of scores alone has the other fields pruned away; out of a nested block
    Spark prunes none.
    """
    return _read(docs, text, paged).drop("_clean", "_lined", text)


def extract_invoices(docs: DataFrame, text: str = "text", paged: bool = False) -> DataFrame:
    """Nested invoice and its completeness per document; the text itself is not carried on."""
    return nest(extract_flat_invoices(docs, text, paged)).drop("n_items")


def as_attempts(docs: DataFrame, method: str, key: str = "doc_id", paged: bool = False) -> DataFrame:
    """One attempt per document; a blank text is a failure."""
    found = extract_invoices(docs.select(key, "text", _blank(F.col("text")).alias("_blank")), paged=paged)
    ok = ~F.col("_blank")
    return found.select(
        key,
        F.lit(method).alias("method"),
        ok.alias("success"),
        F.when(ok, F.col("extraction_confidence")).otherwise(0.0).alias("confidence"),
        F.when(~ok, NO_TEXT).alias("error_message"),
        F.lit(0).cast("bigint").alias("processing_time_ms"),
        *[F.when(ok, F.col(c)).alias(c) for c in INVOICE],
    )


def _blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def process_documents(docs: DataFrame, key: str = "doc_id", threshold: float = GATE) -> DataFrame:
    """Text rules first, paged rules only for the documents they did not get through the gate; one row per row of ``docs``.

    As ``select_attempt`` over the attempts of both. The two readings differ in the contractor's name alone, so both
    fit in one projection: a document that did not pass is searched for its paged name and scored again. Nothing is
    written, shuffled or gathered, and of the fields only those are read that the score or the caller asks for.
    """
    read = _read(docs.select(key, "text", _blank(F.col("text")).alias("_blank")))
    ok, name, first = ~F.col("_blank"), F.col("contractor_name"), F.col("extraction_confidence")
    read = read.withColumn("_passed", ok & F.coalesce(first >= threshold, F.lit(False)))
    again = ok & ~F.col("_passed")
    read = read.withColumn("_paged", F.when(again, contractor_name(F.col("_lined"), F.col("_clean"), paged=True)))
    read = read.withColumn("_second", F.when(again, completeness(flat_row(F.col("_paged")))))
    second = F.col("_second")
    better = F.coalesce((second >= threshold) | (second > first), F.lit(False))
    read = read.withColumns({
        "_better": better, "_passed_late": F.coalesce(second >= threshold, F.lit(False)),
        "success": F.col("_passed") | F.coalesce(ok & (better | (first > 0)), F.lit(False)),
    })
    better, chosen = F.col("_better"), F.col("success")
    found = nest(read.withColumn("contractor_name", F.when(better, F.col("_paged")).otherwise(name)))
    none = F.array().cast("array<string>")
    low = chosen & ~F.col("_passed") & ~F.col("_passed_late")
    return found.select(
        key, "success",
        F.when(chosen, F.when(better, 1).otherwise(0)).alias("attempt_no"),
        F.when(chosen, F.when(better, PAGED_METHOD).otherwise(TEXT_METHOD)).alias("best_method"),
        F.when(chosen, F.when(better, second).otherwise(first)).alias("confidence"),
        *[F.when(chosen, F.col(c)).alias(c) for c in INVOICE],
        F.when(F.col("_passed"), 1).otherwise(2).alias("n_attempts"),
        F.lit(0).cast("bigint").alias("total_ms"),
        F.when(chosen, none).when(ok, F.array(F.lit(ALL_FAILED))).otherwise(F.array(F.lit(NO_TEXT), F.lit(NO_TEXT))).alias("errors"),
        F.when(low, F.array(F.lit(LOW_CONFIDENCE))).otherwise(none).alias("warnings"),
    )


#: Flat fields that stand in the contractor's block, beside those that make it up.
_IN_CONTRACTOR = ["ni_number", "vat_number", "company_number", "phone", "postcode", "city", "sort_code", "account_number"]
_AMOUNTS = ["subtotal", "vat_amount", "cis_deduction", "total_due"]


def validated_invoices(docs: DataFrame, as_of: str, zero_rate_is_zero: bool = False) -> DataFrame:
    """``validate_and_clean`` of ``extract_invoices``, worked out on flat columns and nested last.

    So a caller's unused fields are neither searched for nor cleaned; ``n_items`` comes beside the items.
    """
    flat = extract_flat_invoices(docs)
    there, money = F.col("_there"), F.col("_money")
    flat = flat.withColumns({"_there": has_contractor(), "_money": has_money()})
    # what a missing block would hold is missing
    flat = flat.withColumns({
        **{n: F.when(there, F.col(n)) for n in _IN_CONTRACTOR}, **{n: F.when(money, F.col(n)) for n in _AMOUNTS},
        "vat_rate": F.when(money, F.coalesce("vat_rate", F.lit(20).cast("decimal(24,6)"))),
    })
    flat = clean_flat(flat)
    period = F.col("work_period")
    row = {
        **{n: F.col(n) for n in (
            "invoice_number", "invoice_date", "utr", "ni_number", "email", "postcode", "sort_code", "account_number",
            *_AMOUNTS, "vat_rate",
        )},
        **{n: period[n] for n in ("start_date", "end_date")},
    }
    flat = flat.withColumns({"errors": invoice_errors(row, as_of), "rule_warnings": financial_warnings(row, zero_rate_is_zero)})
    flat = enrich_flat(flat.withColumn("valid", F.size("errors") == 0), money, zero_rate_is_zero)
    return nest(flat, there, money).drop("_there", "_money")


def invoice_rows(
    docs: DataFrame, as_of: str, zero_rate_is_zero: bool = False, source: str = "path", raw_chars: int = RAW_TEXT_CHARS
) -> DataFrame:
    """The whole invoice row of each document: where and how it was read, the fields, the beginning of the
    text, what went wrong, and the number of items.

    ``docs``: doc_id, text and, where there is one, the column ``source``. A blank text has no fields, one processing error
    and no warnings. The text is cut before it is carried along, so long texts stay where they are.
    """
    origin = F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")
    kept = docs.select("doc_id", "text", origin.alias("source_file"), F.substring("text", 1, raw_chars).alias("raw_text"))
    found = validated_invoices(kept, as_of, zero_rate_is_zero)
    blank = _blank(F.col("raw_text"))
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id", "source_file", F.lit(TEXT_METHOD).alias("extraction_method"),
        F.when(blank, 0.0).otherwise(F.col("extraction_confidence")).alias("extraction_confidence"),
        *[F.when(~blank, F.col(c)).alias(c) for c in INVOICE],
        "raw_text",
        F.when(blank, F.array(F.lit(NO_TEXT))).otherwise(F.coalesce("errors", none)).alias("processing_errors"),
        F.when(blank, none).otherwise(F.coalesce("rule_warnings", none)).alias("warnings"),
        F.when(~blank, F.col("n_items")).alias("n_items"),
    )
