"""A sample invoice with every labelled field, end to end, and the choice among attempts."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billspark.functions.enrich import validate_and_clean
from billspark.functions.score import is_valid_invoice
from billspark.operators.attempts import select_attempt
from billspark.operators.stats import batch_statistics
from billspark.plans.extraction import extract_invoices, invoice_rows, process_documents, validated_invoices
from billspark.schemas import ATTEMPTS

SAMPLE = """HOLLOWAY GROUNDWORKS LTD
8 Quarry Lane
Leeds, LS1 4AP

INVOICE
Invoice Date: 22/11/2023
Invoice Number: INV-2023-{n:03d}

Bank Details:
Account Number: 40718293
Sort Code: 20-45-77

Contractor Details:
Name: Priya Nair
Phone: 07911 482605
Email: Priya.Nair@holloway.example.com
NI Number: QQ482605C
UTR: 8204619375

Work Items:
Plot 41 - Drainage runs - £2,100.00
Plot 42 - Kerbs and edging - £1,450.00
Plot 47 - Surfacing - £950.00

Operatives: Priya Nair, Tom Weller

Work Period: 06/11/2023 to 19/11/2023

Subtotal: £4,500.00
VAT @ 20%: £900.00
CIS Deduction: £900.00
Total Due: £4,500.00
"""


def docs(spark, n=1):
    return spark.createDataFrame([(i, SAMPLE.format(n=i)) for i in range(1, n + 1)], "doc_id bigint, text string")


def test_sample_fields(spark):
    r = extract_invoices(docs(spark)).first()
    assert r.invoice_number == "INV-2023-001"
    assert r.invoice_date == dt.date(2023, 11, 22)
    assert tuple(r.work_period) == (dt.date(2023, 11, 6), dt.date(2023, 11, 19))
    c = r.contractor
    assert (c.name, c.utr, c.ni_number, c.email) == ("HOLLOWAY GROUNDWORKS LTD", "8204619375", None, "priya.nair@holloway.example.com")
    assert c.phone == "07911 482605"
    assert tuple(c.address) == (None, "Leeds", "LS1 4AP", "UK")
    assert (c.bank_details.sort_code, c.bank_details.account_number) == ("20-45-77", "40718293")
    assert [(i.plot_number, i.amount) for i in r.work_items] == [("41", None), ("42", None), ("47", None)]
    f = r.financials
    assert (f.subtotal, f.vat_amount, f.vat_rate, f.cis_deduction, f.total_due) == tuple(D(x) for x in (4500, 900, 20, 900, 4500))
    assert r.extraction_confidence == pytest.approx(7.5 / 8.5)


def test_sample_validation(spark):
    r = validated_invoices(docs(spark), "2024-06-30").first()
    assert r.invoice_number == "2023-001"
    assert r.contractor.phone == "+447911482605"
    assert (r.errors, r.rule_warnings, r.valid) == ([], [], True)
    assert (r.financials.vat_code, r.financials.cis_code) == ("S", "L")
    late = validated_invoices(docs(spark), "2030-01-01").first()
    assert late.errors == [f"{f} is more than 5 years old" for f in ("invoice date", "period start", "period end")]


def test_batch_of_three(spark):
    results = process_documents(docs(spark, 3)).withColumn("file_type", F.lit("text"))
    rows = {r.file_type: r for r in batch_statistics(results).collect()}
    for r in rows.values():
        assert (r.total_files, r.successful, r.failed, r.success_rate) == (3, 3, 0, 1.0)
        assert r.avg_confidence == pytest.approx(7.5 / 8.5)
    assert set(rows) == {None, "text"}


def test_blank_and_empty(spark):
    blank = spark.createDataFrame([(1, "  \n "), (2, "nothing here 1")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in process_documents(blank).collect()}
    assert not got[1].success and got[1].errors == ["No text extracted from file"] * 2
    assert got[2].n_attempts == 2
    empty = docs(spark).limit(0)
    stats = batch_statistics(process_documents(empty).withColumn("file_type", F.lit("text")))
    assert [r.total_files for r in stats.collect() if r.file_type is None] == [0]


def test_rules_on_bad_amounts(spark):
    base = extract_invoices(docs(spark))
    fin = F.col("financials")
    bad = base.withColumn(
        "financials",
        fin.withField("subtotal", F.lit("-10").cast("decimal(24,6)")).withField("total_due", F.lit("2000000").cast("decimal(24,6)")),
    )
    r = validate_and_clean(bad, "2024-06-30").first()
    assert r.errors == ["Subtotal is negative"]
    assert r.rule_warnings == [
        "VAT amount doesn't match expected (-2.00)", "Total doesn't match expected calculation (-10.00)",
        "Total amount seems unusually large",
    ]


def test_zero_rate(spark):
    fin = F.col("financials")
    zero = extract_invoices(docs(spark)).withColumn(
        "financials", fin.withField("vat_rate", F.lit(0).cast("decimal(24,6)")).withField("vat_amount", F.lit(None).cast("decimal(24,6)"))
    )
    assert validate_and_clean(zero, "2024-06-30").first().financials.vat_amount == D("900.00")
    r = validate_and_clean(zero, "2024-06-30", zero_rate_is_zero=True).first()
    assert (r.financials.vat_amount, r.financials.vat_code) == (D("0.00"), "Z")


def test_validity(spark):
    df = extract_invoices(spark.createDataFrame([(1, "hello"), (2, SAMPLE.format(n=2))], "doc_id bigint, text string"))
    assert [r[0] for r in df.orderBy("doc_id").select(is_valid_invoice()).collect()] == [False, True]


CASES = {  # doc -> attempts as (success, confidence, error); what is chosen, warnings, errors
    1: ([(True, 0.2, None), (True, 0.5, None)], 1, [], []),
    2: ([(True, 0.5, None), (True, 0.9, None)], 0, [], []),
    3: ([(True, 0.2, None), (True, 0.2, None)], 0, ["Low confidence extraction"], []),
    4: ([(True, 0.0, None)], None, [], ["All extraction methods failed"]),
    5: ([(False, 0.0, "x"), (False, 0.0, "y")], None, [], ["x", "y"]),
}


def test_selection_cases(spark):
    rows = [
        (d, i, f"m{i}", ok, conf, err, 10) for d, (tries, *_) in CASES.items() for i, (ok, conf, err) in enumerate(tries)
    ]
    got = {r.doc_id: r for r in select_attempt(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    for d, (_, no, warnings, errors) in CASES.items():
        assert (got[d].attempt_no, got[d].warnings, got[d].errors) == (no, warnings, errors), d
    assert got[2].n_attempts == 1 and got[1].total_ms == 20


def test_invoice_rows_hold_what_went_wrong(spark):
    docs = spark.createDataFrame([(1, SAMPLE.format(n=7) + "x" * 6000, "a.txt"), (2, " \n", "b.txt"), (3, None, None)], "doc_id bigint, text string, path string")
    got = {r.doc_id: r for r in invoice_rows(docs, "2024-06-30").collect()}
    assert got[1].invoice_number == "2023-007" and got[1].source_file == "a.txt" and len(got[1].raw_text) == 5000
    assert got[1].extraction_method == "text_extraction" and got[1].extraction_confidence > 0
    for i in (2, 3):
        assert got[i].processing_errors == ["No text extracted from file"] and got[i].warnings == [] and got[i].extraction_confidence == 0
        assert got[i].invoice_number is None and got[i].work_items is None
    assert invoice_rows(docs.drop("path"), "2024-06-30").first().source_file is None
