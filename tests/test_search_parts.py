"""Searches that look at less text: the same results as the plain patterns over the whole text, and what is pruned."""

import random

import pytest
from pyspark.sql import functions as F

from billspark.functions import fields, fixed_values as V
from billspark.functions.enrich import validate_and_clean
from billspark.functions.text import clean_lines, clean_text, extract_pattern
from billspark.functions.text import CONTROL, _RUNS, strip
from billspark.operators.items import item_count, plot_labels, plots_part, work_items
from billspark.operators.attempts import select_attempt, union_attempts
from billspark.plans.extraction import INVOICE, as_attempts, extract_flat_invoices, extract_invoices, invoice_rows, process_documents, validated_invoices

BITS = [
    "Invoice No", "invoice\tnumber: ", "INV-12/a", "Date: ", "dated ", "01/02/2003", "3-4-99", "5 March 2001", "Period start ", "week ending: ", "Work Period",
    "to ", "TO:", "UTR", "Unique Taxpayer Reference # ", "Tax Ref", "1234567890", "NI", "N.I.", "national insurance", "AB 12 34 56 C", "VAT", "V.A.T",
    "GB 123456789", "Company Reg", "co no", "12345678", "@", "a.b@c.de", "x@", "Mail:me@host.example.org", "Tel", "mob: ", "+44 (0) 20 7946 0000", "Sort Code",
    "sc", "12-34-56", "A/C ", "Acc No", "Account #", "Subtotal: £", "nett", "total before vat", "1,234.50", "7", "@ 20%", "at 5.5 %", "CIS deducted -",
    "construction industry scheme", "Amount Due", "grand total", "Balance Due €", "Plot 7a", "PROPERTY: 12", "unit #3", "house 1", "Operative: Ann Lee", "Name Bo Ray",
    "İ", "ſc", "K", " ", "\x00", "\x1c", "\r\n", "\r", "\n", "\n\n\n\n", "   ", "\xa0", "é", " ", " ", "\n", "Ltd", "London",
]


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice(BITS) for _ in range(rng.randrange(0, 60))),) for _ in range(1500)] + [(None,), ("",)]
    return spark.createDataFrame(rows, "t string").cache()


def differing(df, got, wanted):
    return df.select("t", got.alias("got"), wanted.alias("wanted")).filter(~F.col("got").eqNullSafe(F.col("wanted"))).count()


@pytest.mark.parametrize("name, pattern, group", [
    ("invoice_number", V.INVOICE_NUMBER, 1), ("utr", V.UTR, 1), ("ni_number", V.NI_NUMBER, 1), ("company_number", V.COMPANY_NUMBER, 1),
    ("phone", V.PHONE, 1), ("sort_code", V.SORT_CODE, 1), ("account_number", V.ACCOUNT_NUMBER, 1), ("email", V.EMAIL, 0),
])
def test_fields_are_those_of_the_plain_patterns(odd_texts, name, pattern, group):
    wanted = extract_pattern(F.col("t"), pattern, group)
    assert differing(odd_texts, getattr(fields, name)(F.col("t")), F.lower(wanted) if name == "email" else wanted) == 0


def test_amounts_are_found_in_their_part(odd_texts):
    part = fields.amounts_part(F.col("t"))
    for pattern in (V.SUBTOTAL, V.VAT_AMOUNT, V.VAT_RATE, V.CIS_DEDUCTION, V.TOTAL_DUE, V.VAT_NUMBER):
        assert differing(odd_texts, extract_pattern(part, pattern), extract_pattern(F.col("t"), pattern)) == 0
    for name, pattern in (("subtotal", V.SUBTOTAL), ("vat_amount", V.VAT_AMOUNT), ("vat_rate", V.VAT_RATE), ("total_due", V.TOTAL_DUE)):
        wanted = fields.parse_money(extract_pattern(F.col("t"), pattern))
        assert differing(odd_texts, getattr(fields, name)(F.col("t")), wanted) == 0


def test_cleaning_is_that_of_the_slower_patterns(odd_texts):
    t = F.coalesce(F.col("t"), F.lit(""))
    careful = F.trim(F.regexp_replace(F.regexp_replace(t, _RUNS, " "), CONTROL, ""))
    assert differing(odd_texts, clean_text(F.col("t")), careful) == 0
    lines = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), CONTROL, ""), r"\n{3,}", "\n\n"))
    assert differing(odd_texts, clean_lines(F.col("t")), lines) == 0


def test_items_from_the_part_with_plots(odd_texts):
    t = F.col("t")
    df = odd_texts.withColumn("p", plots_part(t)).withColumn("l", plot_labels(F.col("p")))
    whole, part = F.col("w"), F.col("i")
    df = df.select("t", work_items(t).alias("w"), work_items(t, F.col("p"), F.col("l")).alias("i"), item_count(t, F.col("l")).alias("n"))
    assert df.filter(~whole.eqNullSafe(part) | ~F.size(whole).eqNullSafe(F.col("n"))).count() == 0


def test_scores_read_only_their_fields(spark, odd_texts):
    """Out of a nested block nothing is pruned: a reader of the score alone had every pattern searched."""
    docs = odd_texts.select(F.lit(1).alias("doc_id"), F.col("t").alias("text"))
    plan = extract_invoices(docs).select("extraction_confidence")._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("Sort", "Account", "Phone", "period", "Construction.s"):
        assert pattern not in plan.replace("Construction|Amount", ""), pattern


def test_flat_and_nested_scores_agree(odd_texts):
    from billspark.functions.score import completeness, extraction_confidence, is_valid_invoice

    docs = odd_texts.filter("t is not null").select(F.monotonically_increasing_id().alias("doc_id"), F.col("t").alias("text"), "t")
    flat = extract_flat_invoices(docs).select(
        "doc_id", F.col("extraction_confidence").alias("a"), extraction_confidence(F.col("t"), fields.flat_row()).alias("b"),
        is_valid_invoice(fields.flat_row()).alias("c"),
    )
    nested = extract_invoices(docs).select(
        F.col("doc_id").alias("id"), completeness().alias("x"), extraction_confidence(F.col("t")).alias("y"), is_valid_invoice().alias("z")
    )
    both = flat.join(nested, F.col("doc_id") == F.col("id"))
    assert both.count() == docs.count()
    assert both.filter("not (a <=> x and b <=> y and c <=> z)").count() == 0


LOOSE_BITS = BITS + [
    "address:", "From: ", "contractor address", "High Street", "Oak Road 4", "EC1A 1BB", "Email", "Invoice", "Smith & Co", "Ann Lee", "Build Ltd", "sub-total ",
    "tax: £", "deduction ", "amount due: £", "12.30", "1.2", "$ 5", "GBP", "EUR 7.00", "total: $1,000.25", "due ¥3.10", "balance  due: 9.99", "\n", "\n", "\n",
]


@pytest.fixture(scope="module")
def loose_texts(spark):
    rng = random.Random(11)
    rows = [("".join(rng.choice(LOOSE_BITS) for _ in range(rng.randrange(0, 60))),) for _ in range(1500)] + [(None,), ("",)]
    return spark.createDataFrame(rows, "t string").cache()


def test_loose_fields_are_those_of_the_plain_patterns(loose_texts):
    from billspark.functions import fields_loose as loose

    t = F.col("t")
    out = loose.loose_fields(loose_texts.withColumn("text", t)).cache()
    zero = F.lit(0).cast("decimal(18,2)")
    for name, pattern in (("subtotal", V.LOOSE_SUBTOTAL), ("vat_amount", V.LOOSE_VAT), ("cis_amount", V.LOOSE_CIS)):
        wanted = F.coalesce(F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit("")).try_cast("decimal(18,2)"), zero)
        assert differing(out, F.col(name), wanted) == 0, name
    assert differing(out, F.col("contractor_email"), F.coalesce(F.regexp_extract(t, V.LOOSE_EMAIL, 0), F.lit(""))) == 0
    dates = F.transform(F.regexp_extract_all(t, F.lit(V.LOOSE_DATE), F.lit(0)), lambda d: F.replace(d, F.lit("-"), F.lit("/")))
    assert differing(out, F.col("invoice_date"), F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit(""))) == 0
    assert differing(out, F.col("contractor_address"), loose.address_block(F.split(t, "\n", -1))) == 0


def test_generic_invoice_is_that_of_the_plain_patterns(loose_texts):
    from billspark.functions import fields_loose as loose

    t = F.col("t")
    out = loose.generic_invoice(loose_texts.withColumn("text", t)).select("t", "total_amount", "currency", "vendor_name").cache()
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in V.GENERIC_AMOUNT])
    amounts = F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(18,2)")), lambda x: x.isNotNull())
    assert differing(out, F.col("total_amount"), F.array_max(amounts)) == 0
    currency = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 0), F.lit("")) for p in V.GENERIC_CURRENCY])
    assert differing(out, F.col("currency"), currency) == 0
    lines = F.filter(F.transform(F.split(t, "\n", -1), strip), lambda x: x != "")
    first = F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(V.GENERIC_VENDOR))
    vendor = F.coalesce(F.try_element_at(first, F.lit(1)), F.substring(F.try_element_at(lines, F.lit(1)), 1, 100))
    assert differing(out, F.col("vendor_name"), vendor) == 0


def test_lines_after_the_name_are_not_split_into_words(spark):
    """The first line is the name: the work on the second and later lines is a branch of its own."""
    from billspark.functions import fields_loose as loose

    df = spark.createDataFrame([("a",)], "t string").select(loose.loose_name(F.split("t", "\n", -1)))
    assert df._jdf.queryExecution().analyzed().toString().count("slice(") >= 2


def test_dates_and_amounts_with_a_letter_first(odd_texts, loose_texts):
    from billspark.functions import fields_loose as loose

    pairs = [(fields._PERIOD_START, V.PERIOD_START), (fields._PERIOD_END, V.PERIOD_END), *zip(fields._DATE_LABELLED, V.DATE_LABELLED)]
    for led, plain in pairs:
        assert differing(odd_texts, extract_pattern(F.col("t"), led), extract_pattern(F.col("t"), plain)) == 0, plain
    part = F.regexp_extract(F.col("t"), loose._LOOSE_WORDS, 0)
    assert differing(loose_texts, F.regexp_extract(part, loose._LOOSE_AMOUNTS["total"], 1), F.regexp_extract("t", V.LOOSE_TOTAL, 1)) == 0


def _in_order(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_two_attempts_in_one_projection_choose_as_the_attempts_gathered_do(spark, odd_texts):
    """Names only the paged rules find, texts that fail both, low scores, blanks, at three thresholds."""
    more = spark.createDataFrame(
        [("From: address 12",), ("contractor\nAcme Works 4\nSubtotal: £5",), ("1 Details\n-",), ("12 34",), (" \n",)], "t string"
    )
    docs = odd_texts.unionByName(more).select(F.monotonically_increasing_id().alias("doc_id"), F.col("t").alias("text")).cache()
    both = union_attempts([as_attempts(docs, "text_extraction"), as_attempts(docs, "paged_extraction", paged=True)]).cache()
    methods = set()
    for threshold in (0.05, 0.3, 0.9):
        want = select_attempt(both, "doc_id", INVOICE, threshold)
        got = process_documents(docs, threshold=threshold)
        assert got.columns == want.columns
        assert _in_order(got) == _in_order(want)
        methods |= {(r.best_method, r.n_attempts, bool(r.warnings)) for r in got.collect()}
    assert {("paged_extraction", 2, False), ("paged_extraction", 2, True), ("text_extraction", 2, True), (None, 2, False)} <= methods


def test_processing_neither_writes_nor_shuffles_and_reads_what_is_asked_for(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Plot 7a\n")], "doc_id bigint, text string")
    plan = process_documents(docs).select("doc_id", "success", "confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "attempts-" not in plan and "Sort" not in plan
    assert "aggregate(zip_with" not in plan and fields._PHONE not in plan


def test_invoices_validated_flat_are_those_validated_nested(spark, odd_texts):
    more = spark.createDataFrame(
        [("NI: AB123456Z Sort Code: 12-34-56 Tel 020 7946 0000",), ("VAT: 5 CIS: 3",), ("Ann Ltd\nSubtotal: 100 VAT @ 0%: 2 Total Due: 7",)], "t string"
    )
    docs = odd_texts.unionByName(more).select(F.monotonically_increasing_id().alias("doc_id"), F.col("t").alias("text")).cache()
    for zero in (False, True):
        want = validate_and_clean(extract_invoices(docs), "2001-12-31", zero_rate_is_zero=zero)
        got = validated_invoices(docs, "2001-12-31", zero)
        assert set(got.columns) == {*want.columns, "n_items"}
        assert got.select(want.columns).dtypes == want.dtypes
        assert _in_order(got.select(want.columns)) == _in_order(want)
    assert got.filter("n_items <> size(work_items)").count() == 0


def test_invoice_rows_read_what_is_asked_for(spark):
    docs = spark.createDataFrame([(1, "Plot 7a\n")], "doc_id bigint, text string")
    plan = invoice_rows(docs, "2001-12-31").select("invoice_number", "n_items", "processing_errors")._jdf.queryExecution().optimizedPlan().toString()
    assert fields._NI_NUMBER in plan
    assert "aggregate(zip_with" not in plan and fields._PHONE not in plan and "initcap" not in plan
