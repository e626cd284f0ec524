"""Scalar rules on the cases listed in FIXTURES.md."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from billspark.functions import fields_loose, files, normalize as N, score, text as X, validate as R


def values(spark, column, inputs, kind="string"):
    """Results of a column rule over the inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_invoice_number(spark):
    got = values(spark, N.clean_invoice_number, ["Invoice # INV-001", "Inv: ABC123", "No: 12345", "  INV-2024-001  ", "", None])
    assert got == ["# INV-001", "ABC123", "12345", "2024-001", None, None]


def test_postcode_sort_code_email(spark):
    assert set(values(spark, N.clean_postcode, ["ec1a1bb", "EC1A 1BB", "EC1A1BB", "  ec1a 1bb  "])) == {"EC1A 1BB"}
    assert set(values(spark, N.clean_sort_code, ["123456", "12-34-56", "12 34 56"])) == {"12-34-56"}
    assert set(values(spark, N.clean_email, ["  Test@Example.COM  ", "mailto:test@example.com"])) == {"test@example.com"}
    assert values(spark, N.clean_phone, ["07700 900123", "447700900123", "123"]) == ["+447700900123", "+447700900123", "123"]


def test_money(spark):
    got = values(spark, N.parse_money, ["£7,500.00", "(12.50)", "-3", "7500.", ",", "1.2.3", "", None])
    assert got == [D("7500"), D("-12.5"), D("-3"), D("7500"), None, None, None, None]
    assert values(spark, N.clean_money, [D("2.345"), D("2.355")], "decimal(18,4)") == [D("2.34"), D("2.36")]


def test_dates(spark):
    good = ["15/01/2024", "01-12-2023", "2024/01/05", "5.1.24", "15/01/69", "January 5, 2024", "5 Jan 2024", "5 sep 2024"]
    assert values(spark, N.parse_date, good) == [
        dt.date(2024, 1, 15), dt.date(2023, 12, 1), dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(1969, 1, 15),
        dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 9, 5),
    ]
    assert values(spark, N.parse_date, ["32/01/2024", "15/13/2024", "invalid", "15012024", None]) == [None] * 5
    assert values(spark, N.parse_date_flexible, ["15012024", "20240115"]) == [dt.date(2024, 1, 15)] * 2


def test_title_case_and_text(spark):
    assert values(spark, N.clean_name, ["o'brien-smith  ltd"]) == ["O'Brien-Smith Ltd"]
    assert values(spark, X.clean_text, ["  a \x1c b\x00\r\n c ", "", None]) == ["a b c", "", ""]
    near = values(spark, lambda c: X.find_nearby_text(c, "VAT", 3), ["abcdefvatxyz VAT", "none"])
    assert near == [["defvatxyz", "yz VAT"], []]
    assert values(spark, lambda c: X.between_markers(c, "<<", ">>"), ["a << b >> c", "only"]) == ["b", "only"]


def test_validators(spark):
    assert values(spark, R.utr_errors, ["1234567890", "12345", ""]) == [[], ["UTR should be 10 digits, got 5"], []]
    assert values(spark, R.ni_errors, ["AB123456C", "INVALID", "GB123456Z"]) == [
        [], ["NI number format is invalid (should be XX123456X)"],
        ["NI number has invalid prefix: GB", "NI number has invalid suffix: Z"],
    ]
    emails = ["test@example.com", "not-an-email", "@nodomain.com", "spaces in@email.com"]
    assert values(spark, R.is_valid_email, emails) == [True, False, False, False]
    assert values(spark, R.is_valid_postcode, ["ec1a 1bb", "12345", None]) == [True, False, False]


def test_file_types(spark):
    names = ["a/b.pdf", "b.JPG", "b.jpeg", "b.png", "b.docx", "b.txt", "b.unknown", ".txt", "dir.pdf/noext"]
    assert values(spark, files.file_type_by_ext, names) == [
        "pdf", "image", "image", "image", "docx", "text", "unknown", "unknown", "unknown"
    ]
    bodies = [b"%PDF-1.4", b"\xff\xd8\xff\xe0", b"\x89PNG\r\n", b"GIF89a..", b"BM..", b"PK\x03\x04..word/document.xml", b"PK\x03\x04..", b"plain\n", "é".encode(), b""]
    assert values(spark, files.file_type_by_magic, bodies, "binary") == [
        "pdf", "image", "image", "image", "image", "docx", "unknown", "text", "unknown", "text"
    ]
    texts = ["é\r\nb".encode(), "é".encode("latin-1"), b"\xef\xbb\xbfhi"]
    assert values(spark, files.decode_text, texts, "binary") == ["é\nb", "é", "hi"]


def test_loose_rules(spark):
    block = "INVOICE\nAddress:\n\n12 Long Street\nab\nLondon EC1A 1BB\nmore text here"
    lines = lambda c: X.split_lines(c)
    assert values(spark, lambda c: fields_loose.address_block(lines(c)), [block, "none"]) == ["12 Long Street, London EC1A 1BB", ""]
    assert values(spark, lambda c: fields_loose.loose_name(lines(c)), ["Invoice 1\nBuild Ltd here", "invoice\nx 1\nabcd e"]) == ["Build Ltd here", "abcd e"]
    body = "Description of works\nBricks £1,200.50\nMortar\n£30\nSubtotal £1230.50\nafter £5"
    items = values(spark, lambda c: fields_loose.items_section(lines(c)), [body])[0]
    assert [(i.description, i.amount) for i in items] == [
        ("Bricks", D("1200.50")), ("Mortar", D("30.00")), ("Subtotal", D("1230.00")),
    ]
    short = values(spark, lambda c: fields_loose.items_section(lines(c), drop_terminator=True), [body])[0]
    assert [i.description for i in short] == ["Bricks", "Mortar"]
    pipe = values(spark, fields_loose.pipe_item, ["Consulting | 5 | 100", "x | 1", "y | -1 | 2"])
    assert [(p.description, p.valid) for p in pipe] == [("Consulting", True), ("x", False), ("y", False)]
    assert values(spark, fields_loose.intent_of_text, ["how much?", "Hey there", "bye"]) == ["help", "greeting", "other"]


@pytest.mark.parametrize("scores,want", [([0.9, 0.3], 0.75), ([], 0.0), ([0.0, 0.0], 0.0)])
def test_merge_confidence(spark, scores, want):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert df.agg(score.merge_confidence(F.col("s"))).first()[0] == pytest.approx(want)


def test_bands(spark):
    assert values(spark, score.accept_band, [0.9, 0.85, 0.6, 0.59], "double") == ["auto", "verify", "verify", "manual"]
