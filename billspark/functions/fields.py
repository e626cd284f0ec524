"""Field extraction, strict profile (X1-X13): labelled patterns over the collapsed text.

``extract_fields`` reads the text once per document in one projection; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.normalize import WIDE, parse_date_flexible, parse_money
from billspark.functions.text import (
    blank_to_null, clean_lines, clean_text, either_case, extract_pattern, from_at, is_plain, led, let, split_lines, strip,
)

#: The labelled patterns as they are searched: a letter is looked at before the labels are tried.
_INVOICE_NUMBER = led(V.INVOICE_NUMBER, "i")
_PERIOD_START, _PERIOD_END = led(V.PERIOD_START, "pw"), led(V.PERIOD_END, "pwt")
_UTR, _NI_NUMBER = led(V.UTR, "ut"), led(V.NI_NUMBER, "n")
_COMPANY_NUMBER, _PHONE = led(V.COMPANY_NUMBER, "c"), led(V.PHONE, "tpmc")
_SORT_CODE, _ACCOUNT_NUMBER = led(V.SORT_CODE, "s"), led(V.ACCOUNT_NUMBER, "a")
_DATE_LABELLED = [led(pattern, "id") for pattern in V.DATE_LABELLED]
#: Every match of the patterns of amounts, rates and VAT numbers begins with one of these words; three letters are
#: looked at before the words are tried.
_AMOUNT_WORDS = (
    r"(?s)(?=[sntvcagbSNTVCAGB][ueoa.imrUEOAIMR][btaxsnolBTAXSNOL])(?:"
    + "|".join(either_case(w) for w in (
        "Sub", "Net", "Total", "VAT", "V.A.T", "Tax", "CIS", "Construction", "Amount", "Grand", "Balance",
    )) + ").*"
)


def amounts_part(clean: Column) -> Column:
    """The text from the first word that can label an amount, as a rule its end: the patterns read only that."""
    return F.regexp_extract(clean, _AMOUNT_WORDS, 0)


def _plain_amount(c: Column) -> Column:
    """``parse_money`` for what the patterns of amounts let through: digits, commas and dots."""
    return F.replace(c, F.lit(","), F.lit("")).try_cast(WIDE)


def _once(clean: Column, pattern: str, group: int = 1) -> Column:
    """``extract_pattern`` for patterns that are tried only when others gave nothing: searched once."""
    return let(strip(F.regexp_extract(clean, pattern, group)), blank_to_null)


def invoice_number(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _INVOICE_NUMBER)


def invoice_date(clean: Column) -> Column:
    """First labelled pattern whose text parses."""
    return F.coalesce(*[parse_date_flexible(_once(clean, p)) for p in _DATE_LABELLED])


def _period(start: Column, end: Column) -> Column:
    return F.struct(parse_date_flexible(start).alias("start_date"), parse_date_flexible(end).alias("end_date"))


def work_period(clean: Column, take=extract_pattern) -> Column:
    """Labelled start and end, else the two ends of the first range that has a date."""
    labelled = F.struct(take(clean, _PERIOD_START).alias("s"), take(clean, _PERIOD_END).alias("e"))
    range_ends = F.struct(
        F.regexp_extract(clean, V.DATE_RANGE, 1).alias("s"), F.regexp_extract(clean, V.DATE_RANGE, 2).alias("e")
    )
    ranged = let(
        range_ends,
        lambda r: let(
            _period(blank_to_null(strip(r["s"])), blank_to_null(strip(r["e"]))),
            lambda d: F.when(d["start_date"].isNotNull() | d["end_date"].isNotNull(), d),
        ),
    )
    return let(
        labelled,
        lambda p: F.when(p["s"].isNotNull() | p["e"].isNotNull(), _period(p["s"], p["e"])).otherwise(ranged),
    )


def utr(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _UTR)


def ni_number(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _NI_NUMBER)


def vat_number(clean: Column, take=extract_pattern) -> Column:
    return take(clean, V.VAT_NUMBER)


def company_number(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _COMPANY_NUMBER)


def email(clean: Column, take=extract_pattern) -> Column:
    return F.lower(take(from_at(clean), V.EMAIL, 0))


def phone(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _PHONE)


def postcode(clean: Column, take=extract_pattern) -> Column:
    return F.upper(take(clean, V.POSTCODE))


def city(clean: Column, take=extract_pattern) -> Column:
    return take(clean, V.CITY)


def address(clean: Column) -> Column:
    return F.struct(
        F.lit(None).cast("string").alias("street"), city(clean).alias("city"),
        postcode(clean).alias("postcode"), F.lit("UK").alias("country"),
    )


def sort_code(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _SORT_CODE)


def account_number(clean: Column, take=extract_pattern) -> Column:
    return take(clean, _ACCOUNT_NUMBER)


def subtotal(clean: Column, take=extract_pattern) -> Column:
    return _plain_amount(take(clean, V.SUBTOTAL))


def vat_amount(clean: Column, take=extract_pattern) -> Column:
    return _plain_amount(take(clean, V.VAT_AMOUNT))


def vat_rate(clean: Column, take=extract_pattern) -> Column:
    return _plain_amount(take(clean, V.VAT_RATE))


def cis_deduction(clean: Column, take=extract_pattern) -> Column:
    return _plain_amount(take(clean, V.CIS_DEDUCTION))


def total_due(clean: Column, take=extract_pattern) -> Column:
    return _plain_amount(take(clean, V.TOTAL_DUE))


def all_amounts(text: Column) -> Column:
    """Every amount with two decimal places."""
    found = F.regexp_extract_all(text, F.lit(V.MONEY_2DP), F.lit(0))
    return F.filter(F.transform(found, parse_money), lambda x: x.isNotNull())


def _name_from_patterns(clean: Column, patterns: list[str], exclude: bool) -> Column:
    found = []
    for p in patterns:
        name = _once(clean, p)
        if exclude:
            name = F.when(~F.lower(name).rlike("|".join(V.NAME_EXCLUDED_WORDS)), name)
        found.append(name)
    return F.coalesce(*found)


def contractor_name(lines_text: Column, clean: Column, paged: bool = False) -> Column:
    """Company line among the first five, else labelled patterns (``paged``: patterns only)."""
    if paged:
        return _name_from_patterns(clean, V.NAME_PATTERNS_PAGED, exclude=False)
    head = F.transform(split_lines(F.substring_index(lines_text, "\n", 5)), strip)
    company = F.filter(
        head,
        lambda x: x.rlike(V.COMPANY_WORD)
        & (F.length(x) > 3)
        & ~F.lower(x).startswith("invoice"),
    )
    return F.coalesce(
        F.try_element_at(company, F.lit(1)),
        _name_from_patterns(clean, V.NAME_PATTERNS_TEXT, exclude=True),
    )


def extract_flat(df: DataFrame, text: str = "text", paged: bool = False) -> DataFrame:
    """All strict fields as flat columns beside the input columns (text stays)."""
    df, plain = df.withColumn("_plain", is_plain(F.col(text))), F.col("_plain")
    df = df.withColumns({"_clean": clean_text(F.col(text), plain), "_lined": clean_lines(F.col(text), plain)}).drop("_plain")
    df = df.withColumn("_amounts", amounts_part(F.col("_clean")))
    c, amounts = F.col("_clean"), F.col("_amounts")
    raw: dict[str, Column] = {}

    def take(clean: Column, pattern: str, group: int = 1) -> Column:
        """One search per pattern, in a projection of its own; the fields read its column."""
        name = f"_raw_{len(raw)}"
        raw[name] = strip(F.regexp_extract(clean, pattern, group))
        return blank_to_null(F.col(name))

    fields = {
        "invoice_number": invoice_number(c, take),
        "invoice_date": invoice_date(c),
        "work_period": work_period(c, take),
        "contractor_name": contractor_name(F.col("_lined"), c, paged),
        **{f.__name__: f(c, take) for f in (
            utr, ni_number, company_number, email, phone, postcode, city, sort_code, account_number,
        )},
        **{f.__name__: f(amounts, take) for f in (
            vat_number, subtotal, vat_amount, vat_rate, cis_deduction, total_due,
        )},
    }
    return df.withColumns(raw).withColumns(fields).drop("_amounts", *raw)


def has_contractor(name: Column | None = None) -> Column:
    """Whether a flat row has a contractor block; ``name``: read in another way than its ``contractor_name``."""
    name = F.col("contractor_name") if name is None else name
    return name.isNotNull() | F.col("utr").isNotNull() | F.col("email").isNotNull()


def has_money() -> Column:
    """Whether a flat row has a block of financials."""
    zero = F.lit(0).cast(WIDE)
    return (F.coalesce("subtotal", zero) != 0) | (F.coalesce("total_due", zero) != 0)


def flat_row(name: Column | None = None) -> dict[str, Column]:
    """What the scores and predicates read, from flat columns: as the nested row would hold it."""
    name = F.col("contractor_name") if name is None else name
    amounts = {n: F.when(has_money(), F.col(n)) for n in ("subtotal", "vat_amount", "total_due")}
    return {
        "invoice_number": F.col("invoice_number"), "invoice_date": F.col("invoice_date"), "name": name,
        "street": F.lit(None).cast("string"), "utr": F.col("utr"), **amounts, "has_contractor": has_contractor(name),
        "has_financials": has_money(), "n_items": F.col("n_items"),
    }


def nest(df: DataFrame, contractor_there: Column | None = None, money_there: Column | None = None) -> DataFrame:
    """Flat strict fields -> nested contractor and financials blocks, null when nothing was found.

    Whether it was: told by the caller, else by the fields. Tax codes are columns of ``df`` or none.
    """
    contractor_there = has_contractor() if contractor_there is None else contractor_there
    money_there = has_money() if money_there is None else money_there
    codes = {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in ("vat_code", "cis_code")}
    bank = F.struct(
        F.lit(None).cast("string").alias("account_name"), F.col("account_number"),
        F.col("sort_code"), F.lit(None).cast("string").alias("iban"),
        F.lit(None).cast("string").alias("swift"),
    )
    has_bank = F.col("sort_code").isNotNull() | F.col("account_number").isNotNull()
    contractor = F.struct(
        F.col("contractor_name").alias("name"),
        F.struct(
            F.lit(None).cast("string").alias("street"), F.col("city"), F.col("postcode"),
            F.lit("UK").alias("country"),
        ).alias("address"),
        F.col("email"), F.col("phone"), F.col("utr"), F.col("ni_number"), F.col("vat_number"),
        F.col("company_number"), F.when(has_bank, bank).alias("bank_details"),
    )
    financials = F.struct(
        F.col("subtotal"), F.col("vat_amount"), codes["vat_code"].alias("vat_code"),
        F.coalesce("vat_rate", F.lit(20).cast(WIDE)).alias("vat_rate"), F.col("cis_deduction"),
        codes["cis_code"].alias("cis_code"), F.col("total_due"),
        F.lit("GBP").alias("currency"),
    )
    nested = df.withColumns(
        {"contractor": F.when(contractor_there, contractor), "financials": F.when(money_there, financials)}
    )
    return nested.drop(
        "contractor_name", "utr", "ni_number", "vat_number", "company_number", "email", "phone",
        "postcode", "city", "sort_code", "account_number", "subtotal", "vat_amount", "vat_rate",
        "cis_deduction", "total_due", *[n for n in codes if n in df.columns],
    )


