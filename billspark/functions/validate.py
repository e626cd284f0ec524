"""Validation columns (V1-V10). Each rule gives an array of messages; empty input is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V

RATE = "decimal(7,4)"


def _messages(*rules: tuple[Column, Column | str]) -> Column:
    """Messages of the rules that hold, in order."""
    return F.array_compact(
        F.array(*[F.when(test, F.lit(m) if isinstance(m, str) else m) for test, m in rules])
    ).cast("array<string>")


def _given(c: Column, messages: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(c, F.lit("")) != "", messages).otherwise(empty)


def number_errors(c: Column) -> Column:
    return _given(
        c,
        _messages(
            (F.length(c) < 3, "Invoice number seems too short"),
            (F.length(c) > 50, "Invoice number seems too long"),
            (c.rlike(r"(?i)[^A-Z0-9\-/]"), "Invoice number contains unusual characters"),
        ),
    )


def date_errors(c: Column, field_name: str, as_of: Column) -> Column:
    return _messages(
        (c > as_of, f"{field_name} is in the future"),
        (c < F.date_sub(as_of, V.MAX_AGE_DAYS), f"{field_name} is more than 5 years old"),
    )


def utr_errors(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\D", ""))
    return _given(
        c, _messages((n != 10, F.concat(F.lit("UTR should be 10 digits, got "), n.cast("string"))))
    )


def is_valid_utr(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"\D", "")) == 10, F.lit(False))


def _ni(c: Column) -> Column:
    return F.replace(F.upper(c), F.lit(" "), F.lit(""))


def ni_errors(c: Column) -> Column:
    ni = _ni(c)
    prefix = F.substring(ni, 1, 2)
    suffix = F.substring(ni, -1, 1)
    return _given(
        c,
        _messages(
            (~ni.rlike(V.NI_FORMAT), "NI number format is invalid (should be XX123456X)"),
            (
                prefix.isin(V.NI_BAD_PREFIXES),
                F.concat(F.lit("NI number has invalid prefix: "), prefix),
            ),
            (
                ~suffix.isin(list(V.NI_GOOD_SUFFIXES)),
                F.concat(F.lit("NI number has invalid suffix: "), suffix),
            ),
        ),
    )


def is_valid_ni(c: Column) -> Column:
    return F.coalesce(_ni(c).rlike(V.NI_FORMAT), F.lit(False))


def email_errors(c: Column) -> Column:
    return _given(c, _messages((~c.rlike(V.EMAIL_FORMAT), "Email format is invalid")))


def is_valid_email(c: Column) -> Column:
    return F.coalesce(c.rlike(V.EMAIL_FORMAT), F.lit(False))


def postcode_errors(c: Column) -> Column:
    bare = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    return _given(c, _messages((~bare.rlike(V.POSTCODE_FORMAT), "Postcode format is invalid")))


def is_valid_postcode(c: Column) -> Column:
    bare = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    return F.coalesce(bare.rlike(V.POSTCODE_FORMAT), F.lit(False))


def sort_code_errors(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\D", ""))
    text = F.concat(F.lit("Sort code should be 6 digits, got "), n.cast("string"))
    return _given(c, _messages((n != 6, text)))


def account_errors(c: Column) -> Column:
    n = F.length(F.regexp_replace(c, r"\D", ""))
    text = F.concat(F.lit("Account number should be 6-8 digits, got "), n.cast("string"))
    return _given(c, _messages(((n < 6) | (n > 8), text)))


def effective_rate(rate: Column, zero_rate_is_zero: bool = False) -> Column:
    """A missing rate is 20; so is an explicit zero unless ``zero_rate_is_zero``."""
    if zero_rate_is_zero:
        return F.coalesce(rate, F.lit(20)).cast(RATE)
    return F.coalesce(F.when(rate != 0, rate), F.lit(20)).cast(RATE)


def expected_vat(subtotal: Column, rate: Column, zero_rate_is_zero: bool = False) -> Column:
    share = effective_rate(rate, zero_rate_is_zero) * F.lit("0.01").cast("decimal(3,2)")
    return subtotal * share


def _two_places(c: Column) -> Column:
    return F.bround(c, 2).cast("decimal(30,2)").cast("string")


def financial_errors(fin: Column | dict[str, Column]) -> Column:
    return _messages(
        (fin["subtotal"] < 0, "Subtotal is negative"),
        (fin["total_due"] < 0, "Total due is negative"),
        (fin["vat_amount"] < 0, "VAT amount is negative"),
    )


def financial_warnings(fin: Column | dict[str, Column], zero_rate_is_zero: bool = False) -> Column:
    vat = expected_vat(fin["subtotal"], fin["vat_rate"], zero_rate_is_zero)
    zero = F.lit(0).cast("decimal(24,6)")
    total = (
        fin["subtotal"] + F.coalesce(fin["vat_amount"], zero) - F.coalesce(fin["cis_deduction"], zero)
    )
    tolerance = F.lit(V.AMOUNT_TOLERANCE).cast("decimal(3,2)")
    return _messages(
        (
            F.abs(fin["vat_amount"] - vat) > tolerance,
            F.concat(F.lit("VAT amount doesn't match expected ("), _two_places(vat), F.lit(")")),
        ),
        (
            F.abs(fin["total_due"] - total) > tolerance,
            F.concat(
                F.lit("Total doesn't match expected calculation ("), _two_places(total), F.lit(")")
            ),
        ),
        (
            fin["total_due"] > F.lit(V.LARGE_TOTAL).cast("decimal(24,6)"),
            "Total amount seems unusually large",
        ),
    )


def invoice_errors(row: dict[str, Column], as_of: str) -> Column:
    """Messages on the fields of a row, rules in fixed order; ``row`` as ``validate_invoice`` makes it."""
    day = F.lit(as_of).cast("date")
    return F.concat(
        number_errors(row["invoice_number"]),
        date_errors(row["invoice_date"], "invoice date", day),
        date_errors(row["start_date"], "period start", day),
        date_errors(row["end_date"], "period end", day),
        _messages((row["start_date"] > row["end_date"], "Period start date is after end date")),
        utr_errors(row["utr"]),
        ni_errors(row["ni_number"]),
        email_errors(row["email"]),
        postcode_errors(row["postcode"]),
        sort_code_errors(row["sort_code"]),
        account_errors(row["account_number"]),
        financial_errors(row),
    )


def validate_invoice(df: DataFrame, as_of: str, zero_rate_is_zero: bool = False) -> DataFrame:
    """Adds ``valid``, ``errors`` and ``rule_warnings`` over the nested row, rules in fixed order."""
    period, c, fin = F.col("work_period"), F.col("contractor"), F.col("financials")
    row = {
        **{n: F.col(n) for n in ("invoice_number", "invoice_date")}, **{n: period[n] for n in ("start_date", "end_date")},
        **{n: c[n] for n in ("utr", "ni_number", "email")}, "postcode": c["address"]["postcode"],
        **{n: c["bank_details"][n] for n in ("sort_code", "account_number")},
        **{n: fin[n] for n in ("subtotal", "vat_amount", "total_due")},
    }
    return (
        df.withColumn("errors", invoice_errors(row, as_of))
        .withColumn("rule_warnings", financial_warnings(fin, zero_rate_is_zero))
        .withColumn("valid", F.size("errors") == 0)
    )


def strict_errors(row: dict[str, Column]) -> Column:
    """Design-level profile: exact formats, CIS as a rate of the subtotal, 1p tolerance."""
    tol = F.lit(V.STRICT_TOLERANCE).cast("decimal(3,2)")
    pct = F.lit("0.01").cast("decimal(3,2)")
    zero = F.lit(0).cast("decimal(24,6)")
    vat = row["subtotal"] * (row["vat_rate"].cast(RATE) * pct)
    cis = row["subtotal"] * (row["cis_rate"].cast(RATE) * pct)
    total = row["subtotal"] + F.coalesce(row["vat_amount"], zero) - F.coalesce(row["cis_deduction"], zero)
    return _messages(
        (~row["utr"].rlike(V.STRICT_UTR_FORMAT), "utr_number"),
        (~row["ni_number"].rlike(V.STRICT_NI_FORMAT), "ni_number"),
        (~row["sort_code"].rlike(V.STRICT_SORT_CODE_FORMAT), "sort_code"),
        (~row["account_number"].rlike(V.STRICT_ACCOUNT_FORMAT), "account_number"),
        (~row["email"].rlike(V.EMAIL_FORMAT), "email"),
        (~row["postcode"].rlike(V.STRICT_POSTCODE_FORMAT), "postcode"),
        (F.abs(row["vat_amount"] - vat) > tol, "vat_calculation"),
        (F.abs(row["cis_deduction"] - cis) > tol, "cis_calculation"),
        (F.abs(row["total_due"] - total) > tol, "total_calculation"),
    )


# ---- fixed values: limits of the item-level model ------------------------------------------------
# field, kind, low, high, required
MODEL_LIMITS = [
    ("description", "length", 1, 500, True),
    ("quantity", "range", 0, None, False),
    ("unit_price", "range", 0, None, True),
    ("tax_rate", "range", 0, 100, False),
    ("customer_name", "length", 1, 200, True),
    ("customer_email", "length", None, 255, False),
    ("currency", "length", 3, 3, False),
    ("notes", "length", None, 2000, False),
    ("confidence", "range", 0, 1, False),
]


def limit_errors(columns: dict[str, Column], limits=MODEL_LIMITS) -> Column:
    """Predicates made from the limits table for the columns that are given."""
    rules = []
    for field, kind, low, high, required in limits:
        if field not in columns:
            continue
        value = columns[field]
        measure = F.length(value) if kind == "length" else value
        if required:
            rules.append((value.isNull(), f"{field}: missing"))
        if low is not None:
            rules.append((measure < low, f"{field}: below {low}"))
        if high is not None:
            rules.append((measure > high, f"{field}: above {high}"))
    return _messages(*rules)
