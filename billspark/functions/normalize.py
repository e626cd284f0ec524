"""Normalising columns: dates, money, identifiers, the whole nested invoice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.text import (
    blank_to_null, let_sql, normalize_whitespace, strip, title_case,
)

MONEY = "decimal(18,2)"
WIDE = "decimal(24,6)"


def _date_sql(compact: bool) -> str:
    """The format is chosen by the shape of the text, so no parser is tried in vain.

    Two-digit years pivot at 69: 69-99 are 19xx.
    """
    def read(fmt):
        return f"try_to_date(x, '{fmt}')"

    def short(fmt):
        day = read(fmt)
        return f"CASE WHEN year({day}) >= 2069 THEN add_months({day}, -1200) ELSE {day} END"

    shapes = []
    for sep in "/-.":
        e = f"[{sep}]"
        shapes += [
            (f"^[0-9]{{1,2}}{e}[0-9]{{1,2}}{e}[0-9]{{4}}$", read(f"d{sep}M{sep}yyyy")),
            (f"^[0-9]{{4}}{e}[0-9]{{1,2}}{e}[0-9]{{1,2}}$", read(f"yyyy{sep}M{sep}d")),
            (f"^[0-9]{{1,2}}{e}[0-9]{{1,2}}{e}[0-9]{{2}}$", short(f"d{sep}M{sep}yy")),
        ]
    for shape, long, brief in (
        ("^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}$", "MMMM d, yyyy", "MMM d, yyyy"),
        ("^[0-9]{1,2} [A-Za-z]+ [0-9]{4}$", "d MMMM yyyy", "d MMM yyyy"),
    ):
        shapes.append((shape, f"coalesce({read(long)}, {read(brief)})"))
    if compact:
        shapes.append(("^[0-9]{8}$", f"coalesce({read('ddMMyyyy')}, {read('yyyyMMdd')})"))
    return "CASE " + " ".join(f"WHEN x RLIKE '{p}' THEN {v}" for p, v in shapes) + " END"


_DATE_13, _DATE_15 = _date_sql(compact=False), _date_sql(compact=True)
_MONEY_SQL = (
    "if(x RLIKE '^[-(]', -1, 1) * try_cast(translate(x, '-()', '') AS decimal(24,6))"
)


def parse_date(c: Column) -> Column:
    """First of 13 formats that fits, day before month."""
    return let_sql(normalize_whitespace(c), _DATE_13)


def parse_date_flexible(c: Column) -> Column:
    """As ``parse_date`` plus the two compact forms; any letter case of month names."""
    return let_sql(normalize_whitespace(c), _DATE_15)


def parse_money(c: Column) -> Column:
    """Amount from text: currency signs, commas and blanks go; a leading - or ( is negative."""
    return let_sql(F.regexp_replace(c, r"[£$€,\s\p{Z}]", ""), _MONEY_SQL).cast(WIDE)


def parse_decimal_field(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[£$,]", "")).try_cast(WIDE)


def clean_money(c: Column) -> Column:
    """Two places, half to even."""
    return F.bround(c, 2).cast(MONEY)


def _unless_blank(c: Column, value: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", value)


def clean_invoice_number(c: Column) -> Column:
    one_line = normalize_whitespace(c)
    bare = F.regexp_replace(one_line, r"(?i)^(Invoice|Inv|No|Number|#)\s*[:\-]?\s*", "")
    return blank_to_null(F.upper(bare))


def clean_name(c: Column) -> Column:
    return _unless_blank(c, title_case(normalize_whitespace(c)))


def clean_address(c: Column) -> Column:
    return _unless_blank(c, F.regexp_replace(normalize_whitespace(c), r"\s*,\s*", ", "))


def clean_email(c: Column) -> Column:
    return _unless_blank(c, F.regexp_replace(strip(F.lower(c)), r"^mailto:", ""))


def clean_phone(c: Column) -> Column:
    d = F.regexp_replace(c, r"[^\d+]", "")
    plus = F.when(d.startswith("44") & (F.length(d) == 12), F.concat(F.lit("+"), d))
    home = F.when(
        d.startswith("0") & (F.length(d) == 11), F.concat(F.lit("+44"), F.substring(d, 2, 20))
    )
    return _unless_blank(c, F.coalesce(plus, home, d))


def clean_postcode(c: Column) -> Column:
    s = F.replace(F.upper(c), F.lit(" "), F.lit(""))
    spaced = F.regexp_replace(s, r"(?s)^(.+)(.{3})$", "$1 $2")
    return _unless_blank(c, F.when(F.length(s) >= 5, spaced).otherwise(s))


def digits_only(c: Column) -> Column:
    return _unless_blank(c, F.regexp_replace(c, r"\D", ""))


clean_utr = digits_only
clean_account = digits_only


def clean_ni(c: Column) -> Column:
    return _unless_blank(c, F.replace(F.upper(c), F.lit(" "), F.lit("")))


def clean_sort_code(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return _unless_blank(c, F.regexp_replace(d, r"^(\d{2})(\d{2})(\d{2})$", "$1-$2-$3"))


def normalize_code(c: Column) -> Column:
    """Tax codes: upper case, no outer blanks."""
    return F.upper(strip(c))


def customer_email(c: Column) -> Column:
    """Lower-cased address, or null when it has no '@'."""
    return F.when(c.contains("@"), F.lower(c))


def with_fields(struct: Column, **fields: Column) -> Column:
    out = struct
    for name, value in fields.items():
        out = out.withField(name, value)
    return F.when(struct.isNotNull(), out)


def _clean_items(items: Column) -> Column:
    return F.transform(
        items,
        lambda i: i.withField("amount", clean_money(i["amount"])).withField("unit_price", clean_money(i["unit_price"])),
    )


#: Cleaners of flat strict fields.
_FLAT_CLEANERS = {
    "invoice_number": clean_invoice_number, "contractor_name": clean_name, "email": clean_email, "phone": clean_phone,
    "utr": clean_utr, "ni_number": clean_ni, "postcode": clean_postcode, "sort_code": clean_sort_code,
    "account_number": clean_account, "work_items": _clean_items,
    **{n: clean_money for n in ("subtotal", "vat_amount", "cis_deduction", "total_due")},
}


def clean_flat(df):
    """``clean_invoice`` over flat strict fields: each is a column of its own, so those nobody reads are pruned."""
    return df.withColumns({n: clean(F.col(n)) for n, clean in _FLAT_CLEANERS.items()})


def clean_invoice(df):
    """All cleaners over the nested row. Null blocks stay null."""
    c = F.col("contractor")
    address = with_fields(c["address"], postcode=clean_postcode(c["address"]["postcode"]))
    bank = with_fields(
        c["bank_details"],
        sort_code=clean_sort_code(c["bank_details"]["sort_code"]),
        account_number=clean_account(c["bank_details"]["account_number"]),
    )
    fin = F.col("financials")
    return df.withColumns(
        {
            "invoice_number": clean_invoice_number(F.col("invoice_number")),
            "contractor": with_fields(
                c,
                name=clean_name(c["name"]),
                email=clean_email(c["email"]),
                phone=clean_phone(c["phone"]),
                utr=clean_utr(c["utr"]),
                ni_number=clean_ni(c["ni_number"]),
                address=address,
                bank_details=bank,
            ),
            "financials": with_fields(
                fin,
                subtotal=clean_money(fin["subtotal"]),
                vat_amount=clean_money(fin["vat_amount"]),
                cis_deduction=clean_money(fin["cis_deduction"]),
                total_due=clean_money(fin["total_due"]),
                vat_code=normalize_code(fin["vat_code"]),
                cis_code=normalize_code(fin["cis_code"]),
            ),
            "work_items": _clean_items(F.col("work_items")),
        }
    )
