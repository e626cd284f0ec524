"""Other extraction profiles (X16-X22, W11, W12, O5, O6): unlabelled, generic, degraded, chat.

All rules read one document's text inside its own row; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.text import blank_to_null, from_at, led, let, split_lines, strip

MONEY = "decimal(18,2)"
#: The patterns of amounts as they are searched, and the text from the first word that can label one.
_LOOSE_AMOUNTS = {
    "subtotal": led(V.LOOSE_SUBTOTAL, "sn"), "vat_amount": led(V.LOOSE_VAT, "vt"), "cis_amount": led(V.LOOSE_CIS, "cd"),
    "total": led(V.LOOSE_TOTAL, "tag"),
}
_LOOSE_WORDS = r"(?is)(?=[snvtcdag])(?:subtotal|sub-total|net|vat|tax|cis|deduction|total|amount|grand).*"
_LOOSE_DATE, _CURRENCIES = rf"(?=\d){V.LOOSE_DATE}", [V.GENERIC_CURRENCY[0], rf"(?=[UEGJCA])(?:{V.GENERIC_CURRENCY[1]})"]
_GENERIC_AMOUNT = [led(V.GENERIC_AMOUNT[0], "tad"), V.GENERIC_AMOUNT[1], led(V.GENERIC_AMOUNT[2], "b")]


def _amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast(MONEY)


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _text(c: Column, pattern: str, group: int = 0) -> Column:
    """First match or '' (this profile uses empty strings, not nulls)."""
    return F.coalesce(F.regexp_extract(c, pattern, group), F.lit(""))


def loose_name(lines: Column) -> Column:
    """First of 20 lines that has a company word or looks like a name; else a first real line."""
    def named(line):
        lower = F.lower(strip(line))
        words = F.filter(F.split(strip(line), rf"{V.WS}+"), lambda w: w != "")
        # a word that starts with a letter must start with a capital
        capital = F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
        looks = F.size(words).between(2, 4) & capital
        return ~_any(lower, V.LOOSE_NAME_SKIP) & (_any(line, V.LOOSE_NAME_COMPANY) | looks)

    def fallback(line):
        s = strip(line)
        return (F.length(s) > 3) & ~_any(F.lower(s), V.LOOSE_NAME_FALLBACK_SKIP)

    # the first line is the name of most: the others are looked at only where it is not
    top, head = F.filter(F.slice(lines, 1, 1), named), F.filter(F.slice(lines, 2, 19), named)
    rest = F.filter(lines, fallback)
    return F.coalesce(strip(_first(top)), strip(_first(head)), strip(_first(rest)), F.lit(""))


def _address_line(s: Column) -> Column:
    """What a line is to the address block: skipped, kept, or the last one."""
    street = _any(s, V.ADDRESS_STREET_WORDS)
    ends = ~street & s.rlike(V.LOOSE_POSTCODE)
    keeps = street | ends | ((F.length(s) > 5) & ~_any(F.lower(s), V.ADDRESS_SKIP))
    return F.struct(keeps.alias("keeps"), ends.alias("ends"))


def address_block(lines: Column) -> Column:
    """Lines after an address marker, up to a blank line or the postcode line, joined by ', '."""
    start = F.struct(
        F.lit(False).alias("on"), F.lit(False).alias("done"),
        F.array().cast("array<string>").alias("kept"),
    )

    def step(acc, line):
        marker = _any(F.lower(line), V.ADDRESS_MARKERS)
        info = _address_line(line)
        blank = line == ""
        live = acc["on"] & ~acc["done"] & ~marker
        keep = live & ~blank & info["keeps"]
        done = acc["done"] | (live & blank & (F.size(acc["kept"]) > 0)) | (live & ~blank & info["ends"])
        return F.struct(
            (acc["on"] | marker).alias("on"), done.alias("done"),
            F.when(keep, F.array_append(acc["kept"], line)).otherwise(acc["kept"]).alias("kept"),
        )

    head = F.transform(F.slice(lines, 1, 30), strip)
    return F.array_join(F.aggregate(head, start, step, lambda a: a["kept"]), ", ")


def items_section(lines: Column, drop_terminator: bool = False) -> Column:
    """Items between a start marker and the first end marker, that line included.

    A description is the text before the amount, or else the line above.
    """
    # every line is marked once; what follows looks the marks up
    return let(_marked_lines(lines), lambda marked: _items_between(marked, drop_terminator))


def _marked_lines(lines: Column) -> Column:
    """The lines, and which of them are start markers and end markers."""

    def marks(x):
        return let(
            F.lower(strip(x)),
            lambda y: F.struct(_any(y, V.ITEMS_START).alias("starts"), _any(y, V.ITEMS_END).alias("ends")),
        )

    return F.struct(lines.alias("lines"), F.transform(lines, marks).alias("marks"))


def _items_between(marked: Column, drop_terminator: bool) -> Column:
    lines = marked["lines"]
    n = F.size(lines)
    marks = F.transform(marked["marks"], lambda m: m["starts"])
    begin = F.array_position(marks, True)
    # start-marker lines are skipped before they are looked at as ends
    ends = F.transform(marked["marks"], lambda m: m["ends"] & ~m["starts"])
    after = F.array_position(F.slice(ends, F.greatest(begin, F.lit(1)).cast("int") + 1, F.greatest(n, F.lit(1))), True)
    last = F.when(after > 0, begin + after).otherwise(n).cast("int")
    if drop_terminator:
        last = F.when(after > 0, last - 1).otherwise(last)
    numbers = F.when(
        (begin > 0) & (last > begin), F.sequence((begin + 1).cast("int"), last)
    ).otherwise(F.array().cast("array<int>"))

    def item(i):
        line = F.element_at(lines, i)
        amount = _amount(F.regexp_extract(line, V.LOOSE_AMOUNT, 1))
        before = strip(F.regexp_extract(line, rf"(?s)^(.*?){V.LOOSE_AMOUNT}", 1))
        above = F.when(i > 1, strip(F.element_at(lines, F.greatest(i - 1, F.lit(1)))))
        return F.struct(
            F.when(before != "", before).otherwise(F.coalesce(above, F.lit(""))).alias("description"),
            F.when(~F.element_at(marked["marks"], i)["starts"], amount).alias("amount"),
        )

    items = F.transform(numbers, item)
    return F.filter(items, lambda x: (x["amount"] > 0) & (x["description"] != ""))


def loose_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """Unlabelled profile: flat strings and amounts; the total is worked out when it is zero."""
    t = F.col(text)
    dates = F.transform(
        F.regexp_extract_all(t, F.lit(_LOOSE_DATE), F.lit(0)), lambda d: F.replace(d, F.lit("-"), F.lit("/"))
    )
    zero = F.lit(0).cast(MONEY)
    marked = _any(F.lower(t), V.ADDRESS_MARKERS)  # without a marker there is no address to look for

    def amount(name):
        return F.coalesce(_amount(F.regexp_extract("_amounts", _LOOSE_AMOUNTS[name], 1)), zero)

    out = df.withColumns({"_lines": split_lines(t), "_dates": dates, "_amounts": F.regexp_extract(t, _LOOSE_WORDS, 0)})
    out = out.withColumns(
        {
            "contractor_email": _text(from_at(t), V.LOOSE_EMAIL),
            "contractor_utr": _text(t, V.LOOSE_UTR),
            "contractor_ni": _text(t, V.LOOSE_NI),
            "sort_code": _text(t, V.LOOSE_SORT_CODE),
            "bank_account": _text(t, V.LOOSE_ACCOUNT),
            "invoice_number": _text(t, V.LOOSE_INVOICE_NUMBER, 1),
            "invoice_date": F.coalesce(F.try_element_at("_dates", F.lit(1)), F.lit("")),
            "work_start_date": F.coalesce(F.try_element_at("_dates", F.lit(2)), F.lit("")),
            "work_end_date": F.coalesce(F.try_element_at("_dates", F.lit(3)), F.lit("")),
            **{name: amount(name) for name in _LOOSE_AMOUNTS},
            "contractor_name": loose_name(F.col("_lines")),
            "contractor_address": F.when(t.isNull() | marked, address_block(F.col("_lines"))).otherwise(""),
            "work_items": items_section(F.col("_lines")),
        }
    ).drop("_lines", "_dates", "_amounts")
    worked_out = (F.col("subtotal") + F.col("vat_amount") - F.col("cis_amount")).cast(MONEY)
    return out.withColumn("total", F.when(F.col("total") == 0, worked_out).otherwise(F.col("total")))


def top_amounts(t: Column) -> Column:
    """Distinct labelled amounts, largest first."""
    found = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in _GENERIC_AMOUNT])
    amounts = F.filter(F.transform(found, _amount), lambda x: x.isNotNull())
    return F.sort_array(F.array_distinct(amounts), asc=False)


def cap_items(items: Column, limit: int = 20, width: int = 200) -> Column:
    """The first items with shortened descriptions, as a step of its own; the defaults are the known profile's."""
    return F.transform(F.slice(items, 1, limit), lambda x: x.withField("description", F.substring(x["description"], 1, width)))


def generic_items(t: Column) -> Column:
    """Items of the text: description, quantity, unit price, total; all of them (see ``cap_items``)."""
    lines = F.filter(F.transform(split_lines(t), strip), lambda x: F.length(x) >= 10)

    # one pass per line: the three groups come out side by side, a line without a match stays whole
    marked = rf"(?s)^{V.GENERIC_ITEM}.*\z"

    def item(line):
        return F.split(F.regexp_replace(line, marked, "$1\x01$2\x01$3"), "\x01")

    def typed(parts):
        quantity = F.try_element_at(parts, F.lit(2)).try_cast("bigint")
        price = _amount(F.try_element_at(parts, F.lit(3)))
        return F.struct(
            strip(parts[0]).alias("description"),
            quantity.alias("quantity"), price.alias("unit_price"),
            (quantity.cast("decimal(18,0)") * price).cast("decimal(28,2)").alias("total"),
        )

    found = F.filter(F.transform(lines, item), lambda p: F.size(p) == 3)
    return F.filter(F.transform(found, typed), lambda x: x["total"].isNotNull())


def generic_invoice(df: DataFrame, text: str = "text") -> DataFrame:
    """Vendor, number, dates, two largest amounts, currency mark, items, quarter confidence."""
    t = F.col(text)
    lines = F.filter(F.transform(split_lines(t), strip), lambda x: x != "")
    top = strip(F.substring_index(t, "\n", 1))
    vendor = F.coalesce(
        F.when((top != "") & top.rlike(V.GENERIC_VENDOR), top),  # most often; the other lines are made only without it
        _first(F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(V.GENERIC_VENDOR))),
        F.substring(_first(lines), 1, 100),
    )
    dates = F.regexp_extract_all(t, F.lit(V.GENERIC_DATE), F.lit(1))
    out = df.withColumns({"_dates": dates, "_amounts": top_amounts(t)}).withColumns(
        {
            "invoice_number": F.coalesce(
                *[blank_to_null(F.regexp_extract(t, p, 1)) for p in V.GENERIC_NUMBER]
            ),
            "invoice_date": F.try_element_at("_dates", F.lit(1)),
            "due_date": F.try_element_at("_dates", F.lit(2)),
            "total_amount": F.try_element_at("_amounts", F.lit(1)),
            "subtotal": F.try_element_at("_amounts", F.lit(2)),
            "currency": F.coalesce(
                *[blank_to_null(F.regexp_extract(t, p, 0)) for p in _CURRENCIES]
            ),
            "vendor_name": vendor,
            "line_items": generic_items(t),
        }
    )
    filled = sum(
        (F.when(F.col(c).isNotNull(), 1).otherwise(0)
         for c in ("invoice_number", "invoice_date", "total_amount", "vendor_name")),
        F.lit(0),
    )
    return out.withColumn("confidence", filled / 4.0).drop("_dates", "_amounts")


def degraded_extract(t: Column) -> Column:
    """Amount (total, amount, currency sign, in that order) and first date."""
    amount = F.coalesce(*[_amount(blank_to_null(F.regexp_extract(t, p, 1))) for p in V.DEGRADED_AMOUNT])
    date = F.coalesce(
        blank_to_null(F.regexp_extract(t, V.GENERIC_DATE, 1)),
        blank_to_null(F.regexp_extract(t, V.GENERIC_DATE_ISO, 1)),
    )
    return F.struct(amount.alias("amount"), date.alias("date"))


# ---- fixed values: words that decide the intent of a message (substrings) ----------------------------
HELP_WORDS = ["help", "?", "how"]
GREETING_WORDS = ["hello", "hi", "hey"]


def intent_of_text(t: Column) -> Column:
    lower = F.lower(t)
    return (
        F.when(_any(lower, HELP_WORDS), "help").when(_any(lower, GREETING_WORDS), "greeting").otherwise("other")
    )


def pipe_item(t: Column) -> Column:
    """``Description | Quantity | Price`` as an item, or an invalid flag."""

    def read(parts):
        quantity = F.try_element_at(parts, F.lit(2)).try_cast("decimal(18,4)")
        price = F.try_element_at(parts, F.lit(3)).try_cast("decimal(18,4)")
        text = F.try_element_at(parts, F.lit(1))
        valid = (
            (F.size(parts) >= 3) & (text != "") & (F.length(text) <= 500)
            & (quantity >= 0) & (price >= 0)
        )
        return F.struct(
            text.alias("description"), quantity.alias("quantity"), price.alias("unit_price"),
            F.coalesce(valid, F.lit(False)).alias("valid"),
        )

    return let(F.transform(F.split(t, r"\|"), strip), read)


def chat_field(name: Column, value: Column) -> Column:
    """Is a typed answer acceptable for its field? Dates are dd/mm/yyyy, amounts may have £ and commas."""
    v = strip(value)
    number = F.replace(F.replace(v, F.lit("£"), F.lit("")), F.lit(","), F.lit("")).try_cast("double")
    is_date = v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") & F.try_to_date(v, "d/M/yyyy").isNotNull()
    return F.coalesce(
        F.when(F.contains(name, F.lit("email")), F.contains(v, F.lit("@")) & F.contains(v, F.lit(".")))
        .when(F.contains(name, F.lit("date")), is_date)
        .when(name.isin("amount", "subtotal", "vat", "cis"), number.isNotNull())
        .otherwise(v != ""),
        F.lit(False),
    )
