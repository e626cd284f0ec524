"""Text invoices rendered from the order tables: one document per order that has lines.

Labels follow the layout in FIXTURES.md; some documents carry known defects so that validation
has something to find. An order's items are first reduced to one row per line number, so the
gathered list is as short as the invoice itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billspark.functions.fixed_values import UK_CITIES
from billspark.sources.tables import item_amount, latest_lines, table

MONEY = "decimal(18,2)"


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _pounds(c: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(c, 2))


def invoice_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order, customer, item lines and exact amounts, before any text is made.

    Spread by order over all shuffle partitions, and customers are joined to the bare orders: lines and gathered
    items are not shuffled by anything else but the part, where that is too large to be broadcast.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = table(spark, folder, "part", "p_partkey", "p_name")
    line = F.struct(
        F.col("l_linenumber").alias("n"),
        F.coalesce("p_name", F.lit("item")).alias("name"),
        F.col("amount"),
    )
    items = (
        latest_lines(spark, folder, n)
        .select("l_orderkey", "l_linenumber", "l_partkey", item_amount().alias("amount"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        .repartition(n, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.collect_list(line)).alias("items"),
            F.sum("amount").cast(MONEY).alias("subtotal"),
        )
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, folder, "customer", "c_custkey", "c_name")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    fifth = F.lit("0.2").cast("decimal(2,1)")
    vat = F.bround(F.col("subtotal") * fifth, 2).cast(MONEY)
    off = F.when(F.col("o_orderkey") % 7 == 0, 5).otherwise(0).cast(MONEY)
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumns({"vat": vat, "cis": vat})
        .withColumn(
            "total", (F.col("subtotal") + F.col("vat") - F.col("cis") + off).cast(MONEY)
        )
    )


def rendered_text() -> Column:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    city = F.element_at(
        F.array(*[F.lit(c) for c in UK_CITIES]), (cust % len(UK_CITIES) + 1).cast("int")
    )
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    short_day = F.date_format("o_orderdate", "dd/MM/yy")
    start = F.date_format(F.date_sub(F.to_date("o_orderdate"), 14), "dd/MM/yyyy")
    end = F.date_format(F.date_sub(F.to_date("o_orderdate"), 1), "dd/MM/yyyy")
    ni = F.concat(
        F.when(cust % 17 == 0, "GB").otherwise("AB"), _pad(cust % 1000000, 6),
        F.when(cust % 23 == 0, "Z").otherwise("C"),
    )
    six = _pad(cust % 1000000, 6)
    sort = F.concat_ws("-", F.substring(six, 1, 2), F.substring(six, 3, 2), F.substring(six, 5, 2))
    item = F.transform(
        "items",
        lambda i: F.concat(
            F.lit("Plot "), i["n"].cast("string"), F.lit(" - "), i["name"], F.lit(" - "),
            _pounds(i["amount"]),
        ),
    )
    whole = F.concat(F.lit("£"), F.format_number(F.floor("subtotal"), 0))
    subtotal = F.when(key % 17 != 0, F.concat(
        F.lit("Subtotal: "), F.when(key % 19 == 0, whole).otherwise(_pounds(F.col("subtotal")))
    ))
    lines = [
        F.concat("c_name", F.lit(" LTD")),
        F.concat((cust % 200 + 1).cast("string"), F.lit(" High Street")),
        F.concat(
            city, F.lit(", EC"), (cust % 9 + 1).cast("string"), F.lit("A "),
            (cust % 10).cast("string"), F.lit("BB"),
        ),
        F.lit(""),
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice Number: INV-"), key.cast("string")),
        F.concat(F.lit("Invoice Date: "), F.when(key % 13 == 0, short_day).otherwise(day)),
        F.lit(""),
        F.lit("Contractor Details:"),
        F.lit("Name: John Smith"),
        F.when(key % 11 != 0, F.concat(F.lit("UTR: "), _pad(cust, 10))),
        F.concat(F.when(key % 5 == 0, "NI: ").otherwise("NI Number: "), ni),
        F.concat(
            F.lit("Email: Customer"), cust.cast("string"),
            F.when(cust % 29 == 0, "@nodot").otherwise("@Example.com"),
        ),
        F.concat(F.lit("Phone: 07"), _pad(cust, 9)),
        F.lit(""),
        F.lit("Bank Details:"),
        F.concat(F.lit("Sort Code: "), sort),
        F.concat(F.lit("Account Number: "), _pad(cust, 8)),
        F.lit(""),
        F.concat(F.lit("Work Period: "), start, F.lit(" to "), end),
        F.lit(""),
        F.lit("Work Items:"),
        F.array_join(item, "\n"),
        F.lit(""),
        F.lit("Operatives: John Smith, Mary Jones"),
        F.lit(""),
        subtotal,
        F.concat(F.lit("VAT @ 20%: "), _pounds(F.col("vat"))),
        F.concat(F.lit("CIS Deduction: "), _pounds(F.col("cis"))),
        F.concat(F.lit("Total Due: "), _pounds(F.col("total"))),
    ]
    return F.concat_ws("\n", *lines)


def rendered_invoices(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    """``doc_id``, ``path``, ``text`` and any fact columns named in ``keep``.

    What follows is heavy on CPU and light on bytes. The facts come spread over all shuffle partitions; by size alone
    they would be merged into a few tasks.
    """
    key = F.col("o_orderkey")
    return invoice_facts(spark, folder).select(
        key.alias("doc_id"),
        F.concat(F.lit("/landing/inv-"), key.cast("string"), F.lit(".txt")).alias("path"),
        rendered_text().alias("text"),
        *keep,
    )
