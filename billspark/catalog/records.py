"""Queries over items, tables, attempts, stored invoices, scalar rules and operating statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from billspark.catalog import inputs as I
from billspark.catalog.extraction import over_base
from billspark.catalog.registry import query
from billspark.catalog.sql_text import ITEM_CENTS, LINES, half_even, lit
from billspark.functions import fixed_values as V, normalize as N, render, score, validate as R
from billspark.operators import attempts as A, items, numbering, stats
from billspark.plans.extraction import extract_invoices
from billspark.sources.rendered import invoice_facts, rendered_invoices
from billspark.sources.stores import current_invoices, with_json_body
from billspark.sources.tables import item_amount, latest_lines, table

# ---- items and totals ------------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return latest_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("invoice_id"), "l_linenumber", item_amount().alias("amount"),
        (F.col("l_tax") * 100).cast("decimal(5,2)").alias("tax_rate"),
    )


@query(
    "subtotal_from_items",
    f"WITH {LINES} SELECT l_orderkey AS invoice_id, sum({ITEM_CENTS})::DOUBLE / 100 AS subtotal FROM lines GROUP BY l_orderkey",
)
def subtotal_from_items(spark, sf_dir):
    return items.subtotal_from_items(_lines(spark, sf_dir), ["invoice_id"]).withColumn("subtotal", I.money("subtotal"))


@query(
    "invoice_totals",
    f"""WITH {LINES}, i AS (SELECT l_orderkey, {ITEM_CENTS} AS c, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lines),
    s AS (SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS c, CAST(sum(c * t) AS BIGINT) AS ct, count(*) AS n FROM i GROUP BY l_orderkey)
    SELECT l_orderkey AS invoice_id, c::DOUBLE / 100 AS subtotal, ct::DOUBLE / 10000 AS tax_total,
      (c * 100 + ct - 50000)::DOUBLE / 10000 AS total, n AS n_items FROM s""",
)
def invoice_totals(spark, sf_dir):
    out = items.invoice_totals(_lines(spark, sf_dir), ["invoice_id"], F.lit(5).cast("decimal(18,2)"))
    return out.select(
        "invoice_id", *[I.money(c).alias(c) for c in ("subtotal", "tax_total", "total")], "n_items"
    )


@query(
    "recompute_total",
    over_base("SELECT doc_id, (s_c + vat_c - vat_c) / 100.0::DOUBLE AS total FROM checked"),
)
def recompute_total(spark, sf_dir):
    from billspark.functions.enrich import recompute_total as again

    fin = F.col("financials")
    total = again(fin["subtotal"], fin["vat_amount"], fin["cis_deduction"])
    docs = rendered_invoices(spark, sf_dir).select("doc_id", "text")
    return extract_invoices(docs).select("doc_id", I.money(total).alias("total"))


# each order line becomes table row cells; odd orders get a second, poorer table
_HEADER = ["Item Description", "Qty", "Unit Price", "Line Total", "Plot"]


def _cells(spark, sf_dir):
    base = latest_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("row_no"),
        F.array(
            F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
            F.col("l_quantity").cast("int").cast("string"),
            F.concat(F.lit("£"), F.col("l_suppkey").cast("string"), F.lit(".50")),
            F.concat(F.lit("£"), item_amount().cast("string")),
            F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("string")),
        ).alias("cells"),
    )
    first = base.select("doc_id", F.lit(0).alias("table_no"), "row_no", "cells")
    second = base.filter(F.col("doc_id") % 2 == 1).select(
        "doc_id", F.lit(1).alias("table_no"), "row_no", F.slice("cells", 1, 2).alias("cells")
    )
    heads = base.select("doc_id").distinct().select(
        "doc_id", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"),
        F.array(*[F.lit(h) for h in _HEADER]).alias("cells"),
    )
    short = heads.filter(F.col("doc_id") % 2 == 1).select(
        "doc_id", F.lit(1).alias("table_no"), "row_no", F.slice("cells", 1, 2).alias("cells")
    )
    rows = first.unionByName(second).unionByName(heads).unionByName(short)
    return rows.select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"))


@query(
    "table_items",
    f"""WITH {LINES} SELECT l_orderkey AS doc_id, t AS table_no, CAST(l_linenumber AS BIGINT) AS row_no, 'part ' || l_partkey AS description,
    floor(l_quantity)::DOUBLE AS quantity, CASE WHEN t = 0 THEN l_suppkey + 0.5::DOUBLE END AS unit_price,
    CASE WHEN t = 0 THEN ({ITEM_CENTS})::DOUBLE / 100 END AS amount,
    CASE WHEN t = 0 AND l_returnflag <> 'R' THEN CAST(l_linenumber AS VARCHAR) END AS plot_number
    FROM lines, range(0, 2) tables(t) WHERE t = 0 OR l_orderkey % 2 = 1""",
)
def table_items(spark, sf_dir):
    """All tables: every order's, and the second one of odd orders, which has two columns."""
    return items.table_items(_cells(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("table_no").cast("bigint").alias("table_no"), F.col("row_no").cast("bigint").alias("row_no"), "description",
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "amount")], "plot_number",
    )


@query(
    "best_table",
    f"""WITH {LINES}, n AS (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY l_orderkey)
    SELECT l_orderkey AS doc_id, 0::BIGINT AS table_no, (2 * n + 2 * 5)::DOUBLE AS score FROM n""",
)
def best_table(spark, sf_dir):
    # header hits: description, qty, price, total, item
    return items.best_table(_cells(spark, sf_dir), ["doc_id"]).select(
        "doc_id", F.col("table_no").cast("bigint").alias("table_no"), "score"
    )


@query(
    "merge_table_items",
    f"WITH {LINES} SELECT l_orderkey AS doc_id, 2 * count(*) AS n_items FROM lines GROUP BY l_orderkey",
)
def merge_table_items(spark, sf_dir):
    from billspark.schemas import WORK_ITEM

    docs = rendered_invoices(spark, sf_dir, "items").select("doc_id", "text", F.col("items").alias("facts"))
    found = extract_invoices(docs)
    from_table = F.transform(
        "facts",
        lambda i: F.struct(
            F.lit(None), F.lit(None), i["name"], F.lit(None), F.lit(None), i["amount"], F.lit(None)
        ),
    ).cast(f"array<{WORK_ITEM}>")
    both = items.merge_table_items(F.col("work_items"), from_table)
    return found.select("doc_id", F.size(both).cast("bigint").alias("n_items"))


# ---- choice among attempts ----------------------------------------------------------------------------------------


@query(
    "select_attempt",
    f"""WITH {I.ATTEMPTS}, f AS (
      SELECT doc_id, min(attempt_no) FILTER (WHERE success AND confidence >= 0.3) AS first_no,
        arg_max(attempt_no, (confidence, -attempt_no)) FILTER (WHERE success AND confidence > 0) AS best_no
      FROM att GROUP BY doc_id),
    c AS (SELECT *, coalesce(first_no, best_no) AS no FROM f)
    SELECT c.doc_id, no IS NOT NULL AS success, CAST(no AS BIGINT) AS attempt_no, a.method AS best_method, a.confidence,
      (SELECT count(*) FROM att x WHERE x.doc_id = c.doc_id AND (first_no IS NULL OR x.attempt_no <= first_no)) AS n_attempts,
      (SELECT CAST(sum(ms) AS BIGINT) FROM att x WHERE x.doc_id = c.doc_id AND (first_no IS NULL OR x.attempt_no <= first_no)) AS total_ms,
      CASE WHEN no IS NULL THEN coalesce((SELECT string_agg(error_message, '; ' ORDER BY attempt_no) FROM att x WHERE x.doc_id = c.doc_id),
        'All extraction methods failed') ELSE '' END AS errors,
      CASE WHEN first_no IS NULL AND no IS NOT NULL THEN 'Low confidence extraction' ELSE '' END AS warnings
    FROM c LEFT JOIN att a ON a.doc_id = c.doc_id AND a.attempt_no = c.no""",
)
def select_attempt(spark, sf_dir):
    return A.select_attempt(I.attempts(spark, sf_dir)).select(
        "doc_id", "success", F.col("attempt_no").cast("bigint").alias("attempt_no"), "best_method", "confidence",
        F.col("n_attempts").cast("bigint").alias("n_attempts"), "total_ms",
        F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "healing_ladder",
    f"""WITH {I.ATTEMPTS}, t AS (SELECT * FROM att WHERE NOT image_only OR is_image)
    SELECT doc_id, CAST(coalesce(min(attempt_no) FILTER (WHERE confidence >= 0.4), max(attempt_no)) AS BIGINT) AS attempt_no,
      count(*) FILTER (WHERE confidence >= 0.4) = 0 AS extraction_failed FROM t GROUP BY doc_id""",
)
def healing_ladder(spark, sf_dir):
    return A.healing_ladder(I.attempts(spark, sf_dir)).select(
        "doc_id", F.col("attempt_no").cast("bigint").alias("attempt_no"), "extraction_failed"
    )


@query(
    "best_quality_attempt",
    f"""WITH {I.ATTEMPTS}, g AS (
      SELECT doc_id, min(attempt_no) FILTER (WHERE success AND method <> 'gpt4_vision' AND confidence >= 0.65) AS stop,
        arg_max(attempt_no, (confidence, -attempt_no)) FILTER (WHERE success AND method <> 'gpt4_vision') AS best,
        max(confidence) FILTER (WHERE success AND method <> 'gpt4_vision') AS bc,
        arg_max(attempt_no, (confidence, -attempt_no)) FILTER (WHERE success AND method = 'gpt4_vision') AS vis,
        max(confidence) FILTER (WHERE success AND method = 'gpt4_vision') AS vc
      FROM att GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN stop IS NULL AND vis IS NOT NULL AND (best IS NULL OR (bc < 0.4 AND vc > bc)) THEN vis
      ELSE coalesce(stop, best) END AS BIGINT) AS attempt_no, stop IS NOT NULL AS stopped_early FROM g""",
)
def best_quality_attempt(spark, sf_dir):
    return A.best_quality_attempt(I.attempts(spark, sf_dir)).select(
        "doc_id", F.col("attempt_no").cast("bigint").alias("attempt_no"), "stopped_early"
    )


@query(
    "confidence_gate",
    f"WITH {I.ATTEMPTS} SELECT method, count(*) AS n FROM att WHERE success AND confidence >= 0.3 GROUP BY method",
)
def confidence_gate(spark, sf_dir):
    passed = I.attempts(spark, sf_dir).filter(A.passes_gate())
    return passed.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


_RANK_ROWS = ", ".join(
    f"({lit(k)}, {lit(s)}, {i})" for k, names in V.STRATEGY_ORDER.items() for i, s in enumerate(names)
)
_DOC_KIND = "CASE WHEN o_orderkey % 3 = 0 THEN 'image' ELSE 'pdf' END"


@query(
    "untried_strategies",
    f"""WITH {I.ATTEMPTS}, r(kind, strategy, rnk) AS (VALUES {_RANK_ROWS}), d AS (SELECT o_orderkey AS doc_id, {_DOC_KIND} AS kind FROM orders)
    SELECT doc_id, strategy, CAST(rnk AS BIGINT) AS rnk FROM d JOIN r USING (kind)
    WHERE NOT EXISTS (SELECT 1 FROM att WHERE att.doc_id = d.doc_id AND att.method = r.strategy)""",
)
def untried_strategies(spark, sf_dir):
    docs = table(spark, sf_dir, "orders", F.col("o_orderkey").alias("doc_id")).withColumn(
        "file_kind", F.when(F.col("doc_id") % 3 == 0, "image").otherwise("pdf")
    )
    tried = I.attempts(spark, sf_dir).select("doc_id", F.col("method").alias("strategy"))
    return A.untried_strategies(docs, tried).select("doc_id", "strategy", F.col("rank").cast("bigint").alias("rnk"))


@query(
    "missing_strategies",
    f"""WITH {I.ATTEMPTS}, t AS (SELECT doc_id, list(DISTINCT method) AS m FROM att GROUP BY doc_id)
    SELECT doc_id, array_to_string(list_filter({[s for s, _, _ in V.STRATEGIES]}, lambda x: NOT list_contains(m, x)), ',') AS missing FROM t""",
)
def missing_strategies(spark, sf_dir):
    tried = I.attempts(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("method").alias("m"))
    return tried.select("doc_id", F.array_join(A.missing_strategies(F.col("m")), ",").alias("missing"))


@query(
    "union_attempts",
    f"""WITH {I.ATTEMPTS} SELECT 0 AS attempt_no, count(*) AS n FROM att WHERE success UNION ALL
    SELECT 1, count(*) FROM att WHERE NOT success""",
)
def union_attempts(spark, sf_dir):
    a = I.attempts(spark, sf_dir).drop("attempt_no")
    parts = [a.filter("success").drop("error_message"), a.filter("NOT success")]
    return A.union_attempts(parts).groupBy(F.col("attempt_no").cast("bigint").alias("attempt_no")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "register_strategy",
    over_base(
        """SELECT doc_id, CASE WHEN k % 3 = 0 THEN 'cheap' ELSE 'dear' END AS method FROM checked"""
    ),
)
def register_strategy(spark, sf_dir):
    """The dear strategy reads only what the cheap one could not do."""
    def fixed(name, test):
        return lambda d: d.select(
            "doc_id", F.lit(name).alias("method"), F.lit(True).alias("success"),
            F.when(test, 0.9).otherwise(0.1).alias("confidence"),
            F.lit(None).cast("string").alias("error_message"), F.lit(1).alias("processing_time_ms"),
        )

    s = A.Strategies()
    s.register("dear", fixed("dear", F.lit(True)), cost_tier=5)
    s.register("cheap", fixed("cheap", F.col("doc_id") % 3 == 0), cost_tier=1)
    docs = invoice_facts(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"))
    return A.select_attempt(s.run(docs)).select("doc_id", F.col("best_method").alias("method"))


# ---- scalar rules --------------------------------------------------------------------------------------------------------

_KEY = "CAST(o_orderkey AS VARCHAR)"
_NUM = ["Invoice # INV-", "Inv: ABC", "No: ", "  INV-2024-", "x_", "#"]
_NUM_CLEAN = ["# INV-", "ABC", "", "2024-", "X_", ""]


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").withColumn(
        "k", F.col("o_orderkey")
    ).withColumn("ks", F.col("o_orderkey").cast("string"))


@query(
    "clean_invoice_number",
    f"SELECT o_orderkey, {I.sql_pick(_NUM_CLEAN, 'o_orderkey')} || {_KEY} AS cleaned FROM orders",
)
def clean_invoice_number(spark, sf_dir):
    raw = F.concat(I.pick(_NUM, F.col("k")), "ks")
    return _orders(spark, sf_dir).select("o_orderkey", N.clean_invoice_number(raw).alias("cleaned"))


@query(
    "clean_identifiers",
    """SELECT o_orderkey, '+447' || lpad(o_custkey::VARCHAR, 9, '0') AS phone, 'EC' || (o_custkey % 9 + 1) || 'A ' || (o_custkey % 10) || 'BB' AS postcode,
    lpad(o_custkey::VARCHAR, 10, '0') AS utr, 'AB' || lpad((o_custkey % 1000000)::VARCHAR, 6, '0') || 'C' AS ni,
    substr(lpad((o_custkey % 1000000)::VARCHAR, 6, '0'), 1, 2) || '-' || substr(lpad((o_custkey % 1000000)::VARCHAR, 6, '0'), 3, 2)
      || '-' || substr(lpad((o_custkey % 1000000)::VARCHAR, 6, '0'), 5, 2) AS sort_code,
    'user' || o_custkey || '@example.com' AS email, o_custkey || ' High St, London' AS address,
    lpad(o_custkey::VARCHAR, 8, '0') AS account, 'S' AS vat_code, o_custkey || '@x' AS customer_email FROM orders""",
)
def clean_identifiers(spark, sf_dir):
    c = F.col("o_custkey")
    s = c.cast("string")
    six, ten = F.lpad((c % 1000000).cast("string"), 6, "0"), F.lpad(s, 10, "0")
    phone = F.when(F.col("k") % 2 == 0, F.concat(F.lit("07"), F.lpad(s, 9, "0"))).otherwise(
        F.concat(F.lit("44 7"), F.lpad(s, 9, "0"))
    )
    post = F.concat(F.lit(" ec"), (c % 9 + 1).cast("string"), F.lit("a"), (c % 10).cast("string"), F.lit("bb"))
    ni = F.concat(F.lit("ab "), six, F.lit(" c"))
    mail = F.concat(F.lit(" mailto:User"), s, F.lit("@Example.COM "))
    return _orders(spark, sf_dir).select(
        "o_orderkey", N.clean_phone(phone).alias("phone"), N.clean_postcode(post).alias("postcode"),
        N.clean_utr(F.concat(F.lit("UTR "), ten)).alias("utr"), N.clean_ni(ni).alias("ni"),
        N.clean_sort_code(six).alias("sort_code"),
        N.clean_email(F.regexp_replace(mail, "^ mailto", "mailto")).alias("email"),
        N.clean_address(F.concat(s, F.lit("  High   St ,London"))).alias("address"),
        N.clean_account(F.concat(F.lpad(s, 8, "0"), F.lit(" "))).alias("account"),
        N.normalize_code(F.lit(" s ")).alias("vat_code"), N.customer_email(F.concat(s, F.lit("@X"))).alias("customer_email"),
    )


@query(
    "clean_money",
    f"""SELECT l_orderkey, l_linenumber, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT l_orderkey, l_linenumber,
      {half_even("CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))", 100)} AS c FROM lineitem)
    GROUP BY ALL""",
)
def clean_money(spark, sf_dir):
    raw = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum((N.clean_money(raw) * 100).cast("bigint")).alias("cents")
    )


_MONEY_FORM = ["£", "(", "-", "$ ", "€"]


@query(
    "parse_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN -o_totalprice ELSE o_totalprice END AS amount,
    o_totalprice AS field FROM orders""",
)
def parse_money(spark, sf_dir):
    shown = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    raw = F.concat(I.pick(_MONEY_FORM, F.col("k")), shown, F.when(F.col("k") % 5 == 1, ")").otherwise(""))
    return _orders(spark, sf_dir).select(
        "o_orderkey", N.parse_money(raw).cast("double").alias("amount"),
        N.parse_decimal_field(F.concat(F.lit("£"), shown)).cast("double").alias("field"),
    )


_DATE_FORMS = [
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy-M-d", "yyyy.M.d", "d/M/yy", "d-M-yy", "d.M.yy",
    "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "ddMMyyyy",
]


@query("parse_date", f"""SELECT o_orderkey, CASE WHEN o_orderkey % {len(_DATE_FORMS)} < 13 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS flexible_day FROM orders""")
def parse_date(spark, sf_dir):
    shown = F.element_at(
        F.array(*[F.date_format("o_orderdate", f) for f in _DATE_FORMS]), (F.col("k") % len(_DATE_FORMS) + 1).cast("int")
    )
    return _orders(spark, sf_dir).select("o_orderkey", shown.alias("t")).select(
        "o_orderkey", N.parse_date(F.col("t")).cast("string").alias("day"),
        N.parse_date_flexible(F.col("t")).cast("string").alias("flexible_day"),
    )


@query(
    "field_validators",
    """SELECT o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat_ws('; ', CASE WHEN length(o_orderkey::VARCHAR) < 3 AND o_orderkey % 4 <> 1 THEN 'Invoice number seems too short' END,
      CASE WHEN o_orderkey % 4 = 1 THEN 'Invoice number contains unusual characters' END) END AS number_errors,
    concat_ws('; ', CASE WHEN CAST(o_orderdate AS DATE) > DATE '2000-06-30' THEN 'due date is in the future' END,
      CASE WHEN CAST(o_orderdate AS DATE) < DATE '2000-06-30' - 1825 THEN 'due date is more than 5 years old' END) AS date_errors,
    CASE WHEN length(o_custkey::VARCHAR) <> 10 THEN 'UTR should be 10 digits, got ' || length(o_custkey::VARCHAR) ELSE '' END AS utr_errors,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NI number has invalid prefix: GB' WHEN 2 THEN 'NI number has invalid suffix: Z'
      WHEN 3 THEN 'NI number format is invalid (should be XX123456X)' ELSE '' END AS ni_errors,
    CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Email format is invalid' END AS email_errors,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Postcode format is invalid' END AS postcode_errors,
    CASE WHEN length(o_custkey::VARCHAR) + 2 = 6 THEN '' ELSE 'Sort code should be 6 digits, got ' || (length(o_custkey::VARCHAR) + 2) END AS sort_errors,
    CASE WHEN length(o_custkey::VARCHAR) + 4 BETWEEN 6 AND 8 THEN '' ELSE 'Account number should be 6-8 digits, got ' || (length(o_custkey::VARCHAR) + 4) END AS account_errors
    FROM orders""",
)
def field_validators(spark, sf_dir):
    k, cs = F.col("k"), F.col("o_custkey").cast("string")
    number = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("A_B"), "ks")).otherwise(F.col("ks"))
    ni = I.pick(["AB123456C", "GB123456C", "AB123456Z", "INVALID", ""], k)
    mail = I.pick(["test@example.com", "not-an-email"], k)
    post = I.pick(["ec1a 1bb", "12345", "EC1A1B"], k)

    def joined(c, name):
        return F.array_join(c, "; ").alias(name)

    return _orders(spark, sf_dir).select(
        "o_orderkey", joined(R.number_errors(number), "number_errors"),
        joined(R.date_errors(F.to_date("o_orderdate"), "due date", F.lit("2000-06-30").cast("date")), "date_errors"),
        joined(R.utr_errors(cs), "utr_errors"), joined(R.ni_errors(ni), "ni_errors"),
        joined(R.email_errors(mail), "email_errors"), joined(R.postcode_errors(post), "postcode_errors"),
        joined(R.sort_code_errors(F.concat(F.lit("12-"), cs)), "sort_errors"),
        joined(R.account_errors(F.concat(F.lit("1234 "), cs)), "account_errors"),
    )


@query(
    "model_limits",
    """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('; ', CASE WHEN l_quantity - 10 < 0 THEN 'quantity: below 0' END,
      CASE WHEN l_tax * 2000 > 100 THEN 'tax_rate: above 100' END, CASE WHEN l_returnflag <> 'A' THEN 'currency: below 3' END) AS broken FROM lineitem""",
)
def model_limits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_returnflag")
    broken = R.limit_errors(
        {
            "quantity": F.col("l_quantity") - 10, "tax_rate": F.col("l_tax") * 2000,
            "currency": F.when(F.col("l_returnflag") == "A", "GBP").otherwise("GB"),
        }
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(broken, "; ").alias("broken"))


def _flat(spark, sf_dir):
    """Flat invoices with gaps, from orders and customers."""
    k = F.col("k")
    one = F.array(F.struct(F.lit("Bricks and mortar").alias("description"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount")))
    none = F.array().cast("array<struct<description:string,amount:decimal(18,2)>>")

    def gap(n, value):
        return F.when(k % n != 0, value).otherwise("")

    price = F.col("o_totalprice").cast("decimal(18,2)")
    return _orders(spark, sf_dir).select(
        "o_orderkey", gap(7, F.lit("Smith Ltd")).alias("contractor_name"),
        gap(5, F.lit("1 High Street, London")).alias("contractor_address"),
        gap(3, F.lit("a@b.co")).alias("contractor_email"), F.concat(F.lit("INV-"), "ks").alias("invoice_number"),
        gap(11, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("invoice_date"),
        F.when(k % 2 == 0, one).otherwise(none).alias("work_items"),
        F.lit("1234567890").alias("contractor_utr"), F.lit("").alias("contractor_ni"), F.lit("12345678").alias("bank_account"),
        F.lit("12-34-56").alias("sort_code"), F.lit("").alias("work_start_date"), F.lit("").alias("work_end_date"),
        F.lit("").alias("operative_names"), price.alias("subtotal"), F.lit(0).cast("decimal(18,2)").alias("vat_amount"),
        F.lit(0).cast("decimal(18,2)").alias("cis_amount"), price.alias("total"),
    )


_MISSING = """concat_ws(', ', CASE WHEN o_orderkey % 7 = 0 THEN 'Contractor Name' END, CASE WHEN o_orderkey % 5 = 0 THEN 'Contractor Address' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Contractor Email' END, CASE WHEN o_orderkey % 11 = 0 THEN 'Invoice Date' END,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Work Items' END)"""


@query(
    "missing_fields",
    f"SELECT o_orderkey, {_MISSING} AS missing, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 AS complete FROM orders",
)
def missing_fields(spark, sf_dir):
    return _flat(spark, sf_dir).select(
        "o_orderkey", F.array_join(score.missing_fields(), ", ").alias("missing"), score.is_complete().alias("complete")
    )


@query(
    "collected_and_pending",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 <> 0 THEN 'contractor_name' END, 'invoice_number') AS collected,
    CASE WHEN o_orderkey % 7 = 0 THEN 'contractor_name' ELSE '' END AS pending FROM orders""",
)
def collected_and_pending(spark, sf_dir):
    wanted = ["contractor_name", "invoice_number"]
    return _flat(spark, sf_dir).select(
        "o_orderkey", F.array_join(score.collected_fields(wanted), ",").alias("collected"),
        F.array_join(score.pending_fields(wanted), ",").alias("pending"),
    )


@query(
    "quarter_confidence",
    """SELECT o_orderkey, (2 + CASE WHEN o_orderkey % 7 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 11 <> 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS confidence FROM orders""",
)
def quarter_confidence(spark, sf_dir):
    empty = F.lit("")
    return _flat(spark, sf_dir).select(
        "o_orderkey",
        score.quarter_confidence(
            F.nullif("contractor_name", empty), F.col("invoice_number"), F.nullif("invoice_date", empty), F.col("total")
        ).alias("confidence"),
    )


@query("distinct_error_types", f"""WITH {I.ERRORS} SELECT user_id % 10 AS grp, array_to_string(list_sort(list_distinct(list(error_type))), ',') AS kinds
    FROM errors GROUP BY 1""")
def distinct_error_types(spark, sf_dir):
    from billspark.operators.retry import distinct_errors

    e = I.errors(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("grp")).agg(F.collect_set("error_type").alias("k"))
    return e.select("grp", F.array_join(distinct_errors(F.col("k")), ",").alias("kinds"))


# ---- rendering -------------------------------------------------------------------------------------------------------------

_PRICE = "format('{:.2f}', o_totalprice)"
_TEXT_SQL = f"""concat_ws(chr(10), '👤 *Contractor:* ' || CASE WHEN o_orderkey % 7 <> 0 THEN 'Smith Ltd' ELSE '' END,
  '📧 *Email:* ' || CASE WHEN o_orderkey % 3 <> 0 THEN 'a@b.co' ELSE '' END,
  '🏠 *Address:* ' || CASE WHEN o_orderkey % 5 <> 0 THEN '1 High Street, London' ELSE '' END,
  '🆔 *UTR:* 1234567890', '💳 *Bank:* 12345678 | Sort: 12-34-56', '📄 *Invoice #:* INV-' || o_orderkey,
  '📅 *Date:* ' || CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '' END, '🔨 *Work Items:*',
  CASE WHEN o_orderkey % 2 = 0 THEN '  1. Bricks and mortar... - £' || {_PRICE} END, '💰 *Financial Summary:*',
  '  Subtotal: £' || {_PRICE}, '  VAT: £0.00', '  CIS Deduction: £0.00', '  *Total: £' || {_PRICE} || '*')"""


@query("render_invoice_text", f"SELECT o_orderkey, md5({_TEXT_SQL}) AS body FROM orders")
def render_invoice_text(spark, sf_dir):
    d = _flat(spark, sf_dir)
    body = render.display_text({c: F.col(c) for c in d.columns})
    return d.select("o_orderkey", F.md5(body.cast("binary")).alias("body"))


@query(
    "render_summaries",
    f"""SELECT o_orderkey, true AS has_total, o_orderkey % 7 = 0 AS na_name, o_orderkey % 2 = 1 AS no_items, o_orderkey % 2 = 0 AS html_row FROM orders""",
)
def render_summaries(spark, sf_dir):
    d = _flat(spark, sf_dir)
    row = {c: F.col(c) for c in d.columns}
    total = F.concat(F.lit("*TOTAL: £"), render.two_places(F.col("total")), F.lit("*"))
    s, h = render.summary_text(row), render.html_document(row)
    return d.select(
        "o_orderkey", F.contains(s, total).alias("has_total"), F.contains(s, F.lit("👤 Name: N/A")).alias("na_name"),
        F.contains(s, F.lit("No work items added")).alias("no_items"),
        F.contains(h, F.lit("<tr><td>1</td><td>Bricks and mortar</td>")).alias("html_row"),
    )


_CUR = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF"]


@query(
    "currency_and_company",
    f"""SELECT o_orderkey, {I.sql_pick(["$", "€", "£", "¥", "C$", "A$", "CHF"], "o_orderkey")} AS symbol,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Own Ltd' ELSE 'Configured Ltd' END AS company FROM orders""",
)
def currency_and_company(spark, sf_dir):
    from billspark.operators.lookups import with_company_defaults

    own = F.when(F.col("k") % 2 == 0, F.struct(F.lit("Own Ltd").alias("name"), F.lit(None).cast("string").alias("address")))
    d = with_company_defaults(_orders(spark, sf_dir).withColumn("company", own), {"name": "Configured Ltd", "address": "1 Road"})
    return d.select("o_orderkey", render.currency_symbol(I.pick(_CUR, F.col("k"))).alias("symbol"), F.col("company.name").alias("company"))


@query("truncate_raw", "SELECT doc_id, length(text[1:5000]) AS n5000, md5(text[1:100] || CASE WHEN length(text) > 100 THEN '...' ELSE '' END) AS head FROM documents")
def truncate_raw(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(
        "doc_id", F.length(F.substring("text", 1, 5000)).cast("bigint").alias("n5000"),
        F.md5(render.cut(F.col("text"), 100).cast("binary")).alias("head"),
    )


# ---- stored invoices ----------------------------------------------------------------------------------------------------------


@query(
    "upsert_latest",
    f"WITH {LINES} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_linestatus FROM lines WHERE l_returnflag <> 'R'",
)
def upsert_latest(spark, sf_dir):
    """Repeats of (order, line) are changes; a returned line is a deletion."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    changes = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *order).withColumn("gone", F.col("l_returnflag") == "R")
    out = numbering.upsert_latest(changes, ["l_orderkey", "l_linenumber"], order, "gone")
    return out.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_linestatus")


def _invoices(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total"), F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.col("o_orderstatus").alias("status"),
    )


@query(
    "store_round_trip",
    "SELECT o_orderkey AS id, 'INV-' || o_orderkey AS invoice_number, o_totalprice AS total FROM orders",
)
def store_round_trip(spark, sf_dir):
    """Header columns plus a JSON body, read back with a declared schema."""
    stored = with_json_body(_invoices(spark, sf_dir), ["id"])
    back = current_invoices(stored, "invoice_number string, total double")
    return back.select("id", "body.invoice_number", "body.total")


@query(
    "list_by_user",
    "SELECT o_orderkey AS id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 2",
)
def list_by_user(spark, sf_dir):
    return numbering.list_by_user(_invoices(spark, sf_dir), 7, 5, 2).select("id")


@query(
    "page_per_user",
    """SELECT o_custkey AS user_id, o_orderkey AS id FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) BETWEEN 3 AND 7""",
)
def page_per_user(spark, sf_dir):
    return numbering.page_per_user(_invoices(spark, sf_dir), 5, 2).select("user_id", "id")


@query(
    "documents_of_invoices",
    "SELECT o_orderkey AS id, doc_id AS document_id FROM orders LEFT JOIN documents ON doc_id = o_custkey",
)
def documents_of_invoices(spark, sf_dir):
    inv = _invoices(spark, sf_dir).select("id", F.col("user_id").alias("source_document"))
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("document_id"))
    return numbering.documents_of_invoices(inv, docs).select("id", "document_id")


@query(
    "assign_invoice_numbers",
    """WITH e AS (SELECT count(*) AS have FROM customer), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'CR' ELSE 'INV' END AS prefix,
      o_orderdate FROM orders)
    SELECT o_orderkey, prefix || '-' || (1000 + CASE WHEN prefix = 'INV' THEN have ELSE 0 END
      + row_number() OVER (PARTITION BY prefix ORDER BY o_orderdate, o_orderkey) - 1) AS invoice_number FROM n, e""",
)
def assign_invoice_numbers(spark, sf_dir):
    new = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn(
        "prefix", F.when(F.col("o_orderkey") % 10 == 0, "CR").otherwise("INV")
    )
    existing = table(spark, sf_dir, "customer", "c_custkey").select(F.lit("INV").alias("prefix"))
    return numbering.assign_invoice_numbers(new, existing, ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "invoice_number"
    )


# ---- operating statistics --------------------------------------------------------------------------------------------------------


def _ops(spark, sf_dir):
    t = F.col("event_type")
    return I.events(spark, sf_dir).select(
        "ts", "user_id", t.isin("click", "view").alias("is_message"), (t == "purchase").alias("is_document"),
        (F.col("k") >= 10).alias("ok"), (F.col("value") / 10).alias("response_s"), (t == "error").alias("is_error"),
        (t == "signup").alias("is_start"), (t == "purchase").alias("is_done"), "event_type",
    )


_KPI = f"""WITH {I.EVENTS}, h AS (
  SELECT date_trunc('hour', ts) AS hr, count(*) AS n_events, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n_messages,
    count(*) FILTER (WHERE event_type = 'purchase') AS docs, count(*) FILTER (WHERE event_type = 'purchase' AND k >= 10) AS docs_ok,
    max(value / 10) AS max_response_s, avg(value / 10) AS avg_response_s, count(*) FILTER (WHERE event_type = 'error') AS errs,
    count(*) FILTER (WHERE event_type = 'signup') AS starts FROM ev GROUP BY 1)"""


@query(
    "operating_kpis",
    _KPI + f"""SELECT {I.sql_stamp("hr")} AS hour, n_events, n_messages, round(docs_ok::DOUBLE / nullif(docs, 0), 6) AS document_success_rate,
    round(max_response_s, 6) AS max_response_s, round(avg_response_s * n_events, 3) AS total_response_s, round(errs::DOUBLE / n_events, 6) AS error_rate,
    round(docs::DOUBLE / nullif(starts, 0), 6) AS completion_rate FROM h""",
)
def operating_kpis(spark, sf_dir):
    k = stats.operating_kpis(_ops(spark, sf_dir))
    rounded = ["document_success_rate", "max_response_s", "error_rate", "completion_rate"]
    total = F.round(F.col("avg_response_s") * F.col("n_events"), 3).alias("total_response_s")
    return k.select(I.stamp("hour").alias("hour"), "n_events", "n_messages", total, *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "alert_rules",
    _KPI + f"""SELECT {I.sql_stamp("hr")} AS hour, 'error_rate' AS alert, round(errs::DOUBLE / n_events, 6) AS value FROM h WHERE errs::DOUBLE / n_events > 0.01
    UNION ALL SELECT {I.sql_stamp("hr")}, 'slow_response', round(max_response_s, 6) FROM h WHERE max_response_s > 5""",
)
def alert_rules(spark, sf_dir):
    a = stats.alert_rules(stats.operating_kpis(_ops(spark, sf_dir)))
    return a.select(I.stamp("hour").alias("hour"), "alert", F.round("value", 6).alias("value"))


@query(
    "usage_metrics",
    """SELECT count(DISTINCT user_id) AS total_users, count(*) FILTER (WHERE event_type = 'click') AS active_conversations,
    count(*) FILTER (WHERE event_type = 'view') AS documents_processed, count(*) FILTER (WHERE event_type = 'purchase') AS invoices_generated,
    count(*) FILTER (WHERE event_type = 'error') AS errors_count FROM events""",
)
def usage_metrics(spark, sf_dir):
    t = F.col("event_type")
    kinds = {"active_conversations": t == "click", "documents_processed": t == "view", "invoices_generated": t == "purchase", "errors_count": t == "error"}
    return stats.usage_metrics(_ops(spark, sf_dir), kinds)


@query(
    "response_quantiles",
    """SELECT event_type, quantile_disc(value / 10, 0.5) AS p50, quantile_disc(value / 10, 0.95) AS p95,
    quantile_disc(value / 10, 0.99) AS p99 FROM events GROUP BY event_type""",
)
def response_quantiles(spark, sf_dir):
    q = stats.response_quantiles(_ops(spark, sf_dir), ["event_type"])
    return q.select("event_type", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


@query(
    "event_log_scan",
    f"""WITH {I.EVENTS} SELECT event_id, CASE WHEN k >= 5 THEN event_type END AS event, CASE WHEN k >= 5 THEN user_id END AS user_id, k < 5 AS rejected FROM ev""",
)
def event_log_scan(spark, sf_dir):
    """Events written as log lines (some cut short), read back with a declared schema."""
    from billspark.sources.documents import parse_event_lines

    line = F.to_json(F.struct(F.col("event_type").alias("event"), "user_id", F.col("value").alias("processing_time")))
    cut = F.when(F.col("k") < 5, F.substring(line, 1, 12)).otherwise(line)
    lines = I.events(spark, sf_dir).select("event_id", cut.alias("value"))
    return parse_event_lines(lines).select("event_id", "event", "user_id", "rejected")




@query(
    "flatten_rows",
    f"""WITH {LINES} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
    l_returnflag || ' | ' || l_partkey || CASE WHEN l_linestatus = 'F' THEN '' ELSE ' | ' || l_linestatus END AS line FROM lines""",
)
def flatten_rows(spark, sf_dir):
    from billspark.functions.text import flatten_cells

    cells = F.array(
        F.concat(F.lit(" "), "l_returnflag"), F.lit("\t"), F.col("l_partkey").cast("string"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")),
    )
    return latest_lines(spark, sf_dir).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), flatten_cells(cells).alias("line")
    )
