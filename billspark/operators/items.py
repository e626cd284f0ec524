"""Line items: from text (X14), from table cells (X15, O7), merging (U2), totals (A2, A3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.normalize import WIDE, parse_money
from billspark.functions.arrays import blocks_of, let, piece, running_total, scan
from billspark.functions.text import blank_to_null, led, let_sql, strip
from billspark.schemas import WORK_ITEM

#: The patterns as they are searched, and the text from the first word that can begin a label.
_PLOT, _OPERATIVE = led(V.PLOT, "puh"), led(V.OPERATIVE, "owesn")
_PLOTS_PART = r"(?is)(?=[puh])(?:Plot|Property|Unit|House).*"

_NUMBER = "([0-9]+[A-Za-z]?)$"
#: Up to so many labels are looked through one by one, which is the faster way for them.
FEW = 32
# x.t is the text, x.m its labels, x.b what stands between them; of a label: number, whether it describes, its end
_FEW_PLOTS = f"""
transform(transform(transform(
  array(zip_with(x.m, aggregate(zip_with(slice(x.b, 1, size(x.m)), x.m, (s, f) -> length(s) + length(f)), cast(array() AS array<int>),
      (a, v) -> array_append(a, v + if(size(a) > 0, a[size(a) - 1], 0))),
    (f, e) -> struct(regexp_extract(f, '{_NUMBER}', 1) AS p, lower(regexp_extract(f, '{_NUMBER}', 1)) AS n, lower(left(f, 1)) = 'p' AS d, e))),
  g -> transform(g, y -> struct(y.p, try_element_at(filter(g, z -> z.d AND startswith(z.n, y.n)), 1).e AS e)))[0],
  y -> struct(y.p, substring(x.t, y.e + 1) AS rest)),
  y -> struct(y.p, if(instr(y.rest, char(10)) > 0, substring(y.rest, instr(y.rest, char(10)) + 1, 200), '') AS body))
"""


def _plot_bodies(lined: Column, labels: Column) -> Column:
    """``p, body`` of each plot label of a text.

    A plot's description starts on the line after the first "plot" or "property" label whose number begins
    with the plot's number, and is the next 50 to 200 characters. That label is found by sorting: every
    number stands once under each of its beginnings, and a plot meets the first label of its own number.
    """

    def numbered(x: Column) -> Column:
        number = F.transform(x["labels"], lambda f: F.regexp_extract(f, _NUMBER, 1))
        return F.struct(*[x[f].alias(f) for f in ("labels", "between", "blocks")], number.alias("number"))

    def meetings(x: Column) -> Column:
        # (beginning, 0, label) for labels that describe, (number, 1, plot) for plots, in order
        entries = F.transform(
            x["number"],
            lambda n, i: F.transform(
                F.sequence(F.lit(1), F.length(n)),
                lambda k: F.struct(F.lower(F.left(n, k)).alias("key"), F.lit(0).alias("asks"), i.alias("i")),
            ),
        )
        describing = F.zip_with(x["labels"], entries, lambda f, e: F.when(F.lower(F.left(f, F.lit(1))) == "p", e))
        asking = F.transform(x["number"], lambda n, i: F.struct(F.lower(n).alias("key"), F.lit(1).alias("asks"), i.alias("i")))
        return F.sort_array(F.concat(F.flatten(F.filter(describing, lambda e: e.isNotNull())), asking))

    def firsts(x: Column) -> Column:
        """For each plot the number of its label, or none."""
        start = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("first"), F.lit(-1).alias("plot"))

        def step(a: Column, m: Column) -> Column:
            held = F.when(a["key"] == m["key"], a["first"])
            first = F.coalesce(held, F.when(m["asks"] == 0, m["i"]))
            return F.struct(m["key"].alias("key"), first.alias("first"), F.when(m["asks"] == 1, m["i"]).otherwise(-1).alias("plot"))

        met = F.filter(scan(meetings(x), start, step, "struct<key:string,first:int,plot:int>"), lambda m: m["plot"] >= 0)
        return F.transform(F.sort_array(F.transform(met, lambda m: F.struct(m["plot"].alias("plot"), m["first"].alias("first")))), lambda m: m["first"])

    def line_ends(x: Column) -> Column:
        """For each label the place after the next line end, or none."""
        ends = running_total(F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["labels"])), x["labels"], lambda t, f: F.length(t) + F.length(f)))
        after = F.slice(x["between"], F.lit(2), F.size(x["labels"]))
        own = F.zip_with(ends, after, lambda e, t: F.when(F.instr(t, "\n") > 0, e + F.instr(t, "\n")))
        return F.reverse(scan(F.reverse(own), F.lit(None), lambda later, e: F.coalesce(e, later), "int"))

    def bodies(x: Column) -> Column:
        found = F.struct(x["blocks"].alias("blocks"), line_ends(x).alias("ends"))
        return let(found, lambda y: F.zip_with(x["number"], firsts(x), lambda p, i: F.struct(p.alias("p"), body(y, i).alias("body"))))

    def body(y: Column, i: Column) -> Column:
        return F.coalesce(piece(y["blocks"], F.try_element_at(y["ends"], i + 1), F.lit(200)), F.lit(""))

    parts = F.struct(labels.alias("labels"), F.split(lined, _PLOT, -1).alias("between"), blocks_of(lined).alias("blocks"))
    many = let(parts, lambda x: let(numbered(x), bodies))
    few = let_sql(F.struct(lined.alias("t"), labels.alias("m"), F.split(lined, _PLOT, -1).alias("b")), _FEW_PLOTS)
    return F.when(F.size(labels) <= FEW, few).otherwise(many)


def _item(**fields: Column) -> Column:
    def typed(name, kind):
        return fields.get(name, F.lit(None)).cast(kind).alias(name)

    return F.struct(
        typed("property_address", "string"), typed("plot_number", "string"),
        typed("description", "string"), typed("quantity", WIDE), typed("unit_price", WIDE),
        typed("amount", WIDE), typed("operative_names", "array<string>"),
    )


def plots_part(lined: Column) -> Column:
    """The text from the first word that can label a plot: all labels and what describes them."""
    return F.regexp_extract(lined, _PLOTS_PART, 0)


def plot_labels(lined: Column) -> Column:
    return F.regexp_extract_all(lined, F.lit(_PLOT), F.lit(0))


def _operatives(lined: Column) -> Column:
    return F.regexp_extract_all(lined, F.lit(_OPERATIVE), F.lit(1))


def item_count(lined: Column, labels: Column) -> Column:
    """How many items ``work_items`` gives, without making them."""
    return F.when(F.size(labels) > 0, F.size(labels)).otherwise(F.size(_operatives(lined)))


def work_items(lined: Column, plots: Column | None = None, labels: Column | None = None) -> Column:
    """One item per plot label, described by what follows its line; else one per operative.

    ``plots``, ``labels``: ``plots_part`` and its ``plot_labels`` where they are columns already.
    """
    plots = lined if plots is None else plots
    labels = plot_labels(plots) if labels is None else labels
    from_plots = F.transform(
        _plot_bodies(plots, labels),
        lambda y: _item(
            plot_number=y["p"],
            description=F.when(F.length(y["body"]) >= 50, blank_to_null(strip(y["body"]))),
            operative_names=F.array(),
        ),
    )
    by_name = F.transform(_operatives(lined), lambda o: _item(operative_names=F.array(o)))
    return F.when(F.size(labels) > 0, from_plots).otherwise(by_name).cast(f"array<{WORK_ITEM}>")


def table_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Score per table; ``cells`` is long form (keys, table_no, row_no, col_no, cell).

    Plain sums with map-side combining, so one huge table does not land on one task as rows.
    """
    cell = F.coalesce(F.col("cell"), F.lit(""))
    per_cell = F.when(cell.rlike(r"[£$€]\s*[\d,.]+"), 1.0).otherwise(0.0) + F.when(
        F.length(cell) > 20, 0.5
    ).otherwise(0.0)
    header = F.col("row_no") == 0
    keyword = sum(
        (
            F.max(F.when(header & F.contains(F.lower(cell), F.lit(k)), 2.0).otherwise(0.0))
            for k in V.TABLE_KEYWORDS
        ),
        F.lit(0.0),
    )
    return cells.groupBy(*keys, "table_no").agg((F.sum(per_cell) + keyword).alias("score"))


def best_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Best-scoring table per document, first on ties, none at score 0."""
    scores = table_scores(cells, keys).filter("score > 0")
    best = F.max(F.struct(F.col("score"), (-F.col("table_no")).alias("neg_no")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.neg_no")).alias("table_no"), F.col("b.score").alias("score")
    )


def table_items(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Items of tables in long form: the header row gives each role its first matching column."""
    table = [*keys, "table_no"]
    lowered = F.lower(strip(F.coalesce(F.col("cell"), F.lit(""))))

    def role_column(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(lowered, F.lit(w))
        return F.min(F.when(hit, F.col("col_no")))

    roles = (
        cells.filter("row_no = 0")
        .groupBy(*table)
        .agg(*[role_column(words).alias(f"_{role}") for role, words in V.TABLE_ROLES])
    )

    def value(role):
        return F.max(F.when(F.col("col_no") == F.col(f"_{role}"), strip(F.col("cell"))))

    rows = (
        cells.filter("row_no > 0")
        .join(roles, table)
        .groupBy(*table, "row_no")
        .agg(*[value(role).alias(role) for role, _ in V.TABLE_ROLES])
    )
    amount = parse_money(F.col("amount"))
    out = rows.withColumns(
        {
            "quantity": parse_money(F.col("quantity")),
            "unit_price": parse_money(F.col("unit_price")),
            "amount": amount,
        }
    )
    keep = (
        (F.coalesce("description", F.lit("")) != "")
        | (F.coalesce("plot_number", F.lit("")) != "")
        | (F.coalesce("amount", F.lit(0).cast(WIDE)) != 0)
    )
    return out.filter(keep)


def merge_table_items(text_items: Column, table_items_: Column) -> Column:
    """Items from text, then items from tables."""
    empty = F.array().cast(f"array<{WORK_ITEM}>")
    return F.concat(F.coalesce(text_items, empty), F.coalesce(table_items_, empty))


def line_amount(quantity: Column, unit_price: Column, amount: Column | None = None) -> Column:
    product = F.coalesce(quantity, F.lit(1).cast("decimal(12,2)")) * unit_price
    return product if amount is None else F.coalesce(amount, product)


def invoice_totals(items: DataFrame, keys: list[str], discount: Column | None = None) -> DataFrame:
    """Subtotal, tax of rated items, total less discount. ``items``: amount, tax_rate columns."""
    zero = F.lit(0).cast("decimal(18,2)")
    rated = F.when(
        (F.coalesce(F.col("tax_rate"), F.lit(0)) != 0),
        F.col("amount") * (F.col("tax_rate").cast("decimal(7,4)") * F.lit("0.01").cast("decimal(3,2)")),
    )
    out = items.groupBy(*keys).agg(
        F.coalesce(F.sum("amount"), zero).alias("subtotal"),
        F.coalesce(F.sum(rated), zero).alias("tax_total"),
        F.count(F.lit(1)).alias("n_items"),
        *([F.max(discount).alias("discount")] if discount is not None else []),
    )
    less = F.coalesce(F.col("discount"), zero) if discount is not None else zero
    return out.withColumn("total", F.col("subtotal") + F.col("tax_total") - less)


def subtotal_from_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of A2: only sums above zero count as a subtotal."""
    return items.groupBy(*keys).agg(F.sum("amount").alias("s")).select(
        *keys, F.when(F.col("s") > 0, F.col("s")).alias("subtotal")
    )
