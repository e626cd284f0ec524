"""Shared pieces of the comparison SQL (DuckDB dialect)."""

from __future__ import annotations

from billspark.functions import fixed_values as V


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def half_even(expr: str, by: int) -> str:
    """Integer division, half to even, for values not below zero."""
    e = f"({expr})"
    return (
        f"(({e} // {by}) + CASE WHEN 2 * ({e} % {by}) > {by} OR (2 * ({e} % {by}) = {by} "
        f"AND ({e} // {by}) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit(rf'^{V.WS}+|{V.WS}+' + chr(92) + 'z')}, '', 'g')"


def clean(expr: str) -> str:
    spaced = f"regexp_replace({expr}, {lit(V.WS + '+')}, ' ', 'g')"
    bare = rf"regexp_replace({spaced}, '[\x00-\x08\x0b-\x0c\x0e-\x1f]', '', 'g')"
    return strip(bare)


def lined(expr: str) -> str:
    unix = rf"regexp_replace({expr}, '\r\n?', chr(10), 'g')"
    bare = rf"regexp_replace({unix}, '[\x00-\x08\x0b-\x0c\x0e-\x1f]', '', 'g')"
    return strip(rf"regexp_replace({bare}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def find(expr: str, pattern: str, group: int = 1) -> str:
    got = f"regexp_extract({expr}, {lit(pattern)}, {group})"
    return f"nullif({strip(got)}, '')"


def date_of(expr: str) -> str:
    """Day-first slash or dash dates with two- or four-digit years."""
    four = f"CASE WHEN regexp_matches({expr}, '[/-][0-9]{{4}}$') THEN "
    two = f"CASE WHEN regexp_matches({expr}, '[/-][0-9]{{2}}$') THEN "
    return (
        f"coalesce({four} CAST(coalesce(try_strptime({expr}, '%d/%m/%Y'), "
        f"try_strptime({expr}, '%d-%m-%Y')) AS DATE) END, "
        f"{two} CAST(coalesce(try_strptime({expr}, '%d/%m/%y'), "
        f"try_strptime({expr}, '%d-%m-%y')) AS DATE) END)"
    )


def money(expr: str) -> str:
    bare = rf"regexp_replace({expr}, '[£$€,\s\p{{Z}}]', '', 'g')"
    digits = rf"regexp_replace({bare}, '[\-()]', '', 'g')"
    value = f"TRY_CAST({digits} AS DECIMAL(24,6))"
    return f"CASE WHEN regexp_matches({bare}, '^[-(]') THEN -{value} ELSE {value} END"


def pounds(cents: str) -> str:
    return f"('£' || format('{{:,.2f}}', ({cents})::DOUBLE / 100))"


LINES = """
lines AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
      l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC,
      l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
    FROM lineitem) WHERE rn = 1)
"""

ITEM_CENTS = half_even(
    "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))",
    100,
)

_CITY = "[" + ", ".join(lit(c) for c in V.UK_CITIES) + "]"

FACTS = f"""
{LINES},
item AS (
  SELECT l_orderkey, l_linenumber, coalesce(p_name, 'item') AS p_name, {ITEM_CENTS} AS cents
  FROM lines LEFT JOIN part ON l_partkey = p_partkey),
item_sum AS (
  SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS sub_c, count(*) AS n_items,
    string_agg('Plot ' || l_linenumber || ' - ' || p_name || ' - ' || {pounds("cents")},
      chr(10) ORDER BY l_linenumber) AS item_text
  FROM item GROUP BY l_orderkey),
facts AS (
  SELECT o_orderkey, o_custkey, o_orderdate, c_name, sub_c, n_items, item_text,
    {half_even("sub_c * 20", 100)} AS vat_c,
    sub_c + CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 0 END AS total_c
  FROM item_sum JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
"""

RENDERED = f"""
{FACTS},
rendered AS (
  SELECT o_orderkey AS doc_id, f.*, concat_ws(chr(10),
    c_name || ' LTD',
    (o_custkey % 200 + 1) || ' High Street',
    {_CITY}[o_custkey % {len(V.UK_CITIES)} + 1] || ', EC' || (o_custkey % 9 + 1) || 'A '
      || (o_custkey % 10) || 'BB',
    '', 'INVOICE',
    'Invoice Number: INV-' || o_orderkey,
    'Invoice Date: ' || CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%d/%m/%y')
      ELSE strftime(o_orderdate, '%d/%m/%Y') END,
    '', 'Contractor Details:', 'Name: John Smith',
    CASE WHEN o_orderkey % 11 <> 0 THEN 'UTR: ' || lpad(o_custkey::VARCHAR, 10, '0') END,
    CASE WHEN o_orderkey % 5 = 0 THEN 'NI: ' ELSE 'NI Number: ' END
      || CASE WHEN o_custkey % 17 = 0 THEN 'GB' ELSE 'AB' END
      || lpad((o_custkey % 1000000)::VARCHAR, 6, '0')
      || CASE WHEN o_custkey % 23 = 0 THEN 'Z' ELSE 'C' END,
    'Email: Customer' || o_custkey || CASE WHEN o_custkey % 29 = 0 THEN '@nodot'
      ELSE '@Example.com' END,
    'Phone: 07' || lpad(o_custkey::VARCHAR, 9, '0'),
    '', 'Bank Details:',
    'Sort Code: ' || lpad((o_custkey % 1000000)::VARCHAR, 6, '0')[1:2] || '-'
      || lpad((o_custkey % 1000000)::VARCHAR, 6, '0')[3:4] || '-'
      || lpad((o_custkey % 1000000)::VARCHAR, 6, '0')[5:6],
    'Account Number: ' || lpad(o_custkey::VARCHAR, 8, '0'),
    '',
    'Work Period: ' || strftime(o_orderdate - INTERVAL 14 DAY, '%d/%m/%Y') || ' to '
      || strftime(o_orderdate - INTERVAL 1 DAY, '%d/%m/%Y'),
    '', 'Work Items:', item_text, '', 'Operatives: John Smith, Mary Jones', '',
    CASE WHEN o_orderkey % 17 <> 0 THEN 'Subtotal: ' || CASE WHEN o_orderkey % 19 = 0
      THEN '£' || format('{{:,}}', sub_c // 100) ELSE {pounds("sub_c")} END END,
    'VAT @ 20%: ' || {pounds("vat_c")},
    'CIS Deduction: ' || {pounds("vat_c")},
    'Total Due: ' || {pounds("total_c")}) AS text
  FROM facts f),
cleaned AS (SELECT *, {clean("text")} AS c FROM rendered)
"""


def over_rendered(select: str) -> str:
    return f"WITH {RENDERED} {select}"
