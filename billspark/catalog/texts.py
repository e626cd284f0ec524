"""Queries over documents, pages and conversations: text rules, other profiles, readings, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from billspark.catalog import inputs as I
from billspark.catalog.registry import query
from billspark.catalog.sql_text import clean, lit, lined, strip
from billspark.functions import fields, fields_loose as loose, files, fixed_values as V, model_json, score, text as X
from billspark.operators import attempts, stats
from billspark.sources.tables import table


def _docs(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def _md5(c):
    return F.md5(c.cast("binary"))


@query("clean_text", f"SELECT doc_id, md5({clean('text')}) AS cleaned, length({clean('text')}) AS n FROM documents")
def clean_text(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", X.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", _md5(F.col("c")).alias("cleaned"), F.length("c").cast("bigint").alias("n"))


@query("clean_lines", f"SELECT doc_id, md5({lined('text')}) AS cleaned FROM documents")
def clean_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _md5(X.clean_lines(F.col("text"))).alias("cleaned"))


_NORM = f"regexp_replace(html, {lit(V.WS + '+')}, ' ', 'g')"


@query("normalize_whitespace", f"SELECT page_id, md5({strip(_NORM)}) AS html_md5 FROM pages")
def normalize_whitespace(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", _md5(X.normalize_whitespace(F.col("html"))).alias("html_md5"))


_LINES_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


@query(
    "extract_lines",
    f"SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS body FROM (SELECT doc_id, {_LINES_SQL} AS l FROM documents)",
)
def extract_lines(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.extract_lines(F.col("text")).alias("l"))
    return rows.select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), _md5(F.array_join("l", "\n")).alias("body")
    )


_KEYWORD = "ation"


@query(
    "find_nearby_text",
    f"""WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '(?i){_KEYWORD}') AS pc FROM documents),
    h AS (SELECT doc_id, text, n, CAST(list_sum(list_transform(pc[1:n], lambda x: length(x))) AS BIGINT) + (n - 1) * {len(_KEYWORD)} AS s
      FROM p, unnest(range(1, len(pc))) t(n))
    SELECT doc_id, n AS hit, md5(text[greatest(s - 100, 0) + 1 : s + {len(_KEYWORD)} + 100]) AS context FROM h""",
)
def find_nearby_text(spark, sf_dir):
    near = X.find_nearby_text(F.col("text"), _KEYWORD)
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(near).alias("hit", "c"))
    return rows.select("doc_id", (F.col("hit") + 1).cast("bigint").alias("hit"), _md5(F.col("c")).alias("context"))


_CONTEXT_PATTERN = r"[0-9]+\.[0-9]{2}|@"


@query(
    "extract_with_context",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    r AS (SELECT doc_id, ls, n FROM l, unnest(range(1, len(ls) + 1)) t(n))
    SELECT doc_id, n - 1 AS line_number, regexp_extract(ls[n], {lit(_CONTEXT_PATTERN)}, 0) AS match, ls[n] AS line,
      md5(array_to_string(ls[greatest(n - 2, 1) : n + 2], chr(10))) AS context
    FROM r WHERE regexp_matches(ls[n], {lit(_CONTEXT_PATTERN)})""",
)
def extract_with_context(spark, sf_dir):
    rows = X.extract_with_context(_docs(spark, sf_dir), "text", _CONTEXT_PATTERN)
    return rows.select(
        "doc_id", F.col("line_number").cast("bigint").alias("line_number"), "match", "line",
        _md5(F.col("context")).alias("context"),
    )


@query(
    "extract_all_patterns",
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '([A-Z][a-z]+)\s', 1),
    lambda x: trim(x)), lambda x: x <> ''), ' ') AS found FROM documents""",
)
def extract_all_patterns(spark, sf_dir):
    found = X.extract_all(F.col("text"), r"([A-Z][a-z]+)\s")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(found, " ").alias("found"))


@query(
    "merge_pages",
    """SELECT conv_id, md5(string_agg('--- Page ' || turn || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS body,
    count(*) AS n_pages FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""",
)
def merge_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations", "conv_id", F.col("turn").alias("page_no"), "text")
    merged = X.merge_pages(pages, ["conv_id"], header=True)
    n = pages.filter(X.strip(F.col("text")) != "").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return merged.join(n, "conv_id").select("conv_id", _md5(F.col("text")).alias("body"), "n_pages")


@query(
    "between_markers",
    f"""SELECT page_id, md5({strip("CASE WHEN position('<p>' IN html) > 0 AND position('</p>' IN html) > 0 THEN html[position('<p>' IN html) + 3 : position('</p>' IN html) - 1] ELSE html END")}) AS body
    FROM pages""",
)
def between_markers(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", _md5(X.between_markers(F.col("html"), "<p>", "</p>")).alias("body"))


_ALNUM = r"[\p{L}\p{N}\t\n\x0b\f\r\x1c-\x1f\x{85}\p{Z}]"
_JUNK = f"(length(regexp_replace(text, {lit(_ALNUM)}, '', 'g'))::DOUBLE / greatest(length(text), 1))"


@query(
    "text_quality",
    f"SELECT doc_id, round({_JUNK}, 6) AS ratio, {_JUNK} > 0.3 AS garbage, length(text) > 0 AND 1 - {_JUNK} > 0.7 AS valid FROM documents",
)
def text_quality(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.round(X.garbage_ratio(t), 6).alias("ratio"), X.is_garbage(t).alias("garbage"),
        X.is_valid_text(t).alias("valid"),
    )


@query(
    "title_case",
    r"""SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+|\P{L}+', 0),
    lambda x: CASE WHEN x[1] = 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), '')) AS name FROM documents""",
)
def title_case(spark, sf_dir):
    """The whole text; its digest is compared."""
    return _docs(spark, sf_dir).select("doc_id", _md5(X.title_case(F.col("text"))).alias("name"))


@query(
    "distinct_lines",
    f"""WITH l AS (SELECT DISTINCT source, {strip('line')} AS line FROM documents, unnest(string_split(text, chr(10))) t(line))
    SELECT source, md5(line) AS line, length(line) AS n FROM l WHERE length(line) > 3""",
)
def distinct_lines(spark, sf_dir):
    lines = X.distinct_lines(table(spark, sf_dir, "documents", "source", "text"), ["source"])
    return lines.select("source", _md5(F.col("line")).alias("line"), F.length("line").cast("bigint").alias("n"))


@query(
    "distinct_merge",
    f"""WITH v AS (SELECT conv_id, text FROM conversations),
    l AS (SELECT DISTINCT conv_id, {strip('line')} AS line FROM v, unnest(string_split(text, chr(10))) t(line)),
    m AS (SELECT conv_id, md5(string_agg(line, chr(10) ORDER BY length(line) DESC, encode(line))) AS body FROM l WHERE length(line) > 3 GROUP BY conv_id),
    c AS (SELECT conv_id, count(*) AS n, md5(min(text)) AS sole FROM v GROUP BY conv_id)
    SELECT conv_id, CASE WHEN n = 1 THEN sole ELSE coalesce(body, md5('')) END AS body FROM c LEFT JOIN m USING (conv_id)""",
)
def distinct_merge(spark, sf_dir):
    """The turns of a conversation as readings of one document."""
    merged = X.distinct_merge(table(spark, sf_dir, "conversations", "conv_id", "text"), "conv_id")
    return merged.select("conv_id", _md5(F.col("text")).alias("body"))


@query("document_emails", f"SELECT doc_id, lower(nullif({strip('regexp_extract(text, ' + lit(V.EMAIL) + ', 0)')}, '')) AS email FROM documents")
def document_emails(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fields.email(F.col("text")).alias("email"))


@query(
    "document_amounts",
    f"""SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(replace(regexp_extract(a[n], '[0-9][0-9,.]*', 0), ',', '') AS DECIMAL(18,2))::DOUBLE AS amount
    FROM (SELECT doc_id, regexp_extract_all(text, {lit(V.MONEY_2DP)}, 0) AS a FROM documents), unnest(range(1, len(a) + 1)) t(n)""",
)
def document_amounts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(fields.all_amounts(F.col("text"))).alias("n", "a"))
    return rows.select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), F.col("a").cast("double").alias("amount"))


# ---- readings of several engines -----------------------------------------------------------------------------

_READ_SQL = """r AS (SELECT conv_id AS doc_id, turn AS engine_rank, role || turn AS engine, text FROM conversations)"""


def _readings(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("engine_rank"),
        F.concat("role", F.col("turn").cast("string")).alias("engine"), "text",
    )


@query(
    "longest_text",
    f"""WITH {_READ_SQL} SELECT doc_id, engine, md5(text) AS body FROM r WHERE trim(text) <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, engine_rank) = 1""",
)
def longest_text(spark, sf_dir):
    return attempts.longest_text(_readings(spark, sf_dir), ["doc_id"]).select("doc_id", "engine", _md5(F.col("text")).alias("body"))


@query(
    "first_nonblank_text",
    f"""WITH {_READ_SQL} SELECT doc_id, engine, md5(text) AS body FROM r WHERE trim(text) <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY engine_rank) = 1""",
)
def first_nonblank_text(spark, sf_dir):
    return attempts.first_nonblank_text(_readings(spark, sf_dir), ["doc_id"]).select("doc_id", "engine", _md5(F.col("text")).alias("body"))


@query(
    "ocr_word_filter",
    """WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS word_no, l_returnflag || l_partkey AS word,
      CAST(floor(l_quantity) AS BIGINT) * 2 AS conf FROM lineitem)
    SELECT doc_id, string_agg(word, ' ' ORDER BY word_no, word) AS text, round(avg(conf), 6) AS confidence, count(*) AS word_count
    FROM w WHERE conf > 30 GROUP BY doc_id""",
)
def ocr_word_filter(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("word_no"),
        F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text"),
        (F.floor("l_quantity") * 2).alias("conf"),
    )
    return stats.ocr_word_filter(words).withColumn("confidence", F.round("confidence", 6))


# ---- other profiles on free text -----------------------------------------------------------------------------

_SKIP = "(" + " OR ".join(f"contains(lower({strip('x')}), {lit(w)})" for w in V.LOOSE_NAME_SKIP) + ")"
_COMPANY = "(" + " OR ".join(f"contains(x, {lit(w)})" for w in V.LOOSE_NAME_COMPANY) + ")"
_WORDS = f"list_filter(regexp_split_to_array({strip('x')}, {lit(V.WS + '+')}), lambda w: w <> '')"
_LOOKS = (
    f"(len({_WORDS}) BETWEEN 2 AND 4 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\\p{{L}}') "
    "AND NOT regexp_matches(w, '^\\p{Lu}'))) = 0)"
)
_LATER = "(" + " OR ".join(f"contains(lower({strip('x')}), {lit(w)})" for w in V.LOOSE_NAME_FALLBACK_SKIP) + ")"


@query(
    "loose_name",
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
    SELECT doc_id, coalesce({strip(f"list_filter(ls[1:20], lambda x: NOT {_SKIP} AND ({_COMPANY} OR {_LOOKS}))[1]")},
      {strip(f"list_filter(ls, lambda x: length({strip('x')}) > 3 AND NOT {_LATER})[1]")}, '') AS name FROM l""",
)
def loose_name(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", loose.loose_name(X.split_lines(F.col("text"))).alias("name"))


_HELP = " OR ".join(f"contains(lower(text), {lit(w)})" for w in loose.HELP_WORDS)
_GREET = " OR ".join(f"contains(lower(text), {lit(w)})" for w in loose.GREETING_WORDS)


@query(
    "intent_of_text",
    f"SELECT conv_id, turn, CASE WHEN {_HELP} THEN 'help' WHEN {_GREET} THEN 'greeting' ELSE 'other' END AS intent FROM conversations",
)
def intent_of_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", loose.intent_of_text(F.col("text")).alias("intent"))


_PIPE = "CASE WHEN k < 80 THEN event_type || ' | ' || k || ' | ' || value WHEN k < 90 THEN event_type || '|x|1' ELSE event_type END"


@query(
    "pipe_item",
    f"""WITH {I.EVENTS} SELECT event_id, event_type AS description,
      CASE WHEN k < 80 THEN k::DOUBLE END AS quantity, k < 80 AS valid FROM ev""",
)
def pipe_item(spark, sf_dir):
    k = F.col("k")
    line = (
        F.when(k < 80, F.concat_ws(" | ", "event_type", k.cast("string"), F.col("value").cast("string")))
        .when(k < 90, F.concat("event_type", F.lit("|x|1"))).otherwise(F.col("event_type"))
    )
    return I.events(spark, sf_dir).select("event_id", loose.pipe_item(line).alias("i")).select(
        "event_id", "i.description", F.col("i.quantity").cast("double").alias("quantity"), "i.valid"
    )


_FIELDS = ["contractor_name", "contractor_email", "invoice_date", "amount", "vat"]
_ANSWERS = ["Smith & Co", "a@b.co", "15/01/2024", "32/01/2024", "£1,200.50", "", "12 pounds", "   "]
_OK = {  # which answers each field accepts, worked out by hand
    "contractor_name": [0, 1, 2, 3, 4, 6], "contractor_email": [1], "invoice_date": [2],
    "amount": [4], "vat": [4],
}
_OK_SQL = " OR ".join(
    f"(user_id % {len(_FIELDS)} = {i} AND k % {len(_ANSWERS)} IN ({', '.join(map(str, _OK[f]))}))" for i, f in enumerate(_FIELDS)
)


@query("chat_field", f"WITH {I.EVENTS} SELECT event_id, {_OK_SQL} AS accepted FROM ev")
def chat_field(spark, sf_dir):
    name, answer = I.pick(_FIELDS, F.col("user_id")), I.pick(_ANSWERS, F.col("k"))
    return I.events(spark, sf_dir).select("event_id", loose.chat_field(name, answer).alias("accepted"))


# ---- files -------------------------------------------------------------------------------------------------------

_EXTS = [".pdf", ".JPG", ".jpeg", ".png", ".docx", ".txt", ".csv", ".tiff", ".xyz", "", ".doc", ".gif"]
_TYPE = ["pdf", "image", "image", "image", "docx", "text", "text", "image", "unknown", "unknown", "docx", "image"]
_SIX = ["pdf", "jpg", "jpeg", "png", "docx", "text", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown"]
_DEFAULT = ["pdf", "image", "image", "image", "docx", "image", "image", "image", "image", "image", "docx", "image"]
_GENERIC = ["pdf", "image", "image", "image", "docx", "unsupported", "unsupported", "image", "unsupported", "unsupported", "unsupported", "unsupported"]
_UPLOAD = [".pdf", ".JPG", ".jpeg", ".png", ".docx"]


def _paths():
    return F.concat(F.lit("/landing/d"), F.col("doc_id").cast("string"), I.pick(_EXTS, F.col("doc_id")))


@query(
    "file_types",
    f"""SELECT doc_id, {I.sql_pick(_TYPE, 'doc_id')} AS by_extension, {I.sql_pick(_SIX, 'doc_id')} AS six,
    {I.sql_pick(_DEFAULT, 'doc_id')} AS image_default, {I.sql_pick(_GENERIC, 'doc_id')} AS generic,
    doc_id % {len(_EXTS)} < 5 AND doc_id % 2 = 0 AS upload_ok FROM documents""",
)
def file_types(spark, sf_dir):
    p = _paths()
    mime = F.when(F.col("doc_id") % 2 == 0, "application/pdf").otherwise("text/html")
    return table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", files.file_type_by_ext(p).alias("by_extension"), files.file_kind_six(p).alias("six"),
        files.file_kind_image_default(p).alias("image_default"), files.file_kind_generic(p).alias("generic"),
        files.is_upload_allowed(p, mime).alias("upload_ok"),
    )


_HEADS = ["%PDF-1.7 ", "", "GIF89a", "BM", "PK\x03\x04 word/document.xml ", "PK\x03\x04 other "]


@query(
    "file_type_by_content",
    r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN 'docx'
    WHEN 1 THEN CASE WHEN starts_with(text, 'BM') THEN 'image'
      WHEN regexp_matches(text[1:1024], '^[\x20-\x7e\n\r\t]*\z') THEN 'text' ELSE 'unknown' END
    ELSE 'unknown' END AS kind FROM documents""",
)
def file_type_by_content(spark, sf_dir):
    content = F.concat(I.pick(_HEADS, F.col("doc_id")), F.col("text")).cast("binary")
    return _docs(spark, sf_dir).select(
        "doc_id", files.detect_file_type(F.lit("/landing/noext"), content).alias("kind")
    )


@query(
    "decode_text",
    r"SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS body FROM documents",
)
def decode_text(spark, sf_dir):
    """Every second text arrives as Latin-1 bytes where it can be written so; both must read the same."""
    latin = F.encode("text", "ISO-8859-1")
    fits = F.decode(latin, "ISO-8859-1") == F.col("text")
    plain = F.length("text") == F.octet_length("text")
    odd = ~F.is_valid_utf8(latin.cast("string"))
    content = F.when((F.col("doc_id") % 2 == 1) & fits & (odd | plain), latin).otherwise(F.col("text").cast("binary"))
    return _docs(spark, sf_dir).select("doc_id", _md5(files.decode_text(content)).alias("body"))


@query(
    "supported_files",
    f"""SELECT doc_id, CASE WHEN n_chars * 1000 > {V.MAX_FILE_BYTES} THEN 'too_large'
    WHEN {I.sql_pick(_SIX, 'doc_id')} = 'unknown' THEN 'unsupported_format' END AS reason FROM documents""",
)
def supported_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    return d.select("doc_id", files.reject_reason(_paths(), F.col("n_chars") * 1000).alias("reason"))


@query(
    "safe_upload_name",
    r"""SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || regexp_replace(event_type || ' (' || k || ')/é.pdf', '[^\p{L}\p{N}._-]', '', 'g') AS name
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def safe_upload_name(spark, sf_dir):
    raw = F.concat("event_type", F.lit(" ("), F.col("k").cast("string"), F.lit(")/é.pdf"))
    return I.events(spark, sf_dir).select("event_id", files.safe_upload_name(F.col("ts"), raw).alias("name"))


# ---- model answers ----------------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    body = F.concat(
        F.lit('{"invoice_number": "INV-'), k.cast("string"), F.lit('", "subtotal": '), cents,
        F.lit(', "vat_amount": "'), (k % 100).cast("string"), F.lit('", "cis_amount": null, "customer_name": '),
        F.when(k % 4 == 0, "null").otherwise('"Acme"'), F.lit(', "items": [{"description": "Bricks", "quantity": '),
        (k % 9).cast("string"), F.lit(', "unit_price": 2.5, "tax_rate": '), (k % 3 * 10).cast("string"), F.lit("}]}"),
    )
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("```"), body, F.lit("```")))
        .when(k % 5 == 2, F.concat(F.lit("Sorry, "), body)).otherwise(body)
    )
    return o.select("o_orderkey", model_json.parse_model_json(raw).alias("p"))


@query(
    "parse_model_json",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'INV-' || o_orderkey END AS invoice_number,
    CASE WHEN o_orderkey % 5 = 2 THEN 'Failed to parse response' END AS error FROM orders""",
)
def parse_model_json(spark, sf_dir):
    return _answers(spark, sf_dir).select("o_orderkey", "p.data.invoice_number", "p.error")


@query(
    "json_to_flat_invoice",
    """SELECT o_orderkey, 'INV-' || o_orderkey AS invoice_number, '' AS contractor_name, round(o_totalprice * 100)::DOUBLE AS subtotal,
    round(o_totalprice * 100)::DOUBLE + o_orderkey % 100 AS total FROM orders WHERE o_orderkey % 5 <> 2""",
)
def json_to_flat_invoice(spark, sf_dir):
    good = _answers(spark, sf_dir).filter("p.error IS NULL")
    flat = model_json.json_to_flat_invoice(F.col("p.data"), "ai_vision")
    return good.select(
        "o_orderkey", flat["invoice_number"].alias("invoice_number"), flat["contractor_name"].alias("contractor_name"),
        flat["subtotal"].cast("double").alias("subtotal"), flat["total"].cast("double").alias("total"),
    )


@query(
    "json_to_invoice",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown Customer' ELSE 'Acme' END AS customer_name, 'USD' AS currency,
    (o_orderkey % 9) * 2.5::DOUBLE AS amount, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3 * 10)::DOUBLE END AS tax_rate
    FROM orders WHERE o_orderkey % 5 <> 2""",
)
def json_to_invoice(spark, sf_dir):
    good = _answers(spark, sf_dir).filter("p.error IS NULL")
    return good.select("o_orderkey", model_json.json_to_invoice(F.col("p.data")).alias("i")).select(
        "o_orderkey", "i.customer_name", "i.currency", F.col("i.items")[0]["amount"].cast("double").alias("amount"),
        F.col("i.items")[0]["tax_rate"].cast("double").alias("tax_rate"),
    )


@query(
    "field_fill_quality",
    f"""SELECT doc_id, round(CASE WHEN f = 0 THEN 0.1 WHEN f < 3 OR {_JUNK} > 0.3 THEN least(1.0, f / 8.0::DOUBLE) * 0.6
      ELSE least(1.0, f / 8.0::DOUBLE) END, 6)::DOUBLE AS quality
    FROM (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END
      + CASE WHEN n_chars <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END AS f FROM documents)""",
)
def field_fill_quality(spark, sf_dir):
    d = _docs(spark, sf_dir, "lang", "source", "n_chars")
    q = score.field_fill_quality(
        F.col("text"), [F.when(F.col("lang") == "en", F.col("lang")), F.col("source")],
        [F.col("n_chars"), F.col("doc_id") % 4],
    )
    return d.select("doc_id", F.round(q, 6).alias("quality"))
