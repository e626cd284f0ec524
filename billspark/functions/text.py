"""Text columns: cleaning, lines, context, pages, quality of characters (TX1-TX10, A19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billspark.functions.arrays import blocks_of, let, piece, running_total
from billspark.functions.fixed_values import (
    CONTROL, UNUSUAL, WS, WS_CHARS, WS_LATIN, WS_LATIN_NOT_SPACE, WS_NOT_SPACE,
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let_sql(c: Column, body: str) -> Column:
    """As ``let`` with the body as SQL over ``x``: one expression to build, however long it is."""
    return F.element_at(F.call_function("transform", F.array(c), F.expr(f"x -> {body}")), 1)


def strip(c: Column) -> Column:
    """Both-side strip over Unicode whitespace (plain ``trim`` removes spaces only)."""
    return F.trim(c, F.lit(WS_CHARS))


# what has to change when whitespace runs become single spaces; lone spaces are not touched
_RUNS = rf"{WS}{{2,}}|{WS_NOT_SPACE}"
_LATIN_RUNS = rf"{WS_LATIN}{{2,}}|{WS_LATIN_NOT_SPACE}"
# nothing but line feeds, spaces and printable Latin: most texts. Every character is named: looked up, not compared
_PLAIN = r"\A[" + "".join(f"\\x{n:02x}" for n in (0x0A, *range(0x20, 0x7F), *range(0xA1, 0x100))) + r"]*\z"


def led(pattern: str, letters: str) -> str:
    """A ``(?i)`` pattern that looks at one letter before it tries its alternatives; ``letters``: all its first letters."""
    return pattern.replace("(?i", f"(?i)(?=[{letters}])(?i", 1)


def either_case(word: str) -> str:
    """A word as a pattern of ASCII letters in either case, quicker than ``(?i)``."""
    return "".join(f"[{x.lower()}{x.upper()}]" if x.isalpha() else f"\\{x}" for x in word)


def from_at(c: Column) -> Column:
    """The text from the word that holds the first ``@``, '' where there is none: no address begins before it."""
    before = F.substring_index(c, "@", 1)
    skipped = F.length(before) - F.length(F.substring_index(before, " ", -1))
    return F.when(F.contains(c, F.lit("@")), F.substring(c, skipped + 1, F.length(c))).otherwise("")


def is_plain(c: Column) -> Column:
    """Whether a text has neither control characters nor wide whitespace, as most have: ``plain`` of the two cleaners."""
    return F.coalesce(c, F.lit("")).rlike(_PLAIN)


def clean_text(c: Column, plain: Column | None = None) -> Column:
    """Whitespace runs become one space, control characters go, ends are stripped; null gives ''.

    Most texts hold neither control characters nor wide whitespace; one cheap look at the text
    spares them the slower patterns.
    """
    t = F.coalesce(c, F.lit(""))
    careful = F.regexp_replace(F.regexp_replace(t, _RUNS, " "), CONTROL, "")
    latin = F.regexp_replace(t, _LATIN_RUNS, " ")
    two = F.lit("  ")
    usual = let(
        F.replace(F.replace(t, F.lit("\n"), F.lit(" ")), two, F.lit(" ")),
        lambda x: F.when(F.contains(x, two), F.regexp_replace(x, " {2,}", " ")).otherwise(x),
    )
    plain = is_plain(c) if plain is None else plain
    return F.trim(F.when(plain, usual).when(t.rlike(UNUSUAL), careful).otherwise(latin))


def clean_lines(c: Column, plain: Column | None = None) -> Column:
    """Like ``clean_text`` but the line structure survives, for rules that read lines."""
    t = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), CONTROL, "")
    odd = r"[\r\x00-\x08\x0b-\x0c\x0e-\x1f]"

    def fewer(x: Column) -> Column:
        return F.regexp_replace(x, r"\n{3,}", "\n\n")

    usual = (is_plain(c) if plain is None else plain) & ~F.contains(t, F.lit("\n\n\n"))
    return strip(F.when(usual, t).when(t.rlike(odd), fewer(bare)).otherwise(fewer(t)))


def normalize_whitespace(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.trim(
        F.when(t.rlike(r"[\x{1680}-\x{3000}]"), F.regexp_replace(t, _RUNS, " ")).otherwise(
            F.regexp_replace(t, _LATIN_RUNS, " ")
        )
    )


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def extract_lines(c: Column) -> Column:
    """Non-blank stripped lines."""
    return F.filter(F.transform(split_lines(F.coalesce(c, F.lit(""))), strip), lambda x: x != "")


def extract_pattern(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, stripped; null when there is none or it is blank."""
    return blank_to_null(strip(F.regexp_extract(c, pattern, group)))


def extract_all(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def find_nearby_text(c: Column, keyword: str, context_chars: int = 100) -> Column:
    """Context around each case-insensitive hit, clipped at the ends of the text; none for an empty keyword.

    Time grows with the text and the hits, not with their product.
    """
    if not keyword:
        return F.when(c.isNotNull(), F.array().cast("array<string>"))
    quoted = keyword.replace("\\E", "\\E\\\\E\\Q")
    size, n = len(keyword), context_chars

    def windows(x: Column) -> Column:
        # every piece but the last is followed by a hit
        before = F.transform(F.slice(x["pieces"], F.lit(1), F.size(x["pieces"]) - 1), lambda p: F.length(p) + size)
        ends = running_total(before)
        return F.transform(ends, lambda end: window(x["blocks"], end))

    def window(blocks: Column, end: Column) -> Column:
        first = F.greatest(end - (size + n), F.lit(0))
        return piece(blocks, first, end + n - first)

    return let(F.struct(F.split(c, rf"(?i)\Q{quoted}\E", -1).alias("pieces"), blocks_of(c).alias("blocks")), windows)


def extract_with_context(df: DataFrame, text: str, pattern: str, context_lines: int = 2) -> DataFrame:
    """One row per matching line: match, line, surrounding lines, zero-based line number.

    Hits are found inside the row; only they are exploded, so a long text is not repeated per line.
    """
    n = F.lit(context_lines)

    def hit(lines, h):
        first = F.greatest(h["i"] - n, F.lit(0))
        last = F.least(h["i"] + n, F.size(lines) - 1)
        return F.struct(
            h["i"].alias("line_number"), h["l"].alias("line"),
            F.regexp_extract(h["l"], pattern, 0).alias("match"),
            F.array_join(F.slice(lines, first + 1, last - first + 1), "\n").alias("context"),
        )

    def hits(lines):
        numbered = F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i")))
        found = F.filter(numbered, lambda x: x["l"].rlike(pattern))
        return F.transform(found, lambda h: hit(lines, h))

    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.explode(let(split_lines(F.col(text)), hits)).alias("_h"))
    return rows.select(*kept, "_h.*")


def merge_pages(
    pages: DataFrame, keys: list[str], page_no: str = "page_no", text: str = "text",
    header: bool = False,
) -> DataFrame:
    """Non-empty pages of a document, in page order, joined by a blank line.

    The result is one text cell per document, so a group is no larger than the document itself.
    """
    kept = pages.filter(strip(F.col(text)) != "")
    body = F.col(text)
    if header:
        body = F.concat(F.lit("--- Page "), F.col(page_no), F.lit(" ---\n"), body)
    return (
        kept.select(*keys, F.struct(F.col(page_no).alias("n"), body.alias("t")).alias("_p"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_p")).alias("_p"))
        .select(*keys, F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n").alias("text"))
    )


def between_markers(c: Column, start: str, end: str) -> Column:
    """Text between two literal markers when both are there, else the whole text; stripped."""
    a = F.instr(c, start)
    b = F.instr(c, end)
    inner = F.substring(c, a + len(start), F.greatest(b - a - len(start), F.lit(0)))
    return strip(F.when((a > 0) & (b > 0), inner).otherwise(c))


def flatten_cells(cells: Column) -> Column:
    """One table row as ``a | b | c`` without blank cells."""
    return F.array_join(F.filter(F.transform(cells, strip), lambda x: x != ""), " | ")


def garbage_ratio(c: Column) -> Column:
    """Share of characters that are neither letters, digits nor whitespace."""
    junk = F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}\t\n\x0b\f\r\x1c-\x1f\x{{85}}\p{{Z}}]", ""))
    return junk / F.greatest(F.length(c), F.lit(1))


def is_garbage(c: Column) -> Column:
    return garbage_ratio(c) > 0.3


def is_valid_text(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & ((1 - garbage_ratio(c)) > 0.7), F.lit(False))


def title_case(c: Column) -> Column:
    """A capital after every non-letter ("O'Brien-Smith"), which ``initcap`` does not give."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def distinct_lines(variants: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct stripped lines longer than 3 characters, one row each: no group is gathered."""
    lines = variants.select(*keys, F.explode(split_lines(F.col(text))).alias("_l"))
    return (
        lines.select(*keys, strip(F.col("_l")).alias("line")).filter(F.length("line") > 3).distinct()
    )


def distinct_merge(variants: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Several readings of a document as one text of their distinct lines.

    A document with one reading keeps its text. Lines are deduplicated before any of them are
    gathered, so a much-copied line costs one row; what is gathered is the resulting text itself.
    Where a key is more than a document, use ``distinct_lines``. Order: longest first, then alphabetical.
    """
    counts = variants.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(text).alias("_only"))
    single = counts.filter("_n = 1").select(key, F.col("_only").alias("text"))
    merged = (
        distinct_lines(variants, [key], text)
        .select(key, F.struct((-F.length("line")).alias("n"), F.col("line").alias("l")).alias("_l"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("_l")).alias("_l"))
        .select(key, F.array_join(F.transform("_l", lambda p: p["l"]), "\n").alias("text"))
    )
    many = counts.filter("_n > 1").select(key)
    return single.unionByName(
        many.join(merged, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
    )
