"""Scans over an array inside a row, and pieces of a long text, in time that grows with their length.

A fold that appends to an array copies it at every step, and a substring of a long text is searched from its
start; both are quadratic. A scan here works in chunks: one fold keeps the state at the end of each chunk, then
every chunk is folded from its own start, so that only short arrays are copied. A text that is asked for many
pieces is cut into blocks once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk, characters of a block.
CHUNK, BLOCK = 64, 512


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``c`` worked out once, for bodies that mention their input many times."""
    return F.element_at(F.transform(F.array(c), body), 1)


def some_of(xs: Column, low: Column, high: Column) -> Column:
    """Elements from place ``low`` to ``high``, missing ones beyond the end. ``slice`` copies the whole array first."""
    return F.transform(F.sequence(low, high), lambda k: F.get(xs, k))


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The state after each element: ``step(state, element)``, all states of type ``kind``."""

    def chunks(xs: Column) -> Column:
        last = F.size(xs) - 1
        begins = F.sequence(F.lit(0), last, F.lit(CHUNK))
        return F.transform(begins, lambda j: some_of(xs, j, F.least(j + (CHUNK - 1), last)))

    begin = start.cast(kind)

    def after(seen: Column, otherwise: Column) -> Column:
        return F.when(F.size(seen) > 0, F.get(seen, F.size(seen) - 1)).otherwise(otherwise)

    def last_state(chunk: Column, state: Column) -> Column:
        return F.aggregate(chunk, state, lambda now, x: step(now, x).cast(kind))

    def states(chunk: Column, state: Column) -> Column:
        nothing = F.array().cast(f"array<{kind}>")
        return F.aggregate(chunk, nothing, lambda seen, x: F.array_append(seen, step(after(seen, state), x).cast(kind)))

    def ends(cs: Column) -> Column:
        nothing = F.array().cast(f"array<{kind}>")
        return F.aggregate(cs, nothing, lambda seen, chunk: F.array_append(seen, last_state(chunk, after(seen, begin))))

    # Spark copies the whole state of a fold at each step: so one over the chunks keeps their last states only
    def joined(cs: Column) -> Column:
        def each(es: Column) -> Column:
            return F.flatten(F.transform(cs, lambda chunk, j: states(chunk, F.when(j > 0, F.get(es, j - 1)).otherwise(begin))))

        return let(ends(cs), each)

    nothing = F.array().cast(f"array<{kind}>")
    return let(items, lambda xs: F.when(F.size(xs) > 0, let(chunks(xs), joined)).otherwise(nothing))


def running_total(numbers: Column) -> Column:
    """Sums up to and including each element."""
    return scan(numbers, F.lit(0), lambda a, x: a + x, "int")


def blocks_of(text: Column) -> Column:
    """The text in blocks, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, first: Column, length: Column) -> Column:
    """``length`` characters from place ``first`` (0-based), fewer at the end of the text."""
    low = F.floor(first / BLOCK).cast("int")
    some = some_of(blocks, low, low + F.ceil(length / BLOCK).cast("int"))
    return F.substring(F.array_join(some, ""), (first - low * BLOCK + 1).cast("int"), length.cast("int"))
