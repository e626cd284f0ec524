"""Scans and pieces inside a row against plain Python, and their growth with the row."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from billspark.functions import fixed_values as V
from billspark.functions.arrays import blocks_of, piece, running_total, scan
from billspark.functions.text import find_nearby_text
from billspark.operators.items import work_items


def test_scans(spark):
    rng = random.Random(1)
    rows = [([rng.randint(-9, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 128, 129, 1000)] + [(None,)]
    df = spark.createDataFrame(rows, "x array<int>")
    longest = scan(F.col("x"), F.lit(None), lambda a, x: F.greatest(a, x), "int")
    for x, total, most in df.select("x", running_total(F.col("x")), longest).collect():
        assert total == (None if x is None else list(itertools.accumulate(x))) or x is None and total == []
        assert most == (list(itertools.accumulate(x, max)) if x else [])


def test_pieces(spark):
    text = "".join(random.Random(2).choice("abcé🙂\n") for _ in range(3000))
    places = [(0, 5), (510, 4), (511, 1), (512, 600), (1000, 2000), (2999, 5), (3000, 4), (0, 3000)]
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*[piece(blocks_of(F.col("t")), F.lit(a), F.lit(n)).alias(f"c{i}") for i, (a, n) in enumerate(places)]).first()
    assert list(got) == [text[a : a + n] for a, n in places]


def test_find_nearby_text_equals_python(spark):
    rng = random.Random(3)
    texts = ["", "total", "TotalTOTALtotal", "x" * 700 + "Total", None, "tota\nl total\n"] + [
        "".join(rng.choice(["total", "Tot", "al ", "é", "🙂", "\n", "word "]) for _ in range(rng.randint(0, 400))) for _ in range(60)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (0, 3, 100, 700):
        for text, got in df.select("t", find_nearby_text(F.col("t"), "Total", size)).collect():
            want = [text[max(0, m.start() - size) : m.end() + size] for m in re.finditer("total", text, re.I)] if text else []
            assert (got or []) == want
    assert df.select(find_nearby_text(F.col("t"), "")).first()[0] == []


def expected_items(text):
    labels = list(re.finditer(V.PLOT, text))
    out = []
    for label in labels:
        number = label.group(1)
        body = ""
        for other in labels:
            if other.group(0)[0].lower() == "p" and other.group(1).lower().startswith(number.lower()):
                end = text.find("\n", other.end())
                body = text[end + 1 : end + 201] if end >= 0 else ""
                break
        out.append((number, body.strip() or None if len(body) >= 50 else None))
    return out


def test_work_items_equal_python(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 90)):
            parts.append(rng.choice(["Plot", "PROPERTY", "unit", "House"]) + rng.choice([" ", ": ", "#", ""]) + str(rng.randint(1, 140)) + rng.choice(["", "a", "B"]))
            parts.append(rng.choice([" and ", "\n", " done\n" + "work " * rng.randint(0, 30), " and brick work é\n"]))
        texts.append("".join(parts))
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for text, items in df.select("t", work_items(F.col("t"))).collect():
        assert [(i.plot_number, i.description) for i in items] == expected_items(text)


def seconds(df):
    best = 1e9
    for _ in range(2):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return best


def test_time_grows_with_the_row(spark):
    """Four times the row costs well under the sixteen times of a quadratic fold."""
    near, items = [], []
    for n in (5_000, 20_000):
        df = spark.createDataFrame([("some text here Total and more words " * n,)], "t string")
        near.append(seconds(df.select(F.size(F.array_distinct(find_nearby_text(F.col("t"), "total"))))))
    for n in (2_000, 8_000):
        text = "\n".join(f"Plot {i}{'abc'[i % 3]}\n{'work done here ' * 6}" for i in range(n))
        items.append(seconds(spark.createDataFrame([(text,)], "t string").select(F.size(work_items(F.col("t"))))))
    assert near[1] < 8 * near[0] and near[1] < 6 and items[1] < 8 * items[0] and items[1] < 8
