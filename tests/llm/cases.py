"""Tables with the cases that every text operator must answer."""

from __future__ import annotations

import random

LONG = " ".join(f"word{i % 997} item{i % 89}." for i in range(20_000))


def awkward_documents(spark, texts=()):
    """Missing ids and texts, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "The first short text of the table.\nA second line that is long enough to count."),
        (2, None),
        (3, ""),
        (4, " \n \t\n"),
        (5, LONG),
        (6, "The first short text of the table.\nA second line that is long enough to count."),
        (6, "The first short text of the table.\nA second line that is long enough to count."),
        (None, "No id here, but a text.\nA second line that is long enough to count."),
        (9, "Ünïcödé 漢字 🙂 and\u2003spaces\u00a0of all kinds"),
        *[(100 + i, text) for i, text in enumerate(texts)],
    ]
    full = [(i, t, f"drop{k}", k, [k], None, 1.5) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, `drop` string, n_chars long, token array<int>, component string, `a.b``c` double"
    return rows, spark.createDataFrame(full, schema)


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def random_texts(seed: int, n: int, words: int = 30, vocabulary: int = 12) -> list[str]:
    """Texts over few words, many of them edited copies of earlier ones."""
    rng = random.Random(seed)
    out: list[list[str]] = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            text = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = f"w{rng.randrange(vocabulary * 5)}"
        else:
            text = [f"w{rng.randrange(vocabulary * 20)}" for _ in range(rng.randint(0, words))]
        out.append(text)
    return [" ".join(t) for t in out]
