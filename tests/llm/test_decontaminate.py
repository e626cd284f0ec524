import random

from billspark.llm.common import sha
from billspark.llm.decontaminate import Automaton, contamination, decontaminate, find_passages, words_of
from tests.llm.cases import awkward_documents, no_documents

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short item, three!"),
    (3, None),
    (4, "..."),
    (5, "three four five six seven eight nine ten eleven twelve thirteen"),
    (10, "short ITEM three"),
    (11, "a a a a a a a a a a a a"),
]


def windows(items, size=10):
    for item, text in items:
        words = words_of(text or "")
        if words:
            k = min(size, len(words))
            for p in range(len(words) - k + 1):
                yield item, words[p : p + k]


def brute(text, items, size=10):
    words, hit, names = words_of(text or ""), set(), set()
    for item, window in windows(items, size):
        for p in range(len(words) - len(window) + 1):
            if words[p : p + len(window)] == window:
                hit |= set(range(p, p + len(window)))
                names.add(item)
    return len(words), len(hit), len(names), sha(",".join(sorted(map(str, names))).encode()), bool(hit)


def item_table(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")


TEXTS = [
    "x one two three four five six seven eight nine ten y", "ONE-two three; four five six seven eight nine ten eleven twelve thirteen",
    "short item three", "short item", "a " * 25, "a " * 9, "one two three four five six seven eight nine",
    "z short item three four five six seven eight nine ten eleven twelve one two three",
]


def test_equals_brute_force(spark):
    rows, docs = awkward_documents(spark, TEXTS)
    for shard_words in (200_000, 5):
        found = find_passages(docs, item_table(spark), shard_words=shard_words)
        assert found.count() == len(rows)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, item_table(spark)).collect())
    assert got == sorted((i or 0, *brute(t, ITEMS)) for i, t in rows)


def test_shards_are_united(spark, monkeypatch):
    import billspark.llm.decontaminate as module

    rows, docs = awkward_documents(spark, TEXTS)
    found = find_passages(docs, item_table(spark), shard_words=5)
    monkeypatch.setattr(module, "find_passages", lambda *a, **b: found)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, item_table(spark)).collect())
    assert got == sorted((i or 0, *brute(t, ITEMS)) for i, t in rows)


def test_automaton_on_random_words():
    rng = random.Random(8)
    for size in (2, 3, 5):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for k in range(6)]
        automaton = Automaton(items, size)
        for _ in range(200):
            text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))
            n, spans, names = automaton.hits(text)
            want = brute(text, items, size)
            assert (n, sum(h - l for l, h in spans), len(names)) == want[:3]


def test_spans_are_cut_out(spark):
    rows, docs = awkward_documents(spark, [f"keep these words, all of them, please; {TEXTS[0]} and these words too, all of them here", TEXTS[1], TEXTS[3]])
    clean = decontaminate(docs, item_table(spark))
    assert clean.columns == docs.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert 101 not in got and got[102].text == TEXTS[3]
    assert got[100].text == "keep these words, all of them, please; x  y and these words too, all of them here"
    assert got[100].n_chars == len(got[100].text)
    assert {i for i, _ in rows} - set(got) == {101}
    assert contamination(clean, item_table(spark)).filter("contaminated").count() == 0
    assert decontaminate(docs, item_table(spark, []).limit(0)).count() == len(rows)
    assert decontaminate(no_documents(spark), item_table(spark)).count() == 0


def whole_and_cut(texts, items, most_share=0.5):
    """What decontamination must leave, from the windows of all items at once; texts of words and single blanks."""
    out = {}
    for i, text in texts.items():
        words, first = text.split(" "), True
        while True:
            hit = set()
            for _, window in windows(items):
                for p in range(len(words) - len(window) + 1):
                    if words_of(" ".join(words[p : p + len(window)])) == window:
                        hit |= set(range(p, p + len(window)))
            if first and len(hit) > most_share * len(words):
                break
            if not hit:
                out[i] = " ".join(words)
                break
            words, first = [w for p, w in enumerate(words) if p not in hit], False
    return out


def test_shards_do_not_change_what_is_cut(spark):
    a, b = [" ".join(f"{c}{k}" for k in range(10)) for c in "ab"]
    other = " ".join(f"o{k}" for k in range(30))
    half, rest = a.split(" ")[:5], a.split(" ")[5:]
    texts = {
        1: f"{a} {b} {other[:59]}",  # each item alone stays below the share, both together are above it
        2: f"{other} {' '.join(half)} {b} {' '.join(rest)} {other}",  # cutting b joins the words of a
        3: f"{other} {a} {other}",
        4: other,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for items in ([(1, a), (2, b)], [(2, b), (1, a)]):
        want = whole_and_cut(texts, items)
        assert 1 not in want and "a0" not in want[2] and want[4] == other
        for shard_words in (200_000, 5):
            table = item_table(spark, items).coalesce(1)
            got = {r.doc_id: " ".join(r.text.split()) for r in decontaminate(docs, table, shard_words=shard_words).collect()}
            assert got == want


def test_groups_of_documents_share_a_load(spark, monkeypatch):
    import billspark.llm.decontaminate as module

    rows, docs = awkward_documents(spark, TEXTS)
    want = sorted(map(str, decontaminate(docs, item_table(spark)).collect()))
    assert len(want) < len(rows)
    for size in (1, 1 << 20):
        monkeypatch.setattr(module, "GROUP_BYTES", size)
        assert sorted(map(str, decontaminate(docs, item_table(spark), shard_words=5).collect())) == want
