import random
import re
import time

from billspark.llm.common import sha
from billspark.llm.pii import find_pii, find_spans, passes_luhn
from tests.llm.cases import awkward_documents, no_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    valid = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and passes_luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if valid[k](m.group())] for k, p in PATTERNS.items()}


def fuzz():
    rng = random.Random(5)
    for letters in ("ab1 2.-@+().5\n:/é", "4 1-.", "+12( )-.", "a.@-"):
        for _ in range(2500):
            yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))


def test_base_spans_equal_the_patterns():
    for text in [*fuzz(), "4111 1111 1111 1111", "+1 (427) 555-5262 ", "x.y@a.b.c. 1.2.3.4.5.6.7.8 256.1.1.1"]:
        found = find_spans(text)
        assert {k: found[k] for k in PATTERNS} == brute(text), text


def test_more_kinds():
    text = 'See https://a.example/x?y=1. IBAN: DE89370400440532013000, token = "87e15d78b9d8ef29b6c10061e3551a60"; 12 High Street'
    found = {k: [text[s:e] for s, e in v] for k, v in find_spans(text).items()}
    assert found["url"] == ["https://a.example/x?y=1"]
    assert found["account"] == ["DE89370400440532013000"]
    assert found["secret"] == ["87e15d78b9d8ef29b6c10061e3551a60"]
    assert found["address"] == ["12 High Street"]


def test_long_runs_are_linear():
    for part in ("1", "1.", "1 ", "a", "+1", "a@", "://", "token"):
        found = find_spans(part * 150)
        assert {k: found[k] for k in PATTERNS} == brute(part * 150), part
        start = time.perf_counter()
        find_spans(part * 100_000)
        assert time.perf_counter() - start < 10, part


def test_documents(spark):
    rows, docs = awkward_documents(spark, ["mail to jo.1@mail.example.com", "10.0.0.1 and 10.0.0.2"])
    got = find_pii(docs, redact=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {r.doc_id: r for r in got}
    assert by[100].n_email == 1 and by[100].spans == "email:8:29" and by[100].redacted == "mail to [email]"
    assert by[101].n_ip == 2 and by[101].base_sha256 == sha(b"ip:0:8,ip:13:21")
    assert by[2].base_sha256 == by[3].base_sha256 == sha(b"") and by[2].spans == ""
    assert find_pii(no_documents(spark)).count() == 0
