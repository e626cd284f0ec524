"""Personal data in texts, found from anchors.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` and the words
that announce an identifier (account, token, street ...). From each anchor a small parser walks left
and right, decides the boundaries and validates what it found. No parser goes back over what it has
already consumed, so the work is linear in the length of the text.

Base kinds, leftmost and non-overlapping within a kind: ``email``, ``ip``, ``card``, ``phone``.
Further kinds: ``url``, ``account``, ``secret``, ``address``. Positions are code points, end exclusive.

Defined cases: a missing text counts as empty; an empty text gives no spans; repeated rows are
answered once each; other columns of the input are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from billspark.llm.common import map_batches, sha, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("url", "account", "secret", "address")

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey")
STREET_CUES = ("street", "road", "avenue", "lane", "boulevard", "straße", "strasse", "rue", "calle")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"[0-9][ ().0-9-]*")
_REST_OF_URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
_AFTER_CUE = re.compile(r"(?i)(?:[ _-]?(?:no|nr|number|num|key))?[ .:#=\"']{1,6}")
_IDENTIFIER = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9A-Z]){5,33}(?![0-9A-Za-z])")
_SECRET = re.compile(r"[A-Za-z0-9_+/.=-]{16,}")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?(?: [A-ZÀ-Þ][\w'-]*){1,4}$")
_NAME_AND_HOUSE = re.compile(r"(?: (?:de|la|du|des|del|las|los|[A-ZÀ-Þ][\w'-]*)){0,6},? [0-9]{1,5}(?![0-9])")
_NAME = re.compile(r"(?: (?:de|la|du|des|del|las|los|[A-ZÀ-Þ][\w'-]*)){1,6}")
_WINDOW = 80  # characters a house number may stand before or after its street word


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for sign, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        automaton.add_word(sign, (kind, len(sign)))
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _back(text: str, at: int, low: int, allowed: frozenset[str]) -> int:
    while at > low and text[at - 1] in allowed:
        at -= 1
    return at


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS + MORE_KINDS}
    email_end = address_end = card_end = dotted_end = url_end = 0
    for last, (kind, length) in _anchors().iter(text):
        start, end = last - length + 1, last + 1
        if kind == "digit":
            if start >= card_end:
                card_end = end
                if run := _NUMBER.match(text, start):
                    card_end = run.end()
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and passes_luhn(digits):
                        found["card"].append(run.span())
            if start >= dotted_end:
                if run := _DOTTED.match(text, start):
                    dotted_end = run.end()
                    if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in run.group().split(".")):
                        found["ip"].append(run.span())
                else:
                    dotted_end = _DIGITS.match(text, start).end()
        elif kind == "at":
            left = _back(text, start, email_end, _LOCAL)
            if left < start and (domain := _DOMAIN.match(text, end)):
                email_end = domain.end()
                found["email"].append((left, email_end))
        elif kind == "plus":
            if run := _DIALLED.match(text, end):
                number = run.group()
                number = number[: max(number.rfind(d) for d in "0123456789") + 1]
                if len(number) >= 3 and 9 <= sum(map(number.count, "0123456789")) <= 15:
                    found["phone"].append((start, end + len(number)))
        elif kind == "scheme":
            left = _back(text, start, max(url_end, start - 16), _SCHEME)
            if left < start and text[left].isalpha() and (rest := _REST_OF_URL.match(text, end)):
                url_end = end + len(rest.group().rstrip(".,;:!?)"))
                if "." in text[end:url_end].split("/")[0]:
                    found["url"].append((left, url_end))
        elif kind == "account":
            if not text[max(0, start - 1) : start].isalpha() and (lead := _AFTER_CUE.match(text, end)):
                run = _IDENTIFIER.match(text, lead.end())
                if run and sum(c.isdigit() for c in run.group()) >= 6:
                    found["account"].append(run.span())
        elif kind == "secret":
            if not text[max(0, start - 1) : start].isalpha() and (lead := _AFTER_CUE.match(text, end)):
                run = _SECRET.match(text, lead.end())
                if run and any(c.isdigit() for c in run.group()):
                    found["secret"].append(run.span())
        elif start >= address_end:
            span = _address(text, start, end, address_end)
            if span:
                address_end = span[1]
                found["address"].append(span)
    return found


def _address(text: str, start: int, end: int, low: int) -> tuple[int, int] | None:
    """``12 High Street``, ``12 rue de Lyon``, ``Calle Mayor, 5`` or ``Lange Straße 5``."""
    if text[end : end + 1].isalpha():
        return None
    window = max(low, start - _WINDOW)
    before = text[window:start]
    cue = text[start:end].lower()
    if cue in ("rue", "calle"):
        if before[-1:].isalpha():
            return None
        if number := re.search(r"[0-9]{1,5},? $", before):
            if name := _NAME.match(text, end, end + _WINDOW):
                return window + number.start(), name.end()
        after = _NAME_AND_HOUSE.match(text, end, end + _WINDOW)
        return (start, after.end()) if after else None
    if cue in ("straße", "strasse"):
        house = re.compile(r" [0-9]{1,5}[a-z]?\b").match(text, end)
        name = re.search(r"(?:[A-ZÄÖÜ][\wäöüß-]* ?)$", before)
        return (window + name.start(), house.end()) if house and name else None
    if not before.endswith(" "):
        return None
    house = _HOUSE.search(before[:-1])
    return (window + house.start(), end) if house else None


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in found[kind])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, spans in found.items() for s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """A row per document: counts of the base kinds, digest of the base spans, all spans.

    With ``redact`` the redacted text follows.
    """

    def scan(batch: pa.RecordBatch) -> list:
        rows = []
        for text in texts_of(batch.column(1)):
            found = find_spans(text)
            rows.append(
                [
                    *(len(found[kind]) for kind in BASE_KINDS),
                    sha(joined(found, BASE_KINDS).encode()),
                    joined(found, BASE_KINDS + MORE_KINDS),
                    *([redacted(text, found)] if redact else []),
                ]
            )
        return [batch.column(0), *map(list, zip(*rows))]

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
        + ", redacted string" * redact
    )
    return map_batches(docs, ["doc_id", "text"], scan, schema)
