"""Secret scans by multipart credential linking."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from marlspike.llm.common import map_batches, prepare, text_rows
from marlspike.llm.spans import digest, joined


def either(word: str) -> str:
    """A pattern for an ASCII word in either case; re.I would add letters outside ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns of the base kinds, in the order that breaks ties. A possessive run leaves the matches as they are.
KEYS = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)")
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
LONG_HEX = re.compile(r"[0-9a-f]{24,}+")
KINDS = ("assign", "access", "hex")

#: Weak parts: none is a secret by itself. Identifiers of accounts or keys, opaque values, and the places where both are used.
IDENTIFIER = re.compile(
    rf"(?<![A-Za-z0-9])(?:{'|'.join(map(either, ('user', 'username', 'login', 'account', 'client_?id', 'access_?key_?id', 'key_?id', 'app_?id')))})"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{4,}+)"
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3|ssh)://[^\s\"'<>]{3,}+")
#: Inside an endpoint: the user before a password, and runs that may be keys; words of a path are told from them as long runs of letters and digits.
USER = re.compile(r"://([^\s/:@?#]+):[^\s/@]+@")
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+")


class Part(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Part]:
    """Leftmost non-overlapping matches of each base kind, by start, then kind."""
    found = [Part("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [Part("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run is possessive and maximal, so that only runs of 24 or more count and shorter ones hide none.
    found += [Part("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda p: (p.start, KINDS.index(p.kind)))


def entropy(value: str) -> float:
    """Bits for each character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def opaque(value: str, least: float) -> bool:
    """A run that mixes digits, upper and lower case letters, as drawn keys do and words don't."""
    return (
        any(c.isdigit() for c in value)
        and any("a" <= c <= "z" for c in value)
        and any("A" <= c <= "Z" for c in value)
        and entropy(value) >= least
    )


def weak_parts(text: str, base: list[Part], least_entropy: float) -> tuple[list[Part], list[Part], list[Part]]:
    """Identifiers (strong access keys and users of endpoints among them), opaque values and endpoints."""
    taken = [p.start for p in base]
    furthest = [*accumulate((p.end for p in base), max)]

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, b)
        return i == 0 or furthest[i - 1] <= a

    ids = [p for p in base if p.kind == "access"]
    if ":" in text or "=" in text:
        ids += [Part("id", *m.span(1)) for m in IDENTIFIER.finditer(text) if free(*m.span(1))]
    values = [Part("value", *m.span()) for m in OPAQUE.finditer(text) if opaque(m[0], least_entropy) and free(*m.span())]
    places = [Part("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    ids += [Part("id", *m.span(1)) for p in places for m in USER.finditer(text, p.start, p.end) if free(*m.span(1))]
    return sorted(ids, key=lambda p: p.start), values, places


class Ends(NamedTuple):
    """Where parts start and where they end, each in order."""

    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, parts: list[Part]) -> Ends:
        return cls(sorted(p.start for p in parts), sorted(p.end for p in parts))


def near(part: Part, others: Ends, scope: int) -> bool:
    """Whether one of others, of any length, ends within scope code points before part or starts within scope behind it."""
    i, j = bisect_left(others.ends, part.start - scope), bisect_left(others.starts, part.end)
    return (i < len(others.ends) and others.ends[i] <= part.start) or (j < len(others.starts) and others.starts[j] <= part.end + scope)


def linked_spans(text: str, base: list[Part], scope: int = 200, least_entropy: float = 3.5) -> list[Part]:
    """Weak parts that complement one another within a scope.

    A value is reported with an identifier in scope, or with an endpoint in scope or around it: of an endpoint's own text, long runs of letters and
    digits are values. An identifier is reported with a reported or base secret in scope. Parts that overlap otherwise are one thing and don't
    complement one another. An endpoint is evidence only. A value alone, an identifier alone and an endpoint alone stay unreported.
    """
    ids, values, places = weak_parts(text, base, least_entropy)
    if not places and (not ids or not (values or base)):
        return []
    by_id, by_place = Ends.of(ids), Ends.of(places)
    out = [Part("linked_secret", v.start, v.end) for v in values if near(v, by_id, scope) or near(v, by_place, scope)]
    out += inside(text, base, places, least_entropy)
    secrets = Ends.of([*out, *(p for p in base if p.kind != "access")])
    out += [Part("linked_id", p.start, p.end) for p in ids if p.kind == "id" and near(p, secrets, scope)]
    return sorted({*out})


def inside(text: str, base: list[Part], places: list[Part], least_entropy: float) -> list[Part]:
    """The opaque runs of endpoints that no base span has a part of."""
    runs = [m.span() for p in places for m in RUN.finditer(text, p.start, p.end) if opaque(m[0], least_entropy)]
    return [Part("linked_secret", a, b) for a, b in runs if not any(p.start < b and p.end > a for p in base)] if runs else []


def all_spans(text: str, scope: int = 200, least_entropy: float = 3.5) -> tuple[list[Part], list[Part]]:
    """Base spans, and base with linked spans, by start, then kind (base kinds first, as listed)."""
    base = base_spans(text)
    order = (*KINDS, "linked_id", "linked_secret")
    return base, sorted([*base, *linked_spans(text, base, scope, least_entropy)], key=lambda p: (p.start, order.index(p.kind)))


def scan_secrets(docs: DataFrame, scope: int = 200, least_entropy: float = 3.5) -> DataFrame:
    """Per document doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    scope: code points between two parts that still belong together. Scopes lie within a text, so the interval join runs as a
    sweep over each text's own sorted parts; nothing is shuffled and no key can be hot. Null and empty texts have no spans;
    repeated rows are scanned each; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [all_spans(x or "", scope, least_entropy) for x in b["text"].to_pylist()]
            yield {
                "doc_id": b["doc_id"],
                **{f"n_{k}": [sum(p.kind == k for p in base) for base, _ in rows] for k in KINDS},
                "base_sha256": [digest(base) for base, _ in rows],
                "spans": [joined(every) for _, every in rows],
                "n_linked": [len(every) - len(base) for base, every in rows],
            }

    return map_batches(text_rows(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(text: str | None, mark: str = "[SECRET]", scope: int = 200, least_entropy: float = 3.5) -> str | None:
    """The text with every span, overlapping ones merged, replaced by mark; null stays null."""
    if not text:
        return text
    out, done = [], 0
    for p in all_spans(text, scope, least_entropy)[1]:
        if p.end <= done:
            continue
        if p.start >= done:
            out += [text[done : p.start], mark]
        done = p.end
    return "".join([*out, text[done:]])


def redact_secrets(docs: DataFrame, scope: int = 200, least_entropy: float = 3.5) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with secrets blotted out and n_chars counted anew; every row stays."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [redact(x, scope=scope, least_entropy=least_entropy) for x in b["text"].to_pylist()]
            yield b | {"text": texts, "n_chars": [None if x is None else len(x) for x in texts]}

    return map_batches(text_rows(docs, "lang", "source", "n_chars"), run, "doc_id long, text string, lang string, source string, n_chars long")
