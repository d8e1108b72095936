"""Conversation repair against best-first search over edits, and spelling variants against all pairs."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import pytest

from marlspike.llm import conversations as C
from marlspike.llm import spelling as S

from .conftest import documents

SCHEMA = "conv_id long, turn long, role string, text string, signature string, cost long, copies long"
LEADS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """rows of (initial, must go, truncated): the first whole way in order of (cost, edits)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        for to in "ua":
            if (last, to) in LEADS:
                heapq.heappush(heap, (cost + 3, audit + "I", i, to))
        if i < len(rows):
            initial, goes, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if not goes:
                for to in "ua":
                    if (last, to) in LEADS:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, to))
                if (last, initial) in LEADS:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, initial))
    raise AssertionError


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in after:
            body = text.strip("\t\n\v\f\r ")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        n, first = Counter(faults), [r[1][:1] for r in after]
        turns = {r[0] for r in after} - {None}
        cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(first, faults, strict=True)])
        made, at, last = [], 0, ""
        for x in audit:
            if x == "D":
                at += 1
                continue
            role, text = ("", "") if x == "I" else after[at][1:]
            at += x != "I"
            if x != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            made.append(f"{role}:{text}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest)
    return out


def as_rows(df):
    return {r["conv_id"]: tuple(r[c] for c in (*C.COUNTS, "audit", "repaired_sha256")) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 7) for r in rows], SCHEMA)


def test_repair_equals_best_first_search(spark):
    rng = random.Random(31)
    said = ["Yes.", "No!", "cut off", "", " \n", None, "Why?\n", "dots... and", "é.", "😀", "end.\x1c", "a\nb."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ant"])
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2]), role, rng.choice(said)))
    rows += [(500, k, ("user", "assistant")[k % 2], f"Row {k}.") for k in range(400)] + [(501, 5, "user", "Same.")] * 9 + rows[:10]
    rng.shuffle(rows)
    assert as_rows(C.repair(table(spark, rows))) == brute(rows)


def test_nothing_left_and_odd_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = as_rows(C.repair(table(spark, [(gone, 0, "user", "Hi.")])))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repair(table(spark, [])).collect() == [] and C.repaired_rows(table(spark, [])).collect() == []
    long = "word " * 200_000 + "end."
    rows = [(1, 9, "system", "Be kind."), (1, 10, "user", long), (1, None, None, None), (2, -(2**62), "user", "A."), (2, 2**62, "assistant", "B."), (None, None, "assistant", "C")]
    assert as_rows(C.repair(table(spark, rows))) == brute(rows)


def test_trie_layers_are_computed_once_for_a_shared_prefix(spark, monkeypatch):
    signatures = ["", "u", "ua", "uau", "uaua", "uaU", "ua-", "suaX", "sua"]
    df = spark.createDataFrame([(s,) for s in signatures], "signature string")
    got = {r["signature"]: (r["cost"], r["audit"]) for r in C.repairs(df).collect()}
    assert got == {s: cheapest([(x.lower(), x == "-", x.isupper()) for x in s]) for s in signatures}
    steps = []
    monkeypatch.setattr(C, "step", lambda layer, symbol, f=C.step: steps.append(symbol) or f(layer, symbol))
    monkeypatch.setattr(C, "map_batches", lambda df, f, schema: f)
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *a: self)
    import pyarrow as pa

    [*C.repairs(df)(iter([{"signature": pa.array(sorted(signatures))}]))]
    assert len(steps) == len({s[: i + 1] for s in signatures for i in range(len(s))})


def test_repaired_rows_are_whole(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (2, 0, "tool", "x.")]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in C.repaired_rows(table(spark, rows)).collect())
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", "")]


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0x100)))


def spelled(rows):
    """word: (form, root, n, n_near, form_n) by comparing all pairs."""
    n = Counter()
    for doc, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c in LETTERS:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    beside = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in beside.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None)
    return out


@pytest.fixture(scope="module")
def misspelled():
    """Words of one and two halves, anagrams, repeated letters, chains of forms and words that many others are near to."""
    rng = random.Random(33)
    bases = ["abcdefg", "aaaaaaaa", "streßÀéö×÷", "Heatinghouse", "gfedcba", "thinker", "kinther", "Zürichsee", "interior", "x" * 40]
    words = []
    for base in bases:
        words += [base] * 230
        for _ in range(25):
            w = [*base]
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(LETTERS)], [w[at], rng.choice("aeé")], [w[at]] * 2])
            words += ["".join(w)] * rng.choice([1, 2, 3, 22, 25])
    words += ["".join(rng.sample("abcdefg", 7)) for _ in range(400)]
    rng.shuffle(words)
    rows = [(None if i % 40 == 3 else i // 12, rng.choice([" ", ", ", "1", "\n"]).join(words[i : i + 12])) for i in range(0, len(words), 12)]
    return [*rows, (1, None), (2, ""), (3, "short words only 123"), rows[0], rows[0]]


def test_variants_equal_all_pairs(spark, misspelled):
    got = S.spelling_variants(documents(spark, [(i, x, "en", "s") for i, x in misspelled])).collect()
    want = spelled(misspelled)
    assert {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in got} == want and len(got) == len(want)
    assert any(r["form"] and r["root"] != r["form"] for r in got) and max(r["n_near"] for r in got) > 10


def test_variants_of_odd_texts(spark, odd, none):
    assert S.spelling_variants(none).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in S.spelling_variants(odd).collect()}
    assert got == spelled(rows)


def test_anagrams_are_paired_only_where_half_of_the_letters_stand(spark):
    rng = random.Random(34)
    words = {"".join(rng.sample("abcdefghijkl", 12)) for _ in range(600)} | {"abcdefghijkl", "abcdefghijkm", "abcdefghijk", "bcdefghijkl"}
    df = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    exchange = S.keyed(df, (S.X0, S.X1))
    assert exchange.groupBy("key").count().agg({"count": "max"}).first()[0] < 30
    pairs = {frozenset((r["a"], r["b"])) for r in S.near_pairs(df).collect()}
    assert pairs == {frozenset(x) for x in [("abcdefghijkl", "abcdefghijkm"), ("abcdefghijk", "abcdefghijkl"), ("abcdefghijk", "abcdefghijkm"), ("bcdefghijkl", "abcdefghijkl")]}
