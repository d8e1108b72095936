"""Cases in which the operators once did less than the whole job."""

import random
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from marlspike.llm import jaccard_join as J
from marlspike.llm import mixing
from marlspike.llm.common import materialize
from marlspike.llm.pii import find_pii
from marlspike.llm.quality import quality_rules
from marlspike.llm.secrets import all_spans, redact

from .conftest import documents, texts


def word_sets(text, size):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def brute_links(rows, size, percent):
    """Index pairs of rows (key, text) whose sets link."""
    sets = [word_sets(x, size) for _, x in rows]
    return {(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}


def edited(rng, base, n):
    step = len(base) // n if n else 0
    return [*(f"e{rng.randrange(10**6)}" if n and i % step == step // 2 else w for i, w in enumerate(base))]


def test_the_near_copy_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(21)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [base, edited(rng, base, 8), edited(rng, base, rng.choice([4, 7, 9, 10, 20]))]
    docs = documents(spark, [(i, " ".join(x), "en", "s") for i, x in enumerate(rows)]).select("doc_id", "text", "lang", "source", "n_chars")
    least = {i: i for i in range(len(rows))}
    for _ in rows:
        for i, j in brute_links(sorted(texts(docs)), 5, 80):
            least[i] = least[j] = min(least[i], least[j])
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    kept = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert kept == {i for i, c in least.items() if i == c} and not kept & {3 * k + 1 for k in range(6)}


def test_long_parts_are_linked_whole():
    rng = random.Random(22)
    drawn = lambda n: "aB3" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n - 3))
    kinds = lambda text: [p.kind for p in all_spans(text)[1]]
    jwt = f"token=eyJ{drawn(1500)}"
    assert kinds(f"{jwt} client_id=alice99") == ["assign", "linked_id"] and kinds(f"{jwt} {'word ' * 60}client_id=alice99") == ["assign"]
    assert kinds(f"client_id=alice99 session {drawn(150)}") == ["linked_id", "linked_secret"] and kinds(f"{drawn(3000)} at https://db.example.org/{'x' * 900}") == ["linked_secret"]
    name = f"123456789012-{'k' * 32}.apps.googleusercontent.com"
    assert redact(f"client_id={name} token=abcdefgh end") == "client_id=[SECRET] [SECRET] end"
    assert kinds(f"https://db.example.org/{'x/' * 300}y {drawn(40)}") == ["linked_secret"]
    inside = "token=" + "_".join(["0a" * 12] * 12) + "_user=alice99 "
    assert kinds(inside)[0] == "assign" and "linked_id" not in kinds(inside)


@pytest.mark.parametrize("block", [4, 256])
def test_the_join_returns_every_link(spark, monkeypatch, block):
    """Groups of near copies that link among themselves, with passages that many texts share, exact copies and unnamed documents."""
    monkeypatch.setattr(J, "BLOCK_MEMBERS", block)
    rng = random.Random(23)
    passage, rows = [f"p{i}" for i in range(60)], [None, "", "one two"]
    for k in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 90, 150]))] + passage * (k % 2)
        for _ in range(rng.choice([3, 12, 25])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2]))))
            base = edited(rng, base, 1) if rng.random() < 0.2 else base
    docs = documents(spark, [(None if i % 17 == 5 else i, x, "en", "s") for i, x in enumerate(rows)])
    named, at = [*enumerate(rows)], {}
    for i, x in named:
        at.setdefault(word_sets(x, 3), []).append(i)
    linked = brute_links(named, 3, 90)
    least = lambda i: min((k for k in at[word_sets(rows[i], 3)] if k % 17 != 5), default=None)
    want = {frozenset((at[word_sets(rows[i], 3)][0], at[word_sets(rows[j], 3)][0])) for i, j in linked}
    got = J.jaccard_links(docs).collect()
    distinct = [x for x in want if len(x) == 2]
    assert len({(r["a_set"], r["b_set"]) for r in got}) == len(got) == len(distinct) > 100 and all(r["a_set"] < r["b_set"] for r in got)
    assert sum(r["a_docs"] * r["b_docs"] for r in got) == sum(word_sets(rows[i], 3) != word_sets(rows[j], 3) for i, j in linked)
    ends = lambda pairs: sorted(map(sorted, ((x or -1, y or -1) for x, y in pairs)))
    assert ends((r["a_doc"], r["b_doc"]) for r in got) == ends(map(least, x) for x in distinct)
    n = [sum(i in x for x in linked) for i, _ in named]
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in J.link_counts(docs).collect()) == sorted((str(None if i % 17 == 5 else i), n[i]) for i, _ in named)


def test_postings_of_the_join_grow_as_its_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(100)), "en", "s") for i in range(40)]
    index = J.indexed(documents(spark, rows), 3, 90)
    assert {(r["n"], len(r["prefix"])) for r in index.collect()} == {(98, 98 - 89 + 1)}  # not as many as their counts' cells are shared
    copy = materialize(index.union(index.where("doc_id < 2").selectExpr("doc_id", "n", "sig + 1", "bins", "prefix")), "test-index")
    found = J.shared_postings(copy)
    assert {(r["pos"], r["df"]) for r in found.collect()} == {(k, 2) for k in range(10)} and found.count() == 40
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_the_mix_takes_rows_not_keys(spark):
    """Rows without doc_id, rows that share one, and equal rows, all of one size: each gets what its own row of the plan says."""
    rng = random.Random(24)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(20))
    rows = [(None, text(), "en", rng.choice("aaaaaab")) for _ in range(200)] + [(i // 4, text(), "de", rng.choice("ac")) for i in range(100)]
    docs = documents(spark, rows + rows[:20] + rows[:20] + rows[-10:])
    want, got = Counter(), Counter()
    for r in mixing.planned(materialize(mixing.drawn(docs, "mix", "text"), "drawn")).collect():
        want[r["doc_id"], r["source_key"][1:]] += r["taken"]
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == +want
    plan = {(r["source_size"], r["target"]) for r in mixing.mix(docs).collect()}
    assert all(abs(sum(n for (_, s), n in got.items() if s == k) - t) < 1 for k, t in zip("abc", (next(t for z, t in plan if z == size) for size in (20 * docs.where(f"source = '{k}'").count() for k in "abc")), strict=True))


def test_hosts_of_any_size_lose_frequent_lines(spark):
    """small: all 8 documents have a notice, 2 share another line; mid: 9 of 700; big: 60 of 7000, under 1 %."""
    own = lambda k: "".join("abcdefghij"[int(c)] for c in str(k)) + " stands alone here"
    rows = [("small", f"all rights are kept\n{own(i)}" + "\ntwo have this" * (i < 2)) for i in range(8)]
    rows += [("mid", own(i) + "\nnine of many have it" * (i < 9)) for i in range(700)] + [("big", own(i) + "\nsixty of many" * (i < 60) + "\nthirty of many" * (60 <= i < 90)) for i in range(7000)]
    docs = documents(spark, [(i, x, "en", h) for i, (h, x) in enumerate(rows)])
    got = {r["doc_id"]: r["n_removed_words"] for r in quality_rules(docs).collect()}
    assert got == {i: 4 if h == "small" else 5 if "nine" in x else 3 if "sixty" in x else 0 for i, (h, x) in enumerate(rows)}


def test_identifiers_need_no_digit(spark):
    """Emails without a digit are seeds; an obfuscated address and a handle in their context are found, at their code points."""
    rng = random.Random(25)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [f"𝒳 {name()} please write to {name()}@example.org today {name()}" for _ in range(20)]
    rows += ["do please  write to (jane[at]example[dot]org), today", "please write to @janedoe today", "they write poems like jane[at]example[dot]org today", "+49 30 5551234 then please write to jane.doe-home today"]
    got = {r["doc_id"]: r for r in find_pii(documents(spark, [(i, x, "en", "s") for i, x in enumerate(rows)])).collect()}
    at = lambda i, x: f"context_email:{rows[i].index(x)}:{rows[i].index(x) + len(x)}"
    assert all(got[i]["n_email"] == 1 and got[i]["n_context"] == 0 for i in range(20))
    assert got[20]["spans"] == at(20, "jane[at]example[dot]org") and got[21]["spans"] == at(21, "janedoe")
    assert got[22]["spans"] == "" and got[23]["spans"] == f"phone:0:14,{at(23, 'jane.doe-home')}"


def brute_contexts(rows, rounds=2, least_support=5, least_score=0.7, context=64):
    """Context spans of texts by plain loops: the mentions and tokens of each text with their two contexts, then rounds of scores over all of them."""
    import math
    import re
    from collections import defaultdict

    from .test_text_operators import BASE, brute_pii

    mention = re.compile(rf"{BASE['phone']}|(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){{12,18}}(?![0-9A-Za-z])(?!\x20?[0-9])|(?<!\S)(?=\S*[0-9@])\S+")

    def trim(a, b, text):
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while a < b and not (text[b - 1].isalnum() or text[b - 1] == "+"):
            b -= 1
        return a, b

    held = defaultdict(lambda: [None, set()])  # (pattern, instance): kind of a seed; places
    spots = []  # text, start, end, instance, patterns, is a mention
    for k, text in enumerate(rows):
        base = brute_pii(text)
        at = [m.span() for m in mention.finditer(text)]
        cuts = [(0, 0), *at, (len(text), len(text))]
        for n, (a, b) in enumerate(at, 1):
            left, right = text[cuts[n - 1][1] : a][-context:].lower().split(), text[b : cuts[n + 1][0]][:context].lower().split()
            a, b = trim(a, b, text)
            if b - a >= 4:
                over = [x[0] for x in base if x[1] < b and x[2] > a]
                back = ["^", "^", *left][-2:]
                by = (("<", *back), ("|", back[1], right[0] if right else ""))
                spots.append((k, a, b, text[a:b].lower(), by, True, over[0] if over else None))
        for n in range(1, len(cuts)):
            words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[cuts[n - 1][1] : cuts[n][0]])]
            word = lambda i, words=words, o=cuts[n - 1][1]: text[o + words[i][0] : o + words[i][1]].lower() if 0 <= i < len(words) else None
            for i, (s, e) in enumerate(words):
                a, b = trim(s + cuts[n - 1][1], e + cuts[n - 1][1], text)
                if b - a >= 4:
                    by = (("<", word(i - 2) or "^", word(i - 1) or "^"), ("|", word(i - 1) or "^", word(i + 1) or ""))
                    spots.append((k, a, b, text[a:b].lower(), by, False, None))
    for _, _, _, x, by, own, kind in spots:
        for p in by if own else ():
            held[p, x][0] = max(filter(None, (held[p, x][0], kind)), default=None)

    def scored(edges):
        seed = {(x, kind) for (_, x), kind in edges.items() if kind}
        known, found, trusted = {s: 1.0 for s in seed}, {}, {}
        for _ in range(rounds):
            size, mass, support = Counter(p for p, _ in edges), defaultdict(float), Counter()
            for p, x in edges:
                for kind in BASE:
                    if (x, kind) in known:
                        mass[p, kind] += known[x, kind]
                        support[p, kind] += known[x, kind] == 1.0
            trusted = {(p, kind): mass[p, kind] / size[p] * (1 - 1 / (1 + n)) for (p, kind), n in support.items() if n >= least_support}
            trusted = {key: t for key, t in trusted.items() if t >= least_score}
            doubt = defaultdict(float)
            for (p, x), kind in edges.items():
                for k in BASE:
                    if kind is None and (p, k) in trusted:
                        doubt[x, k] += math.log(1 - min(trusted[p, k], 0.999))
            score = {key: 1 - math.exp(d) for key, d in doubt.items() if 1 - math.exp(d) >= least_score}
            found = {}
            for (x, k), s in score.items():
                found[x] = max(found.get(x, (0, "")), (s, k))
            known = {s: 1.0 for s in seed} | {(x, k): s for x, (s, k) in found.items()}
        return found, trusted

    first = {p for p, _ in scored({key: e[0] for key, e in held.items()})[1]}
    for _, _, _, x, by, own, _ in spots:
        for p in by:
            if not own and p in first:
                held[p, x]
    found, trusted = scored({key: e[0] for key, e in held.items()})
    out = defaultdict(set)
    for k, a, b, x, by, own, kind in spots:
        if x in found and kind is None and (own or any((p, found[x][1]) in trusted for p in by)):
            out[k].add((f"context_{found[x][1]}", a, b))
    return {k: sorted(v, key=lambda s: ([*BASE].index(s[0][8:]), s[1])) for k, v in out.items()}


@pytest.mark.parametrize("seed", [41, 42, 43])
def test_context_spans_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    lead = ["please write to", "mail me at", "call us under", "our server at", "paid with card", "the value of"]
    kinds = [lambda: f"{name()}@ex{rng.randrange(9)}.org", lambda: f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", lambda: f"+49 30 55{rng.randrange(10**5):05d}", lambda: "4111 1111 1111 1111"]
    other = [lambda: f"{name()}(at)ex.org", lambda: f"{rng.randrange(900)}-{rng.randrange(900)}", lambda: f"@{name()}", name, lambda: f"({name()}),"]
    rows = []
    for _ in range(400):
        words = [name() if rng.random() < 0.3 else rng.choice(["and", "today", "soon", "12", "a"]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(lead))
            value = kinds[(0, 0, 2, 1, 3, 1)[k]]() if rng.random() < 0.75 else rng.choice(other)()
            at = rng.randint(0, len(words))
            words[at:at] = [lead[k], value, rng.choice(["today", "please", "now."])]
        rows.append(" ".join(words))
    want = brute_contexts(rows)
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("context_")] for r in find_pii(documents(spark, [(i, x, "en", "s") for i, x in enumerate(rows)])).collect()}
    assert {i: v for i, v in got.items() if v} == {i: [f"{k}:{a}:{b}" for k, a, b in v] for i, v in want.items()} and len(want) > 5


def test_thousands_of_matches_in_one_text(spark):
    """10,000 addresses, 2,000 tokens found by their context: work grows with the text, not with its square."""
    import time

    text = " ".join(f"write to user{i}@mail{i % 97}.example.org today" for i in range(10_000)) + " " + " ".join(f"write to u{i}(at)example.org today" for i in range(2000))
    find_pii(documents(spark, [(0, "a b", "en", "s")])).collect()
    began = time.time()
    r = find_pii(documents(spark, [(1, text, "en", "s")])).first()
    assert r["n_email"] == 10_000 and r["n_context"] == 2000 and r["n_spans"] == 12_000 and time.time() - began < 60


@pytest.mark.parametrize("sent", [200_000, 0])
def test_frequent_lines_equal_brute_force(spark, odd, none, monkeypatch, sent):
    """Verdicts, removed words and the texts that stay, whether frequent lines are sent to the tasks or met by a salted join."""
    import re

    from marlspike.llm import quality

    monkeypatch.setattr(quality, "SENT_LINES", sent)
    rng = random.Random(31)
    lines = [" ".join(rng.choice("alpha beta 12 Gamma delta 7 eps".split()) + str(rng.randrange(4)) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    rows = []
    for i in range(260):
        own = "\n".join(" ".join(f"w{rng.randrange(10**6):x}z" for _ in range(rng.randint(3, 20))) for _ in range(rng.randint(2, 8)))
        often = [rng.choice(lines[: 4 + i % 9]) for _ in range(rng.choice([0, 1, 3, 30]))]
        body = [*own.split("\n"), *often, *[x.upper().replace(" ", " \t") + "\r" for x in often[:1]], " "]
        rng.shuffle(body)
        rows.append((1000 + i, "\n".join(body), "en", rng.choice(["a", "b", "c", None])))
    docs = odd.unionByName(documents(spark, rows))
    held = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip()
    split = lambda x: [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    size, found = Counter(h for *_, h in held), Counter((h, y) for _, x, h in held for y in {*map(normal, split(x))})
    gone = {k for k, n in found.items() if n > 20 or (n >= 3 and n > 0.1 * size[k[0]])}
    want, stay = Counter(), Counter()
    for i, x, h in held:
        words = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = len({k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)})
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", y)) for y in split(x) if (h, normal(y)) in gone)
        kept = len(words) >= 50 and 100 * again <= 50 * len(words) and lost <= 0.6 * len(words)
        want[i, lost, kept] += 1
        if kept:
            stay[i, "\n".join(y for y in x.split("\n") if not (split(y) and (h, normal(y)) in gone)), h] += 1
    limits = {"least_limit": 20, "limit_share": 0.1, "most_removed": 0.6}
    assert Counter((r["doc_id"], r["n_removed_words"], r["kept"]) for r in quality.quality_rules(docs, **limits).collect()) == want
    got = quality.without_frequent_lines(docs, **limits).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == stay and all(r["n_chars"] == len(r["text"]) for r in got)
    assert len({k for _, n, k in want if n}) == 2 and quality.without_frequent_lines(none).count() == 0


@pytest.mark.parametrize("scope", [0, 25, 200])
def test_links_equal_brute_force(scope):
    """Every pair of parts of a text: what is in scope of what, overlaps and nested spans among them."""
    import re

    from marlspike.llm import secrets as S

    rng = random.Random(scope)
    drawn = lambda n: "".join(rng.choice("abcdefgXYZ0123456789") for _ in range(n))
    parts = [lambda: f"user: {drawn(5)}", lambda: f"client_id={drawn(30)}", lambda: "aB3" + drawn(25), lambda: f"https://h.example/{drawn(6)}", lambda: "AKIA" + "A1" * 9, lambda: f"token={drawn(8)}", lambda: "token=" + "_".join(["0a" * 12] * 10) + "aB3" + drawn(20), lambda: "word " * rng.randint(1, 30)]
    parts += [lambda: f"postgres://admin:aB3{drawn(18)}@db.example.org/x", lambda: f"https://h.example.org/services/T0A1b2C3{drawn(12)}", lambda: f"https://api.example.org/v1?sig=aB3{drawn(17)}&x=1", lambda: f"https://h.example/{drawn(5)}/My-Page-{drawn(3)}-of-2024", lambda: f"https://h.example/?token={drawn(20)}"]
    seen = Counter()
    for _ in range(400):
        text = " ".join(rng.choice(parts)() for _ in range(rng.randint(1, 9)))
        base = S.base_spans(text)
        free = lambda a, b, base=base: not any(p.start < b and p.end > a for p in base)
        close = lambda p, q: (p[0] - scope <= q[1] <= p[0]) or (p[1] <= q[0] <= p[1] + scope)
        ids = [m.span(1) for m in S.IDENTIFIER.finditer(text) if free(*m.span(1))]
        keys = [(p.start, p.end) for p in base if p.kind == "access"]
        values = [m.span() for m in S.OPAQUE.finditer(text) if S.opaque(m[0], 3.5) and free(*m.span())]
        places = [m.span() for m in re.finditer(S.ENDPOINT, text)]
        runs = [(a, b) for p, q in places for a in range(p, q) for b in range(a + 16, q + 1) if text[a:b].isascii() and text[a:b].isalnum() and not text[a - 1].isalnum() and (b == q or not text[b].isalnum())]
        runs = [(a, b) for a, b in runs if S.opaque(text[a:b], 3.5) and free(a, b)]
        for p, q in places:
            head, found, _ = text[p:q].split("/")[2].partition("@")
            if found and ":" in head and free(p + text[p:q].index(head), p + text[p:q].index(head) + head.index(":")):
                ids.append((p + text[p:q].index(head), p + text[p:q].index(head) + head.index(":")))
        secrets = sorted({*(v for v in values if any(close(v, q) for q in [*ids, *keys, *places])), *runs})
        named = [p for p in ids if any(close(p, q) for q in [*secrets, *((b.start, b.end) for b in base if b.kind != "access")])]
        want = sorted([("linked_secret", *v) for v in secrets] + [("linked_id", *p) for p in named])
        assert sorted(S.linked_spans(text, base, scope)) == want
        seen.update(k for k, *_ in want)
    assert min(seen["linked_secret"], seen["linked_id"]) > 20 or scope == 0


def test_values_inside_endpoints_are_linked():
    kinds = lambda text: [p.kind for p in all_spans(text)[1]]
    assert redact("see postgres://admin:Abc123DefGhi456JklMno@db.example.org/x now") == "see postgres://[SECRET]:[SECRET]@db.example.org/x now"
    assert redact("https://hooks.example.org/services/T0A1b2C3d4E5f6G7h8J9k0") == "https://hooks.example.org/services/[SECRET]"
    assert redact("https://api.example.org/v1?sig=Abc123DefGhi456JklMno789 end") == "https://api.example.org/v1?sig=[SECRET] end"
    assert kinds("https://www.example.org/2024/My-Long-Page-About-Things-2024.html") == [] and kinds("mail jane:x@y.org or https://h.example/a/b") == []


def test_lines_are_counted_by_documents_not_rows(spark):
    """A document that stands three times is one; texts without doc_id are told apart by their text."""
    own = lambda i: "\n".join(f"line {chr(97 + i)} {chr(97 + k)} " + " ".join(f"w{chr(97 + i)}{chr(97 + k)}{chr(97 + j)}" for j in range(9)) for k in range(8))
    rows = [(1, own(1), "en", "h")] * 3 + [(None, own(2), "en", "h")] * 5 + [(k, own(k), "en", "h") for k in (3, 4)]
    got = quality_rules(documents(spark, rows)).collect()
    assert all(r["kept"] and r["n_removed_words"] == 0 for r in got) and len(got) == 10
    copies = [(k, own(5), "en", "h") for k in range(10, 13)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(documents(spark, rows + copies)).collect()}
    assert not any(got[k] for k in range(10, 13)) and got[1] and got[3]


def test_documents_without_id_draw_by_their_text(spark):
    rows = documents(spark, [(None, f"text number {i}", "en", "s") for i in range(400)] + [(i, f"text number {i}", "en", "s") for i in range(400)])
    drawn = mixing.drawn(rows, "mix")
    assert drawn.where("doc_id is null").select("key").distinct().count() == 400
    assert drawn.groupBy("source_key", "range").count().agg({"count": "max"}).first()[0] < 20
    got = mixing.mix(rows).collect()
    assert abs(sum(r["taken"] for r in got) - 1.5 * 3 * 800) <= 3


def test_stages_of_empty_and_unlabelled_tables(spark, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*columns), "").count() == 0, name
    docs = documents(spark, [(i, f"the {i} words of a text that nobody has labelled", None, None) for i in range(5)] * 2).select(*columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert {r["doc_id"] for r in docs.collect()} == {*range(5)}, name
