import hashlib
import random
import re
from collections import Counter

import pytest

from marlspike.llm import language_id as L
from marlspike.llm.pii import find_pii
from marlspike.llm.quality import quality_rules
from marlspike.llm.secrets import all_spans, redact, redact_secrets, scan_secrets

from .conftest import documents, prose, texts


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# --- language ID ----------------------------------------------------------------------------------------------------------

LANGS = {"en": "the and with house water stone which there".split(), "fr": "le la avec maison étoile rivière être jour".split(), "de": "der und mit haus straße fluß über nacht".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[k]) for _ in range(rng.randint(5, 60))), k, "s") for i in range(300) for k in [rng.choice([*LANGS])]]
    return documents(spark, rows)


def test_held_out_accuracy(labelled):
    got = {r["doc_id"]: r for r in L.identify(labelled).collect()}
    want = {r["doc_id"]: r["lang"] for r in labelled.collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert 40 < len(held) < 120 and sum(got[k]["lang_pred"] == want[k] for k in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_switches_of_language_are_followed(labelled):
    field = L.train(labelled)
    assert field.labels == ["de", "en", "fr"] and (field.trans.diagonal() >= field.trans.max(0) - 1e-9).all()
    read = L.Reader(field)
    found = read(["the and with house " * 5 + "le la avec", "le la avec maison " * 5 + "the"])
    assert [r.lang for r in found] == ["en", "fr"] and all(r.switches for r in found)


def test_words_are_labelled(spark, labelled, none):
    """The runs of a code-switched text, at its own code points; words of any length and with combining marks are whole."""
    field = L.train(labelled)
    first, second = "The AND with house water", "le la avec maison étoile"
    rows = [(1, f"𝒳1 {first}. {second}, {first}", "en", "s"), (2, None, "en", "s"), (3, "12 !", "en", "s"), (4, "İ " + second, "en", "s"), (1, second, "en", "s")]
    got = [tuple(r) for r in L.label_words(documents(spark, rows), field).collect()]
    text = rows[0][1]
    runs = [r for r in got if r[0] == 1 and r[3] > len(second)]
    assert [text[r[2] : r[3]] for r in runs][-2:] == [second, first] and {r[0] for r in got} == {1, 4} and sum(r[5] for r in got if r[0] == 4) == 6
    assert L.label_words(none, field).count() == 0 and L.label_words(documents(spark, rows), L.Field([], {}, {})).count() == 0
    assert L.words_in("हिन्दी भाषा a\u0301b 12 क") == ["हिन्दी", "भाषा", "a\u0301b", "क"]
    assert len(L.shape_features("x" * 100 + "yq" + "x" * 100)) == 3 + 3 + 203 + 202 and "3xyq" in L.shape_features("x" * 100 + "yq" + "x" * 100)


def test_unlabelled_corpora_stay_whole(spark, none):
    docs = documents(spark, [(i, x, None, "s") for i, x in enumerate(["the house", "日本", "12", None, "", "the house"])])
    assert sorted(r["doc_id"] for r in L.keep_identified(docs).collect()) == [0, 1, 5] and L.keep_identified(none).count() == 0


def test_forward_backward_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    table, trans = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    seqs = [np.array([0, 3, 2, 4]), np.array([1, 1]), np.array([2])]
    got, each = L.forward_backward(seqs, table, trans)
    for g, w, s in zip(got, each, seqs, strict=True):
        mass = np.zeros((len(s), 3))
        for path in itertools.product(range(3), repeat=len(s)):
            p = np.exp(sum(table[w, y] for w, y in zip(s, path, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                mass[t, y] += p
        assert np.allclose(g, (mass / mass.sum(1, keepdims=True)).mean(0)) and np.allclose(w, mass / mass.sum(1, keepdims=True))


def test_odd_languages(odd, none):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(odd).collect()]
    assert len(got) == odd.count() and all((p == "und") == (s == 0) for _, p, s in got)
    assert {i for i, p, _ in got if p == "und"} == {1, 2, 3, 10, 12, None} and ("en" in {p for i, p, _ in got if i is None})
    assert L.identify(none).count() == 0
    assert L.keep_identified(odd).count() == sum(p != "und" for _, p, _ in got)


# --- secrets --------------------------------------------------------------------------------------------------------------

KEYWORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


def brute_secrets(text):
    found = [("assign", *m.span()) for m in re.finditer(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


SECRETS = [
    "token = \"" + "0a" * 20 + "\" api_key:abcdef APIKEY=abcde", "AKIA" + "A1" * 9 + " Xab AKIAB", "pasSword: = x token == abcdef ſecret=abcdefg", "a" * 23 + " " + "b" * 24 + "g", "é" * 3 + "secret='x/y+z=_-.'",
]


def test_base_spans_equal_brute_force(spark, odd, none):
    docs = odd.unionByName(documents(spark, [(100 + i, x, "en", "s") for i, x in enumerate(SECRETS)]))
    have = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in scan_secrets(docs).collect())
    want = Counter()
    for i, x in texts(docs):
        b = brute_secrets(x or "")
        want[i, sum(k == "assign" for k, *_ in b), sum(k == "access" for k, *_ in b), sum(k == "hex" for k, *_ in b), digest(b)] += 1
    assert have == want and scan_secrets(none).count() == 0


VALUE = "Zq8/Lk3vT0pR7xW1mN5c"


def kinds(text):
    return [p.kind for p in all_spans(text)[1]]


def test_weak_parts_need_a_complement():
    assert kinds(f"value {VALUE} alone") == [] and kinds("user: alice.smith alone") == [] and kinds("https://db.example.org/x alone") == []
    assert kinds(f"user: alice.smith then {VALUE}") == ["linked_id", "linked_secret"]
    assert kinds(f"https://db.example.org/x with {VALUE}") == ["linked_secret"]
    assert kinds(f"user: alice.smith {'word ' * 60}{VALUE}") == [] and kinds("client_id=alice99 token=abcdefgh") == ["linked_id", "assign"]
    assert kinds(f"AKIA{'A1' * 9} and {VALUE}") == ["access", "linked_secret"]


def test_redaction(spark, odd):
    assert redact(f"a token=abcdefgh b {'0a' * 20}") == "a [SECRET] b [SECRET]" and redact(None) is None and redact("clean text") == "clean text"
    got = redact_secrets(odd).collect()
    assert len(got) == odd.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


# --- personal data --------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


PERSONAL = [
    "a@b.c_d@e.f g.h@i.jk.l@m.n", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (743) 555-3824+49 30 123456 +1", "é@a.b ünï@x.y +123456789",
    "a@" * 3000 + "b.c", "𝒳𝒳 he.19@mail5.example.com 𝒳 1.2.3.4", " ".join(f"{i}.1.1.1" for i in range(200)),
]


def test_base_pii_equals_brute_force(spark, odd, none):
    docs = odd.unionByName(documents(spark, [(100 + i, x, "en", "s") for i, x in enumerate(PERSONAL)]))
    have = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in find_pii(docs).collect())
    want = Counter()
    for i, x in texts(docs):
        b = brute_pii(x or "")
        want[i, *(sum(k == kind for k, *_ in b) for kind in BASE), digest(b)] += 1
    assert have == want and find_pii(none).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(3)
    seeds = [(i, f"{prose(rng, 5)} reach me under +49 30 55{i:05d} soon {prose(rng, 5)}", "en", "s") for i in range(12)]
    unseen = [(50, "just reach me under 0305-55-1234 soon", "en", "s"), (51, "the answer was 0305-55-9999 there", "en", "s")]
    got = {r["doc_id"]: r for r in find_pii(documents(spark, seeds + unseen)).collect()}
    assert got[50]["spans"] == "context_phone:20:32" and got[50]["n_phone"] == 0 and got[51]["spans"] == "" and all(got[i]["n_phone"] == 1 for i in range(12))
    copies = documents(spark, [(i, seeds[0][1], "en", "s") for i in range(20)] + unseen)
    assert all(r["n_context"] == 0 for r in find_pii(copies).collect())


# --- quality --------------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_equal_brute_force(spark, odd, none):
    more = ["a b c a b c d\na b c a b c d\n\n \n x|y <z> #", "p q r p q r p q r", "same\nsame\r\nsame"]
    docs = odd.unionByName(documents(spark, [(100 + i, x, "en", "s") for i, x in enumerate(more)]))
    have = Counter(tuple(r[:7]) for r in quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, x in texts(docs):
        m = brute_quality(x or "")
        want[i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]] += 1
    assert have == want and quality_rules(none).count() == 0


def test_frequent_lines_deplete_documents(spark):
    rng = random.Random(4)
    notice = "\n".join(prose(rng, 30).replace("\n", " ") for _ in range(3))
    rows = [(i, f"{notice}\n{' '.join(rng.choice(LANGS['fr']) + str(i) + 'x' * k for k in range(60))}" if i % 2 else notice.upper(), "en", "a") for i in range(20)] + [(99, notice, "en", "b")]
    got = {r["doc_id"]: r for r in quality_rules(documents(spark, rows), least_limit=5).collect()}
    assert all(got[i]["kept"] == (i % 2 == 1) and got[i]["n_removed_words"] == 90 for i in range(20) if not got[i]["base_failed"]) and got[99]["n_removed_words"] == 0
