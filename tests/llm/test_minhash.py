"""MinHash near-duplicates against all pairs of whole sets."""

import random

import numpy as np
import pytest

from marlspike.llm import minhash as M

from .conftest import documents
from .test_whole_job import edited


def word_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def expected(rows, size=2, percent=80):
    """doc_id, n, component, kept of each row (doc_id, text)."""
    at = [*range(len(rows))]

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    sets = [word_set(x, size) for _, x in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                at[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    found = [(d, len(sets[i]), least.get(root(i), d)) for i, (d, _) in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in found), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def corpus(rng):
    passage, rows = [f"p{i}" for i in range(60)], [None, "", " \n", "one", "One", "one two", "ONE two", "two one"]
    for k in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 9, 40, 150, 400]))] + passage * (k % 2)
        for _ in range(rng.choice([2, 12, 30])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 1, 1, 2, max(1, len(base) // 25), max(1, len(base) // 19)]))))
            base = edited(rng, base, 1) if rng.random() < 0.2 else base
    rows += [rows[20]] * 40 + [" ".join(passage) + f" own {i}" for i in range(30)]
    rng.shuffle(rows)
    return [(None if i % 23 == 5 else i, x) for i, x in enumerate(rows)] + [(7, rows[7]), (7, rows[7]), (7, "another text")]


@pytest.mark.parametrize("part", [6, 512])
def test_components_equal_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART_SETS", part)
    rows = corpus(random.Random(41))
    want = expected(rows)
    assert got(M.near_duplicates(documents(spark, [(d, x, "en", "s") for d, x in rows]).repartition(5))) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 100


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(M.near_duplicates(odd)) == expected(rows)
    assert M.near_duplicates(none).collect() == []


def test_no_candidate_is_lost_at_the_threshold():
    """Pairs of sets at a similarity of 0.8, small and large: they share a band, and their odd sketches differ by no more than is allowed."""
    rng, s, most = np.random.default_rng(42), M.Sampler(), M.most_differing(80)
    for n in (4, 8, 20, 100, 5000):
        differ = []
        for _ in range(400 if n < 5000 else 40):
            x = np.unique(rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) * np.uint64(2))
            a, b = x[: len(x) - n // 8], x[n // 4 - n // 8 :]  # both with 4/5 of the union at least
            u, v = s.samples(a), s.samples(b)
            assert set(s.bands(u).tolist()) & set(s.bands(v).tolist())
            differ.append(int(np.bitwise_count(s.odd(u).view(np.uint64) ^ s.odd(v).view(np.uint64)).sum()))
        both = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert max(differ) <= most and abs(M.similarity(float(np.mean(differ))) - both) < 0.04
    far = [s.odd(s.samples(np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)))).view(np.uint64) for _ in range(60)]
    assert min(int(np.bitwise_count(x ^ y).sum()) for i, x in enumerate(far) for y in far[:i]) > most


def test_a_group_of_copies_gives_few_pairs(spark, monkeypatch):
    rng, seen = random.Random(43), []
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(400)]
    monkeypatch.setattr(M, "PART_SETS", 40)
    kept = M.verified
    monkeypatch.setattr(M, "verified", lambda pairs, *a: seen.append(pairs.count()) or kept(pairs, *a))
    out = got(M.near_duplicates(documents(spark, [(d, x, "en", "s") for d, x in rows])))
    assert {c for _, _, c, _ in out} == {0} and sum(seen) < 1000
