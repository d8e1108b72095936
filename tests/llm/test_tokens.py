import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marlspike.llm.packing import candidates, pack, plan
from marlspike.llm.token_count import count_tokens, counter
from marlspike.llm.wavelet import Shard, build, encode_and_read

from .conftest import texts


def test_counts_equal_the_library(odd, none, vocabulary, library):
    got = sorted(map(tuple, count_tokens(odd, vocabulary, 50).collect()), key=str)
    n = lambda x: len(library.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((x or "").encode()), n(x), n(x) > 50) for i, x in texts(odd)), key=str)
    assert count_tokens(none, vocabulary).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_any_text_counts_as_the_library_has_it(text):
    import public_tokenizers

    c = counter(public_tokenizers.path("word_bpe_49k.json"))
    assert c.text(text) == len(c.library.encode(text, add_special_tokens=False).ids)


def encoded(df, library):
    return [(i, np.array([*library.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in texts(df)]


def test_packing_covers_every_id_once(odd, none, vocabulary, library):
    pieces = pack(odd, vocabulary, with_ids=True).collect()
    ids = {}
    for i, x in encoded(odd, library):
        ids.setdefault((i, len(x)), []).append(x.tolist())
    covered, by_sequence = {}, {}
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"]) > 0
        assert any(x[p["start"] : p["start"] + p["length"]] == p["ids"] for x in ids[p["doc_id"], p["doc_tokens"]])
        covered.setdefault((p["doc_id"], p["doc_tokens"]), []).extend(range(p["start"], p["start"] + p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted([*range(k[1])] * len(v)) for k, v in ids.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(none, vocabulary).count() == 0


def cost(at, fee, cuts, length):
    price = dict(zip(at, fee, strict=True))
    pad = lambda n: 0 if n & (n - 1) == 0 and n >= 64 else length - n
    return sum(pad(b - a) + price[b] + 1 for a, b in zip(cuts, cuts[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 9)), min_size=1, max_size=25))
def test_plans_are_the_cheapest(steps):
    at, fee = np.concatenate([[0], np.cumsum([s for s, _ in steps])]), np.array([0, *(f for _, f in steps)])
    length, n = 128, len(steps) + 1
    best = [0] + [10**9] * (n - 1)
    for j in range(1, n):
        for i in range(j):
            if at[j] - at[i] <= length:
                best[j] = min(best[j], best[i] + cost(at, fee, [at[i], at[j]], length))
    cuts = plan(at, fee, length)
    assert cuts[0] == 0 and cuts[-1] == at[-1] and cost(at, fee, cuts, length) == best[-1]


def test_candidates_are_never_far_apart():
    at, fee = candidates(np.array([5000, 1, 3]), np.zeros(5004, bool))
    assert at[0] == 0 and at[-1] == 5004 and np.diff(at).max() <= 128 and {5000, 5001} <= {*at.tolist()}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300))
def test_a_shard_answers_as_a_list_does(ids):
    a = np.array(ids, np.uint32)
    s = Shard(build(a, np.array([0]), [None]))
    assert s.decode().tolist() == ids and s.doc_ids == [None]
    for token in {*ids[:5], 0, 71_000}:
        where = [i for i, x in enumerate(ids) if x == token]
        assert s.count(token) == len(where) and s.positions(token) == where and s.rank(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in where)
    assert all(s.access(i) == ids[i] for i in range(0, len(ids), 7))


def test_shards_give_back_all_documents(odd, none, vocabulary, library):
    got = encode_and_read(odd, vocabulary).orderBy("start").collect()
    want = {}
    for i, x in encoded(odd, library):
        want.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    start, have = 0, {}
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert encode_and_read(none, vocabulary).count() == 0
