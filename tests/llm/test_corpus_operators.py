import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from marlspike.llm import ann, mixing
from marlspike.llm import components as C
from marlspike.llm.components import components
from marlspike.llm.jaccard_join import jaccard_join, keep_one

from .conftest import documents, prose, texts, vectors


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset()


def brute_join(rows):
    sets = [shingles(x) for _, x in rows]
    up = [*range(len(rows))]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)), key=str)


def test_join_equals_brute_force_on_odd_rows(odd, none):
    assert sorted(map(tuple, jaccard_join(odd).collect()), key=str) == brute_join(texts(odd)) and jaccard_join(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_brute_force_on_chains_of_copies(spark, seed, monkeypatch):
    """Groups of copies that drift, so that links chain; passages that many texts share; sizes on both sides of the limit; sets of many documents."""
    from marlspike.llm import jaccard_join as module

    monkeypatch.setattr(module, "HEAVY_DOCS", 1 if seed else 500)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, rows = make(40), []
    for _ in range(12):
        base = make(rng.choice([20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            base = [*base]
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base + passage * (rng.random() < 0.2)))
            if rng.random() < 0.3:
                rows.append(rows[-1].upper())
    rng.shuffle(rows)
    docs = documents(spark, [(i, x, "en", "s") for i, x in enumerate(rows)])
    assert sorted(map(tuple, jaccard_join(docs).collect()), key=str) == brute_join(texts(docs))


def test_blocks_of_long_lists_lose_no_link(spark, monkeypatch):
    from marlspike.llm import jaccard_join as module

    monkeypatch.setattr(module, "BLOCK_MEMBERS", 4)
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for i in range(60):
        x = [*base]
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(80)] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(x), "en", "s"))
    docs = documents(spark, rows)
    assert sorted(map(tuple, jaccard_join(docs).collect()), key=str) == brute_join(texts(docs))


def test_one_of_each_group_stays(spark, odd):
    kept = keep_one(odd).collect()
    want = {(i, x) for (i, x), (_, _, c) in zip(sorted(texts(odd), key=str), brute_join(texts(odd)), strict=False) if i is None}
    comp = {k: c for k, _, c in brute_join(texts(odd)) if k is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(k for k, c in comp.items() if k == c) and len([r for r in kept if r["doc_id"] is None]) == len(want)


@pytest.mark.parametrize("heavy", [3, 500])
def test_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(C, "HEAVY_ROWS", heavy)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000 + i % 3, 2100 + i) for i in range(90)] + [(2003, 2102), (2100, 2101)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def mix_by_sql(spark, docs):
    rows = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841  DuckDB finds it by name
    con = duckdb.connect()
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM rows")
    return con.sql(mixing.SQL).fetchall()


def test_mix_equals_its_sql_and_keeps_its_promises(spark, odd, none):
    rng = random.Random(6)
    docs = documents(spark, [(i, prose(rng, rng.randint(0, 200)) + "#" * rng.randint(0, 5), "en", rng.choice("aaaaabcdé")) for i in range(400)])
    for d in (docs, odd.where("doc_id is null or doc_id <> 5")):
        got = sorted(map(tuple, mixing.mix(d).collect()), key=str)
        assert got == sorted(mix_by_sql(spark, d), key=str) and got == sorted(map(tuple, mixing.mix(d.repartition(3)).collect()), key=str)
        assert all(0 <= t <= 2 * s for _, s, _, _, t in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for (i, s, n, target, taken), src in zip(sorted(map(tuple, mixing.mix(docs).collect())), [r["source"] for r in docs.orderBy("doc_id").collect()], strict=True):
        by[src][0] += taken
        by[src][1], by[src][2] = target, n
    assert all(abs(t - target) < 1 and target <= 2 * n for t, target, n in by.values()) and abs(sum(x[0] for x in by.values()) - 1.5 * sum(x[2] for x in by.values())) < 5
    assert mixing.mix(none).count() == 0
    assert sum(len((r["text"] or "").split()) for r in mixing.mixed(docs).collect()) == sum(x[0] for x in by.values())


def test_better_documents_come_sooner(spark):
    rng = random.Random(7)
    docs = documents(spark, [(i, prose(rng, 20) + ("" if i % 2 else " #$%&|*" * 10), "en", "ab"[i % 4 == 0]) for i in range(2000)])
    taken = mixing.mix(docs).where("size > 0").collect()
    share = lambda k: np.mean([r["taken"] > r["size"] * int(r["target"] / r["source_size"]) for r in taken if r["doc_id"] % 2 == k])
    assert share(1) > share(0)


def brute_search(rows, every, top):
    ok = {}
    for k, v, *_ in rows:
        if k is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            ok.setdefault(len(v), []).append((k, np.array(v, np.float64)))
    best = max(ok.values(), key=lambda r: (len(r), len(r[0][1])), default=[])
    out = {}
    for q, x in best:
        if q % every == 0:
            out[q] = sorted(((float(x @ y), -k) for k, y in best if k != q), reverse=True)[:top]
    return {q: [(-k, s) for s, k in v] for q, v in out.items()}


def test_small_searches_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), 0, "x") for i in range(60)] + [(60 + i, [1.0, 0.0, 0.0, 0.0], 0, "x") for i in range(30)]
    rows += [(200, None, 0, "x"), (220, [0.0] * 4, 0, "x"), (240, [1.0, None, 0.0, 0.0], 0, "x"), (260, [float("nan")] * 4, 0, "x"), (280, [float("inf")] * 4, 0, "x"), (300, [1.0], 0, "x"), (None, [1.0] * 4, 0, "x")]
    got = defaultdict(list)
    for r in ann.search(vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = brute_search(rows, 20, 20)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert ann.search(vectors(spark, [])).count() == 0 and ann.search(vectors(spark, rows[:1])).count() == 0


def test_recall_and_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers[rng.integers(0, 30, 5000)] + 0.4 * rng.normal(size=(5000, 16)), np.tile(centers[:1], (700, 1))]).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in ann.search(vectors(spark, rows)).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute_search(rows, 20, 20)
    assert {*got} == {*want} and np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in want.items()]) >= 0.9


def test_pipeline_stages(spark, odd, vocabulary, tmp_path):
    """Each stage against the brute force of its own input: what it drops, what it leaves."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rng = random.Random(10)
    base = prose(rng, 100)
    more = [(200, base + " token = \"" + "0a" * 20 + "\"", "en", "a"), (201, base + " token = \"" + "0a" * 20 + "\" x", "en", "a"), (202, prose(rng, 90), "de", "c")]
    docs, seen = odd.unionByName(documents(spark, more)).select(*columns), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    first, second, third, fourth, last = seen.values()
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert not ids(first) & {1, 2, 3, 10, 12} and {200, 201, 202} <= ids(first)
    comp = {k: c for k, _, c in brute_join(texts(first))}
    assert {k for k in ids(second) if k is not None} == {k for k, c in comp.items() if k is not None and k == c} and 201 not in ids(second)
    assert third.count() == second.count() and "0a0a" not in third.where("doc_id = 200").first()["text"] and "[SECRET]" in third.where("doc_id = 200").first()["text"]
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert abs(words(fourth) - 1.5 * words(third)) <= 10
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty() and ids(last) == ids(fourth)


def test_blocks_are_ranked_by_the_reported_score():
    rng = np.random.default_rng(12)
    r_x = np.concatenate([rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (60, 1))])
    r_id, q_x = rng.permutation(360), np.concatenate([r_x[290:320], [[1e200] * 6]])
    q_id = np.append(r_id[290:320], 999)
    r_x[5] = 1e200  # its product with the last query overflows, and is the largest
    for top in (1, 20, 500):
        at, row, score = ann.best_rows(q_id, q_x, r_id, r_x, top)
        for i in range(len(q_id)):
            exact = np.einsum("nd,nd->n", np.repeat(q_x[i : i + 1], 360, 0), r_x)
            want = sorted((-s, k) for s, k in zip(exact.tolist(), r_id.tolist(), strict=True) if k != q_id[i])[:top]
            assert [(-s, k) for s, k in zip(score[at == i].tolist(), r_id[row[at == i]].tolist(), strict=True)] == want
