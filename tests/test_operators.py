import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspike.operators import aggregates as A
from marlspike.operators import chat as C
from marlspike.operators import evidence as E
from marlspike.operators import pairing as J
from marlspike.operators import retrieval as R
from marlspike.operators import store as S
from marlspike.schema import CLAIMS


def scored(spark, rows):
    return spark.createDataFrame(rows, "id string, score double")


def test_fusion_order_ties_and_scores(spark):
    got = R.fuse(scored(spark, [("only-w", 2.0), ("both", 3.0)]), scored(spark, [("only-v", 0.5), ("both", 0.9)])).orderBy(F.desc("rrf"), "id").collect()
    assert [r["id"] for r in got] == ["both", "only-v", "only-w"] and got[0]["score"] == 3.0
    assert R.fuse(scored(spark, [("x", 0.0)]), scored(spark, [("x", 0.87)])).first()["score"] == 0.87


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 20), unique=True, max_size=8), st.lists(st.integers(0, 20), unique=True, max_size=8))
def test_fusion_commutes(spark, a, b):
    make = lambda xs: scored(spark, [(str(x), float(50 - i)) for i, x in enumerate(xs)])
    ranks = lambda x, y: {r["id"]: round(r["rrf"], 12) for r in R.fuse(make(x), make(y)).collect()}
    assert ranks(a, b) == ranks(b, a)


def test_filters_come_before_the_limit_and_undated_last(spark):
    rows = [("i1", "info", "s:kb", "", "", 0.9), ("i2", "info", "s:ops", "2026-08-19", "", 0.8), ("f1", "facts", "s:ops", "2026-08-01", "2026-08-05", 0.1)]
    hits = spark.createDataFrame(rows, "id string, root string, source string, valid_from string, valid_to string, rrf double")
    ids = lambda **k: [r["id"] for r in R.select_hits(hits, **k).collect()]
    assert ids(n=1, root="facts") == ["f1"] and ids(n=2, repo="ops") == ["i2", "f1"] and ids(n=0) == ["i1", "i2", "f1"]
    assert ids(sort="asc") == ["f1", "i2", "i1"] and ids(sort="desc") == ["i2", "f1", "i1"] and ids(as_of="2026-08-10") == ["i1"]


def test_bm25_ranks_rare_terms_first(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "other")], "id int, text string")
    assert [r["id"] for r in R.bm25(docs, "rare common", 5).collect()] == [1, 2] and R.bm25(docs, "?!", 5).count() == 0


def source(kind, key, stale=False):
    return (key, kind, "", stale)


def test_adjudication_table(spark):
    rc = [source("runtime", "a"), source("config", "b")]
    cases = [
        ("both strong", rc, rc, "hypothesis", "unresolved", ""), ("stale", rc, [source("narrative", "c", True), source("narrative", "d", True)], "confirmed", "temporal_freshness", "yes"),
        ("weak", rc, [source("narrative", "c"), source("narrative", "d")], "confirmed", "authority_pairing", "yes"), ("alone", rc, [], "confirmed", "two_source", "yes"),
        ("against", [], rc, "confirmed", "two_source", "no"), ("one", [source("narrative", "a")], [], "hypothesis", "single_source", ""),
        ("twice", [source("config", "a"), source("config", "a")], None, "hypothesis", "single_source", ""), ("blank", [source("config", ""), source("config", "")], [], "confirmed", "two_source", "yes"),
    ]
    got = {r["text"]: r for r in E.adjudicate(spark.createDataFrame([c[:3] for c in cases], CLAIMS)).collect()}
    assert {k: (got[k]["confidence"], got[k]["rule"], got[k]["winner"]) for k, *_ in cases} == {c[0]: c[3:] for c in cases}


def test_fact_audit(spark):
    rows = [
        ("1", "a.md x b.md", "l", "h", "confirmed"), ("2", "a.md", "l", "h", "confirmed"), ("3", "a x b vs c x d", "l", "h", "confirmed"), ("4", "a x b vs c x d", "l", "h", "hypothesis"),
        ("5", "a only", "l", "h", "hypothesis"), ("6", "a x b", "", "", "confirmed"), ("7", "a x b", "l", "h", "other"), ("8", "solo", "l", "h", "partial"),
    ]
    found = {}
    for r in E.audit_facts(spark.createDataFrame(rows, "id string, source string, loc string, how string, confidence string")).orderBy("id", "problem_no").collect():
        found.setdefault(r["id"], []).append(r["problem"])
    assert found == {"2": ["needs two sources"], "3": ["contradiction kept"], "5": ["needs both sides"], "6": ["missing loc", "missing how"], "7": ["unknown confidence"]}


def test_escalation(spark):
    hits = lambda rows: spark.createDataFrame(rows, "root string, confidence string")
    escalate = lambda rows, root="": E.should_escalate(hits(rows), root).first()["escalate"]
    assert escalate([]) and escalate([("info", "confirmed")]) and escalate([("facts", "hypothesis")])
    assert not escalate([("facts", "")]) and not escalate([], "facts")
    asked = []
    assert E.deduce(hits([("facts", "confirmed")]), lambda: asked.append(1)) is None and not asked
    assert E.deduce(hits([]), lambda: {"status": "ok"}) == {"status": "ok"} and E.deduce(hits([]), lambda: 1, no_web=True) is None


def test_claims_of_three_shapes(spark):
    one = '{"text": "t", "yes": [{"id": "a", "kind": "config"}]}'
    payload = spark.createDataFrame([(one,), (f"[{one}, {one}]",), ('{"claims": [' + one + "]}",)], "value string")
    assert E.claims_of(payload).count() == 4


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    q = A.quantiles(df, "v").first()
    assert (q["n"], q["min"], q["p50"], q["max"], q["avg"]) == (5, 1.0, 3.0, 5.0, 3.0) and 4.5 <= q["p95"] <= 5
    assert A.at_index(df, "v", [], A.STRESS).first()["p99"] == 4.0 and A.at_index(df, "v", [], A.SYSTEM).first()["p95"] == 5.0


def test_semver(spark):
    bump = lambda *s: A.semver_bump(spark.createDataFrame([(x,) for x in s], "subject string")).first()["bump"]
    assert (bump("fix: a"), bump("feat: a", "fix: b"), bump("feat!: a"), bump("x: breaking change"), bump()) == ("patch", "minor", "major", "major", "none")
    nxt = lambda v, b: spark.range(1).select(A.next_version(F.lit(v), F.lit(b)).alias("x")).first()["x"]
    assert (nxt("v1.2.3", "major"), nxt("1.2", "minor"), nxt("", "patch"), nxt("v1", "none")) == ("v2.0.0", "v1.3.0", "v0.0.1", None)


def chat(spark, texts):
    return spark.createDataFrame([("c", i, str(i), f, t, "p") for i, (f, t) in enumerate(texts)], "chat_id string, seq int, id string, `from` string, text string, platform string")


def test_chat_facts(spark):
    m = chat(spark, [("", "hi"), ("Ann", "call +49 30 1234567 or A.b@X.org"), ("Bob", "linkedin.com/in/ann-x works at Acme; project: Moon")])
    got = [(r["fact_type"], r["value"], r["chat_name"]) for r in C.chat_facts(m).orderBy("seq", "n").collect()]
    assert got == [("phone", "+49 30 1234567", "Ann"), ("email", "a.b@x.org", "Ann"), ("linkedin", "https://linkedin.com/in/ann-x", "Ann"), ("project", "Moon", "Ann"), ("skill", "works at Acme", "Ann")]
    assert C.dedupe_facts(C.chat_facts(m.unionByName(m.withColumn("seq", F.col("seq") + 10)))).count() == 5


def test_participants_and_mode(spark):
    m = chat(spark, [("b", ""), ("a", ""), ("a", ""), ("unknown", ""), ("unknown", ""), ("unknown", ""), ("c", ""), ("d", "")])
    assert C.main_sender(m).first()["sender"] == "a" and C.participants(m).first()["kind"] == "group"


def test_pairings(spark):
    orgs = spark.createDataFrame([("x", "Acme Corp / Zeta"), ("y", "Nope"), ("z", "")], "org string, label string")
    companies = spark.createDataFrame([("Big acme",), ("zeta ltd",), ("Z end",)], "company string")
    m = J.label_matches(orgs, companies)
    assert {(r["org"], r["company"]) for r in m.collect()} == {("x", "Big acme"), ("z", "Big acme")} or {r["org"] for r in m.collect()} == {"x", "z"}
    assert [r["org"] for r in J.unmatched(orgs, m).collect()] == ["y"]
    chats = spark.createDataFrame([("1", "Ann Lee"), ("2", "Bo"), ("3", "Q")], "chat_id string, name string")
    contacts = spark.createDataFrame([(1, "Ann", "x@y"), (2, "Ann Lee", "z@y"), (3, "Cy", "bo@y")], "contact_id int, name string, email string")
    assert {(r["chat_id"], r["contact_id"]) for r in J.contact_lookup(chats, contacts).collect()} == {("1", 2), ("2", 3)}


def test_upsert_and_store(spark, tmp_path):
    now = "2024-01-01T00:00:00Z"
    new = spark.createDataFrame([("t", "s", [1.0]), ("u", "s", None)], "text string, source string, embedding array<float>")
    store = S.Store(spark, str(tmp_path / "store"))
    store.add(new, now)
    store.add(new.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("loc", F.lit("l")), now)
    rows = {r["text"]: r for r in store.read().collect()}
    assert len(rows) == 2 and rows["t"]["embedding"] == [1.0] and rows["t"]["loc"] == "l" and len(rows["t"]["id"]) == 24
    before = store.current()
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("", "s"), ("v", "s")], "text string, source string"), now)
    assert store.current() == before
    assert S.missing(S.complete(new, now), store.read()).isEmpty()


def test_hops(spark):
    e = lambda *p: spark.createDataFrame(list(p), "src string, dst string")
    n = lambda *p: spark.createDataFrame(list(p), "id string, name string")
    edges = [(e(("l", "f")), n(("f", "F")), "File"), (e(("f", "c"), ("f", "d")), n(("c", "C"), ("d", "D")), "Commit"), (e(("c", "p"), ("d", "p")), n(("p", "P")), "Person")]
    hits = spark.createDataFrame([("l",), ("m",)], "id string")
    got = {r["id"]: [(h["label"], h["name"], h["depth"]) for h in r["hops"]] for r in R.attach_hops(hits, R.hops(hits, edges, 3)).collect()}
    assert got == {"l": [("File", "F", 1), ("Commit", "C", 2), ("Commit", "D", 2), ("Person", "P", 3)], "m": []}


def test_reports(spark):
    from marlspike.operators import reports as P

    body = '{"choices": [{"message": {"tool_calls": [{"function": {"name": "search", "arguments": "{}"}}], "content": "x"}}]}'
    leak = '{"choices": [{"message": {"content": "<tool_call name=search>"}}]}'
    calls = P.tool_calls(spark.createDataFrame([("a", body), ("b", leak)], "prompt string, body string"))
    wanted = spark.createDataFrame([("a", "search"), ("b", "get"), ("c", "get")], "prompt string, wanted string")
    assert tuple(P.tool_report(calls, wanted).first()) == (3, 1, 1)
    assert P.process_memory(spark.createDataFrame([('{"models": [{"name": "m", "size": 3145728}]}',)], "value string")).first()["mib"] == 3
    values = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert [r["stretched"] for r in P.stretched(values, "v").orderBy("v").collect()] == [0.0, 128.0, 255.0]
    picked = P.weighted_pick(values, {"a": 1, "b": 1}, F.col("v") / 4).orderBy("v").collect()
    assert [r["endpoint"] for r in picked] == ["a", "b", "b"]
    rows = spark.createDataFrame([("s", i) for i in range(5)] + [("t", 1)], "source string, n int")
    assert P.per_source(rows, 1, 2, "n").count() == 2 and P.per_source(rows, 1, 0, "n").count() == 4


def test_rendering(spark):
    from marlspike.functions import render as W

    df = spark.createDataFrame([("a: b", "x\ny", ["1", "2"])], "source string, text string, mails array<string>")
    assert df.select(W.leaf_yaml("source", "text").alias("y")).first()["y"] == '  - source: "a: b"\n    text: |-\n      x\n      y'
    assert W.as_csv(df, "source", "mails").first()["value"] == "a: b,1;2" and W.as_json(df, "source").first()["value"] == '{"source":"a: b"}'
    assert W.to_yaml({"q": "a", "hits": [{"id": 1}], "none": [], "s": "yes"}) == 'q: a\nhits:\n  -\n    id: 1\nnone: []\ns: "yes"\n'


def test_tokens_and_parents(spark):
    orgs = spark.createDataFrame([("x", "The Quantum (Labs)"), ("y", "ab cd")], "org string, label string")
    companies = spark.createDataFrame([("megaquantumcorp",), ("other",)], "company string")
    assert [tuple(r) for r in J.token_matches(orgs, companies).collect()] == [("x", "megaquantumcorp")]
    projects = spark.createDataFrame([("p", "Other"), ("q", "")], "project string, parent string")
    assert [tuple(r) for r in J.project_matches(companies, projects).collect()] == [("other", "p")]


NOW = "2024-01-01T00:00:00Z"


def written(store):
    """Folders by kind."""
    from pathlib import Path

    return {kind: {x.name for x in p.iterdir() if x.is_dir()} for kind in ("leafs", "words", "vectors", "dead", "tables") if (p := Path(store.path) / kind).exists()}


def hits(store, q, k=50):
    return [tuple(r) for r in store.words().search(q, k).orderBy(F.desc("score"), "id").collect()]


def scanned(store, q, k=50):
    return sorted(((r["id"], round(r["score"], 9)) for r in R.bm25(store.read(), q).collect()), key=lambda x: (-x[1], x[0]))[:k]


def test_store_versions_segments_and_index(spark, tmp_path, monkeypatch):
    """A batch writes its own rows, tombstones and postings; a run that fails, or comes second, leaves a whole version; words come from stored postings."""
    leafs = lambda rows: spark.createDataFrame(rows, "text string, source string, seq int")
    store = S.Store(spark, str(tmp_path / "s"))
    assert store.read().isEmpty() and store.words().search("word", 3).isEmpty()
    rows = [(f"common word{i % 5} text {i}", f"s{i}", i) for i in range(40)]
    assert store.add(leafs(rows), NOW, "seq") == 1 and store.index() == 2 and store.index() == 2
    names = store.version()[1]
    assert [x["rows"] for x in names["segments"]] == [40] and hits(store, "word3 text") == scanned(store, "word3 text") and len(hits(store, "word3")) == 8
    store.add(leafs([("common word3 text 3", "s3", 1), ("a new word3", "s99", 2)]), NOW, "seq")
    after = store.version()[1]
    assert after["segments"][0] == names["segments"][0] and after["segments"][1]["rows"] == 2 and after["segments"][1]["words"] and store.read().count() == 41
    assert spark.read.parquet(f"{store.path}/{after['segments'][1]['path']}").count() == 2 and spark.read.parquet(f"{store.path}/{after['dead'][0]['path']}").count() == 1
    assert hits(store, "word3 new") == scanned(store, "word3 new") and len(hits(store, "word3")) == 9
    # the last row of an id wins by seq, whatever the order of partitions
    loc = spark.createDataFrame([("t", "s", "late", 9), ("t", "s", "early", 1)], "text string, source string, loc string, seq int").repartition(2, "loc")
    store.add(loc, NOW, "seq")
    assert store.read().where("text = 't'").first()["loc"] == "late"
    # another writer comes first, once
    other, commit = S.Store(spark, str(tmp_path / "s")), S.Store._commit
    calls = []

    def late(self, number, named):
        calls.append(number)
        if len(calls) == 1:
            other._change(lambda n: n | {"tables": n["tables"] | {"x": "tables/none"}})
            calls.append(0)
        return commit(self, number, named)

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", late.__get__(store))
        store.add(leafs([("second", "s", 1)]), NOW)
    assert store.version()[1]["tables"] == {"x": "tables/none"} and store.read().where("text = 'second'").count() == 1 and calls[-1] == calls[0] + 1
    rows_before, gone = sorted(map(str, store.read().collect())), store.clean(1, 0)
    assert gone > 0 and sorted(map(str, store.read().collect())) == rows_before and hits(store, "word3") == scanned(store, "word3")
    assert store.compact() and len(store.version()[1]["segments"]) == 1 and not store.version()[1]["dead"]
    assert sorted(map(str, store.read().collect())) == rows_before and hits(store, "word3 text") == scanned(store, "word3 text")
    assert store.replace(store.read().limit(5)) and store.read().count() == 5 and len(hits(store, "text common")) == len(scanned(store, "text common"))


def test_a_batch_that_comes_again_leaves_no_tombstones_and_no_second_copy(spark, tmp_path):
    leafs = lambda *ks: spark.createDataFrame([(f"common word{k}", f"s{k}", [float(k)]) for k in ks], "text string, source string, embedding array<float>")
    store = S.Store(spark, str(tmp_path / "s"))
    store.add(leafs(*range(6)), NOW)
    store.add(leafs(*range(6, 9)), NOW)
    store.index()
    at = lambda: [x["rows"] for x in store.version()[1]["segments"]]
    before = sorted(map(str, store.read().collect()))
    store.add(leafs(*range(6)).drop("embedding"), NOW)  # embeddings stay
    assert at() == [3, 6] and not store.version()[1]["dead"] and not written(store).get("dead") and sorted(map(str, store.read().collect())) == before
    store.add(leafs(0, 1, 6), NOW)  # parts of two segments, then the rest of one of them
    assert at() == [3, 6, 3] and store.snapshot().dead_rows() == 3 and sorted(map(str, store.read().collect())) == before
    store.add(leafs(7, 8), NOW)
    assert at() == [6, 3, 2] and store.snapshot().dead_rows() == 2 and sorted(map(str, store.read().collect())) == before
    assert hits(store, "common word7") == scanned(store, "common word7") and len(hits(store, "common")) == 9
    store.apply(leafs(), store.read().select("id"), NOW)
    assert at() == [] and store.read().isEmpty() and not hits(store, "common")


@pytest.mark.parametrize("step", ["_tombstones", "_segment", "_indexed", "_commit"])
def test_a_stop_between_steps_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    leafs = lambda rows: spark.createDataFrame(rows, "text string, source string")
    store = S.Store(spark, str(tmp_path / "s"))
    store.add(leafs([(f"word {i}", "s") for i in range(9)]), NOW)
    store.index()
    before, rows, found = store.current(), sorted(map(str, store.read().collect())), hits(store, "word 3")
    done = getattr(S.Store, step)

    def stops(self, *a):
        if step != "_commit":
            done(self, *a)
        raise RuntimeError("stopped")

    for change in (lambda: store.add(leafs([("word 3", "s"), ("lost", "s")]), NOW), store.compact):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(S.Store, step, stops)
            change()
            raise RuntimeError("this way has no such step")
        assert store.current() == before and sorted(map(str, store.read().collect())) == rows and hits(store, "word 3") == found
    held = written(store)
    store.add(leafs([("word 3", "s"), ("kept", "s")]), NOW)
    assert store.read().count() == 10 and any(len(written(store)[k]) > len(held[k]) for k in held)


def test_clean_spares_a_run_that_is_at_work(spark, tmp_path, monkeypatch):
    leafs = lambda rows: spark.createDataFrame(rows, "text string, source string")
    store, commit = S.Store(spark, str(tmp_path / "s")), S.Store._commit
    store.add(leafs([(f"word {i}", "s") for i in range(9)]), NOW)
    with monkeypatch.context() as m:
        m.setattr(S.Store, "_commit", lambda self, *a: S.Store(spark, self.path).clean(1) or commit(self, *a))
        store.add(leafs([("word 3", "s"), ("while cleaned", "s")]), NOW)
    assert store.read().count() == 10 and store.read().where("text = 'while cleaned'").count() == 1


def test_embeddings_stay_and_leafs_go(spark, tmp_path):
    store, schema = S.Store(spark, str(tmp_path / "s")), "text string, source string, loc string, embedding array<float>"
    store.add(spark.createDataFrame([("a", "s", "1", [1.0, 0.0]), ("b", "s", "1", None), ("c", "s", "1", [0.0, 1.0])], schema), NOW)
    store.index()
    store.add(spark.createDataFrame([("a", "s", "2", None), ("b", "s", "2", [1.0, 1.0])], schema), NOW)
    got = {r["text"]: (r["loc"], r["embedding"]) for r in store.read().collect()}
    assert got == {"a": ("2", [1.0, 0.0]), "b": ("2", [1.0, 1.0]), "c": ("1", [0.0, 1.0])}
    assert {r["id"] for r in store.snapshot().near([1.0, 0.0]).collect()} == {r["id"] for r in store.read().collect()}
    gone = store.read().where("text in ('a', 'c')").select("id")
    before = store.current()
    assert store.apply(spark.createDataFrame([("c", "s", "3", None), ("d", "s", "1", None)], schema), gone, NOW) == before + 1
    got = {r["text"]: (r["loc"], r["embedding"]) for r in store.read().collect()}
    assert got == {"b": ("2", [1.0, 1.0]), "c": ("3", [0.0, 1.0]), "d": ("1", None)} and hits(store, "a b c d") == scanned(store, "a b c d")


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, tmp_path, monkeypatch):
    from marlspike.operators import segments

    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["common", "word", "other", "more", f"rare{rng.randrange(50)}"]) for _ in range(rng.choice([4, 20, 200, 700])))
    store = S.Store(spark, str(tmp_path / "s"))
    store.add(spark.createDataFrame([(text(), f"s{i}") for i in range(1500)], "text string, source string"), NOW)
    store.index()
    store.add(store.read().where("source like 's1%'").withColumn("source", F.concat("source", F.lit("x"))), NOW)
    store.apply(spark.createDataFrame([("common common", "last")], "text string, source string"), store.read().where("source like 's2%'").select("id"), NOW)
    monkeypatch.setattr(segments, "READ_ALL", 10**9)
    for block in (1024, 16):
        monkeypatch.setattr(segments, "BLOCK", block)
        for q in ("common", "common rare7 word", "rare1 rare2"):
            monkeypatch.setattr(segments, "READ_ALL", 0)
            words = store.words()
            got = [tuple(r) for r in words.search(q, 10).orderBy(F.desc("score"), "id").collect()]
            assert got == scanned(store, q, 10)
            read, there = (x.agg(F.sum("n")).first()[0] for x in (words.blocks_read, words.blocks.where(F.col("term").isin(R.terms_of(q)))))
            assert read <= there and (read < there / 2 or q != "common")
        store.compact()


def test_near_vectors_read_a_part_and_find_the_nearest(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(40, 32))
    vectors = middles[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 32))
    rows = [(f"t{i}", "s", [*map(float, v)]) for i, v in enumerate(vectors)] + [("zero", "s", [0.0] * 32), ("short", "s", [1.0])]
    store = S.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame(rows, "text string, source string, embedding array<float>")
    store.add(df.where("text < 't2'"), NOW)
    store.index()
    store.add(df.where("text >= 't2' or text in ('zero', 'short')"), NOW)
    found = asked = read = 0
    for q in vectors[::300]:
        near = store.snapshot().near([*map(float, q)])
        best = lambda v: {r["id"] for r in R.cosine(v.where("size(embedding) = 32"), [*map(float, q)], 10).collect()}  # noqa: B023, E731
        want, got, read = best(store.read()), best(near), read + near.count()
        found, asked = found + len(want & got), asked + 10
    assert found / asked >= 0.95 and read < 0.5 * 10 * 3002


def test_near_vectors_are_found_without_clusters(spark, tmp_path):
    import numpy as np

    vectors = np.random.default_rng(7).normal(size=(1200, 32))
    store = S.Store(spark, str(tmp_path / "s"))
    store.add(spark.createDataFrame([(f"t{i}", "s", [*map(float, v)]) for i, v in enumerate(vectors)], "text string, source string, embedding array<float>"), NOW)
    store.index()
    now, found = store.snapshot(), 0
    for q in vectors[::100] + 0.1:
        best = lambda v: {r["id"] for r in R.cosine(v, [*map(float, q)], 10).collect()}  # noqa: B023, E731
        found += len(best(now.read()) & best(now.near([*map(float, q)])))
    assert found >= 0.95 * 120


def test_batch_bounds():
    assert [S.batch_bounds(n, 64) for n in (0, 5, 100, 128, 130)] == [[], [(0, 5)], [(0, 64), (64, 100)], [(0, 64), (64, 128)], [(0, 64), (64, 128), (128, 130)]] and S.batch_bounds(10, 0) == [(0, 10)]


def test_labels_are_trimmed_of_blanks_alone(spark):
    orgs = spark.createDataFrame([("x", "q / alpha 01")], "org string, label string")
    companies = spark.createDataFrame([("the alpha 01",), ("alpha",)], "company string")
    assert [r["company"] for r in J.label_matches(orgs, companies).collect()] == ["the alpha 01"]


def test_mentions(spark):
    hosts = spark.createDataFrame([("web-1",), ("db.x",), ("a+b",), ("été",)], "host string")
    docs = spark.createDataFrame([("p", "see WEB-1, db_x and (A+B)"), ("o", "web-1"), ("q", "xweb-1 web-12 adb.x")], "path string, text string")
    assert sorted(map(tuple, J.mentions(hosts, docs).collect())) == [("a+b", "p"), ("web-1", "o")]


def test_containments_equal_brute_force(spark):
    rng = random.Random(5)
    text = lambda most: "".join(rng.choice("aab c𝕏") for _ in range(rng.randint(0, most)))
    needles, hays = [text(5) for _ in range(150)] + ["", None, "zzz"], [text(12) for _ in range(200)] + ["", None, "a", "ab"]
    a = spark.createDataFrame([(x,) for x in {*needles}], "needle string")
    b = spark.createDataFrame([(x,) for x in {*hays}], "hay string")
    got = sorted((r["needle"], r["hay"]) for r in J.containments(a, b).collect())
    assert got == sorted((n, h) for n in {*needles} for h in {*hays} if n and h and n in h) and len(got) > 1000
    assert J.containments(a.limit(0), b).isEmpty() and J.containments(a, b.limit(0)).isEmpty()


def test_needles_meet_on_their_rarest_gram(spark):
    """A needle whose other grams all texts share meets the one text that has its rare gram, not all of them."""
    hays = spark.createDataFrame([(f"common{k}",) for k in range(500)] + [("commonq1",)], "hay string")
    needles = spark.createDataFrame([("commonq",), ("commonzz",)], "needle string")
    found = J.containments(needles, hays)
    assert [tuple(r) for r in found.collect()] == [("commonq", "commonq1")]
    joined = [x for x in str(found._jdf.queryExecution().executedPlan()).splitlines() if "Join" in x]
    assert not any("Cartesian" in x or "NestedLoop" in x for x in joined)


def test_contact_lookup_equals_brute_force(spark):
    rng = random.Random(6)
    names = ["Ann", "ann lee", "Ann Lee", "Bo", "Bo  Xu", "Cy", "", None, "Leeds", "xu", " ann "]
    chats = [(str(k), rng.choice(names)) for k in range(60)] + [("0", "Zed")]
    contacts = [(rng.choice([*range(30), None]), rng.choice(["Ann", "Ann Lee", "Lee", "Bob Xu", "", None]), rng.choice(["bo@x", "CY@x", "", None])) for _ in range(12)]

    def best(name):
        n = (name or "").strip(" ").lower()
        found = []
        for i, c, mail in contacts if n else []:
            c, mail = (c or "").strip(" ").lower(), (mail or "").lower()
            if c and i is not None:
                ways = [n == c, n in c, c.split()[0] in n, n.split()[0] in mail]
                found += [(k, i) for k, w in enumerate(ways) if w]
        return min(found, default=None)

    want = {}
    for chat, name in chats:
        if best(name) and (chat not in want or best(name) < want[chat]):
            want[chat] = best(name)
    df = J.contact_lookup(spark.createDataFrame(chats, "chat_id string, name string"), spark.createDataFrame(contacts, "contact_id int, name string, email string"))
    assert {r["chat_id"]: (r["priority"], r["contact_id"]) for r in df.collect()} == want and {k for k, _ in want.values()} >= {0, 2}


def test_contact_lookup_of_equal_first_names(spark):
    """3,000 chats and 3,000 contacts with one first name: nine million pairs that aren't made."""
    n = spark.range(3000)
    chats, contacts = n.select(F.col("id").alias("chat_id"), F.concat(F.lit("Ann C"), "id").alias("name")), n.select(F.col("id").alias("contact_id"), F.concat(F.lit("Ann P"), "id").alias("name"), F.concat(F.lit("ann"), "id", F.lit("@x")).alias("email"))
    df = J.contact_lookup(chats, contacts)
    assert df.groupBy("contact_id", "priority").count().collect() == [(0, 2, 3000)]
