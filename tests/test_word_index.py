"""Stored postings against brute force, and what is shuffled to make and to ask them."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlspike.operators import blocks
from marlspike.operators import retrieval as R


def scores(texts, query):
    held = {i: Counter(t.lower().split()) for i, t in texts.items()}
    mean = sum(sum(c.values()) for c in held.values()) / len(texts)
    out = Counter()
    for w in {*query.lower().split()}:
        df = sum(w in c for c in held.values())
        for i, c in held.items():
            if c[w]:
                out[i] += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return sorted(((-round(s, 9), i) for i, s in out.items()))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_batches_find_what_brute_force_finds(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(3)
    monkeypatch.setattr(R, "TOGETHER", 3)
    monkeypatch.setattr(blocks, "HELD", 500)
    made = [" ".join(rng.choice(["all", "Some", "few", f"rare{rng.randrange(30)}"]) for _ in range(rng.choice([1, 5, 60]))) for _ in range(200)]
    texts = dict(enumerate(made + ["all few"] * 20 + [""]))
    texts = texts if kind == "long" else {f"k{i}": t for i, t in texts.items()}
    index = R.index_of(spark.createDataFrame([*texts.items()], f"id {kind}, text string").repartition(3), str(tmp_path / "index"))
    asked = {q: t for q, t in enumerate(["all", "all few", "rare1 rare2 Rare3", "none", "", "few all all some", "rare7"])}
    got = {}
    for r in index.batch(spark.createDataFrame([*asked.items()], "qid int, query string"), 4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((round(-r["score"], 6), r["id"]))
    want = {q: [(round(s, 6), i) for s, i in scores(texts, t)[:4]] for q, t in asked.items()}
    assert got == {q: w for q, w in want.items() if w}
    assert [(round(-r["score"], 6), r["id"]) for r in index.search("all few", 4).orderBy(F.desc("score"), "id").collect()] == want[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_posting_is_shuffled_to_make_an_index_and_none_meets_each_query(spark, tmp_path):
    leafs = spark.createDataFrame([(i, "all some " * 3) for i in range(300)], "id long, text string")
    assert "Exchange" not in plan(blocks.block_rows(leafs.select("id", R.tokens(F.col("text")).alias("t"))))
    index = R.index_of(leafs.coalesce(1), str(tmp_path / "index"))
    assert index.blocks.count() == 2
    found = index.batch(spark.createDataFrame([(q, "all some") for q in range(100)], "qid int, query string"), 2)
    assert found.count() == 200 and "FlatMapGroupsInArrow" in plan(found) and "Generate inline" not in plan(found)


def test_a_batch_is_read_once(spark, tmp_path):
    """A batch is computed for its segment alone: its check, its ids and what it replaces come from what was written, and token counts from postings."""
    from marlspike.operators.store import Store

    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    store, now = Store(spark, str(tmp_path / "s")), "2024-01-01T00:00:00Z"
    new = spark.createDataFrame([(f"all word{i}", f"s{i}") for i in range(40)], "text string, source string")
    store.add(new, now)
    store.index()
    store.add(new.where("source >= 's2'").withColumn("text", F.udf(seen, "string").asNondeterministic()("text")), now)
    assert read.value == new.where("source >= 's2'").count()
    names = store.version()[1]
    assert [(x["rows"], x["tokens"]) for x in names["segments"]] == [(40, 80), (read.value, 2 * read.value)] and store.read().count() == 40
    with pytest.raises(ValueError, match="text and source"):
        store.add(spark.createDataFrame([("", "s"), ("v", "s")], "text string, source string"), now)
    assert sorted(x.name for x in (tmp_path / "s/leafs").iterdir()) == sorted(x["key"] for x in names["segments"])
