"""Listings with a place for each folder: pages in any order, limits, repeats, runs that stop."""

import json

from marlspike.streaming import folders as L


def page(at, name, **fields):
    at.mkdir(parents=True, exist_ok=True)
    (at / f"{name}.json").write_text(json.dumps(fields))


def run(spark, tmp_path, limit=0, files=64, until=None):
    """Rows listed so far by a query that goes on from its checkpoint."""
    out = str(tmp_path / "out")
    q = L.listed(L.pages(spark, str(tmp_path / "pages"), files), limit).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    with L.states(spark, 2):
        q = (q.trigger(availableNow=True) if until is None else q).start(out)
    if until is None:
        q.awaitTermination()
    else:
        for _ in range(60):
            there = spark.read.schema(L.LISTED).parquet(out).collect() if (tmp_path / "out/_spark_metadata/0").exists() else []
            if there and until(sorted(there, key=lambda r: (r["folder"], r["page"], r["id"] is None, r["seq"]))):
                break
            q.awaitTermination(0.5)
        q.stop()
    rows = spark.read.schema(L.LISTED).parquet(out)
    return rows, {f: [r["id"] for r in sorted(rows.collect(), key=lambda r: r["seq"]) if r["folder"] == f and r["id"]] for f in ("a", "b", "")}


def ids(*names, **removed):
    return [{"id": n} for n in names] + [{"id": k, "removed": v} for k, v in removed.items()]


def test_pages_in_any_order_come_once_and_places_move(spark, tmp_path):
    at = tmp_path / "pages"
    page(at / "x", "2", folder="a", link="a2", next="", delta="a-end", value=ids("3", gone=True) + [{"id": None}, {"id": ""}])
    page(at, "n", value=None, delta="n-end")
    page(at, "b1", folder="b", next="b2", value=ids("7", "8"), more={"folder": "clash"})
    rows, got = run(spark, tmp_path)
    assert got == {"a": [], "b": ["7", "8"], "": []}
    assert {r["folder"]: (r["taken"], r["link"]) for r in L.places(rows).collect()} == {"b": (2, "b2"), "": (0, "n-end")}
    page(at, "a1", folder="a", link="", next="a2", value=ids("1", "2"))
    page(at, "b1-again", folder="b", next="b2", value=ids("7", "8"))
    rows, got = run(spark, tmp_path, files=1)
    assert got == {"a": ["1", "2", "3"], "b": ["7", "8"], "": []}
    page(at, "a3", folder="a", link="a-end", delta="a-end-2", value=ids("3", "4"))
    rows, got = run(spark, tmp_path)
    assert got["a"] == ["1", "2", "3", "3", "4"]
    assert {r["folder"]: (r["taken"], r["link"]) for r in L.places(rows).collect()}["a"] == (5, "a-end-2")


def test_a_limit_keeps_the_place_until_a_page_is_taken_whole(spark, tmp_path):
    at = tmp_path / "pages"
    page(at, "1", folder="a", next="2", value=ids(*map(str, range(5))))
    page(at, "2", folder="a", link="2", delta="end", value=ids(*map(str, range(5, 8))))
    run(spark, tmp_path, limit=3, until=lambda found: found)
    page(at, "1-again", folder="a", next="2", value=ids(*map(str, range(5))))
    rows, got = run(spark, tmp_path, limit=3, until=lambda found: found[-1]["link"] == "end")
    assert got["a"] == [*map(str, range(8))] and [(r["taken"], r["link"]) for r in L.places(rows).collect()] == [(8, "end")]
    batches = rows.where("id is not null").groupBy("_metadata.file_path").count().collect()
    assert max(r["count"] for r in batches) == 3


def test_no_pages(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    assert run(spark, tmp_path)[0].count() == 0


class Held:
    """A state, of a value or a map, that counts what it is asked."""

    asked = 0

    def __init__(self):
        self.held = {}

    def ask(self, name, *a):
        Held.asked += 1
        return getattr(self.held, name)(*a)

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.ask("get", "")

    def update(self, value):
        self.ask("__setitem__", "", value)

    def containsKey(self, k):
        return self.ask("__contains__", k)

    def getValue(self, k):
        return self.ask("get", k)

    def updateValue(self, k, value):
        self.ask("__setitem__", k, value)

    def removeKey(self, k):
        self.ask("pop", k, None)


def test_states_are_asked_a_few_times_a_page_whatever_is_held(monkeypatch):
    import random

    import pandas as pd

    def walked(batches, held):
        monkeypatch.setattr(L, "HELD", held, raising=False)
        walk, Held.asked, out = L.Walk(0, 0), 0, []
        walk.place, walk.waiting, walk.done = Held(), Held(), Held()
        for pages in batches:
            chunks = [pd.DataFrame(pages[i : i + 50], columns=["link", "next", "delta", "ids"]) for i in range(0, len(pages), 50)]
            out += [tuple(r) for x in walk.handleInputRows(("f",), iter(chunks), None) for r in x.itertuples(index=False)]
        assert not walk.waiting.held
        return out, Held.asked

    links = ["", *map(str, range(1, 300))]
    pages = [(x, links[i + 1] if i < 299 else "", "end" if i == 299 else "", [f"{i}a", f"{i}b"]) for i, x in enumerate(links)]
    random.Random(2).shuffle(pages)
    batches = [pages[:150] + pages[20:70], pages[100:] + pages[:30]]
    want = [(f"{i}a", f"{i}b") for i in range(300)]
    for held in (10**6, 100, 1):
        out, asked = walked(batches, held)
        got = [r[3] for r in out if r[3] is not None]
        assert got == [x for two in want for x in two] and [r[1] for r in out if r[3] is None] == [*range(1, 301)] and out[-1][4] == "end"
        assert held < 10**6 or asked < 4 * 300
    # a link that leads back to a page that was taken ends the walk, as the same page isn't taken twice; a page that leads nowhere is taken once a batch
    assert [r[3] for r in walked([[("", "1", "", ["a"]), ("1", "", "", ["b"])], [("", "1", "", ["a"]), ("1", "", "", ["c"]), ("1", "", "", ["d"])]], 1)[0] if r[3]] in (["a", "b", "c"], ["a", "b", "d"])
