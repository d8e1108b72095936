"""Leases, answers and turns that processes share, and a store that refuses a writer whose lease has passed on."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from marlspike.lease import Answers, Lease, Lost, Turns, create, read
from marlspike.operators.store import Store
from marlspike.sources import web


class Clock:
    def __init__(self):
        self.now = 100.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_a_lease_has_one_holder_and_fences_grow(spark, tmp_path):
    clock = Clock()
    one, two = (Lease(spark, str(tmp_path / "l"), 60, clock) for _ in range(2))
    first = one.take()
    assert first and two.take() is None and one.value() is None
    clock.now += 50
    one.renew()
    clock.now += 50
    assert two.take() is None
    clock.now += 11
    second = two.take()
    assert second > first
    for late in (one.renew, one.release, one.value):
        with pytest.raises(Lost):
            late()
    two.release({"n": 3})
    with pytest.raises(Lost):
        two.renew()
    with one.held(sleep=clock.sleep) as held:
        assert held.fence > second and held.value() == {"n": 3}
        with pytest.raises(TimeoutError), two.held(5, clock.sleep):
            pass
    assert two.take() and two.value() == {"n": 3}
    assert len([*(tmp_path / "l").glob("*.json")]) == 2


def test_of_many_that_make_one_file_one_succeeds(spark, tmp_path):
    at = str(tmp_path / "d/x.json")
    with ThreadPoolExecutor(8) as pool:
        made = [*pool.map(lambda k: create(spark, at, {"k": k}), range(24))]
    assert made.count(True) == 1 and read(spark, at) == {"k": made.index(True)} and read(spark, f"{at}.none") is None
    assert create(spark, at, {"k": -1}, replace=True) and read(spark, at) == {"k": -1}
    assert [x.name for x in (tmp_path / "d").iterdir() if not x.name.endswith(".crc")] == ["x.json"]

    def add(_):
        with Lease(spark, str(tmp_path / "n"), 60).held(60, step=0.01) as lease:
            lease.release((lease.value() or 0) + 1)

    with ThreadPoolExecutor(4) as pool:
        assert len([*pool.map(add, range(12))]) == 12
    assert Lease(spark, str(tmp_path / "n")).last()[1]["value"] == 12


def test_lookups_share_answers_and_turns(spark, tmp_path):
    clock, calls = Clock(), []

    def fetch(q):
        calls.append((q, clock.now))
        if q == "down":
            raise ConnectionError("refused by peer")
        return {"results": [{"title": q}]} if q != "none" else {"results": []}

    lease = lambda: Lease(spark, str(tmp_path / "turns"), 60, clock)
    look = lambda: web.Lookup(fetch, web.private_reason, clock, clock.sleep, Answers(spark, str(tmp_path / "answers")), Turns(lease(), 20))
    a, b = look(), look()
    assert a("x")["status"] == "ok" and b("X ")["cached"] and calls == [("x", 100.0)]
    assert b("y")["status"] == "ok" and calls[-1] == ("y", 110.0)
    assert a("down") == {"status": "throttled", "note": "request failed: refused by peer", "cached": False, "results": []} and calls[-1][1] == 120.0
    assert b("none")["status"] == "throttled" and b("none")["cached"] is False and calls[-1][1] == 140.0
    other = lease()
    assert other.take() and a("z")["status"] == "skipped" and a("x")["cached"] and calls[-1][0] == "none"
    other.release()
    clock.now += web.TTL + 1
    assert not a("x")["cached"]


def test_a_writer_whose_lease_passed_on_is_refused(spark, tmp_path):
    clock, rows = Clock(), spark.createDataFrame([("t", "s")], "text string, source string")
    one, two = (Lease(spark, str(tmp_path / "l"), 60, clock) for _ in range(2))
    early = Store(spark, str(tmp_path / "s"), one.take())
    early.add(rows, "2024-01-01T00:00:00Z")
    clock.now += 61
    Store(spark, str(tmp_path / "s"), two.take()).add(rows.withColumn("text", rows["source"]), "2024-01-01T00:00:00Z")
    with pytest.raises(Lost):
        early.add(rows.selectExpr("concat(text, text) AS text", "source"), "2024-01-01T00:00:00Z")
    assert Store(spark, str(tmp_path / "s")).read().count() == 2
