"""Web search as a second source: payloads, a cache with a time to live, and the order of checks of a lookup."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.predicates import web_status
from marlspike.functions.text import text, web_snippet

PAYLOAD = "query string, results array<struct<title:string,url:string,content:string,engine:string>>, unresponsive_engines array<array<string>>"
#: Fixed times: seconds that an answer is kept, seconds between two calls.
TTL, INTERVAL = 7 * 24 * 3600, 10.0


def project(payloads: DataFrame, n: int = 5) -> DataFrame:
    """query, status, note, rank, title, url, snippet, engine of payloads (PAYLOAD); one row without a rank where there is no result."""
    engines = F.array_join(F.transform("unresponsive_engines", lambda e: F.concat_ws(": ", e)), "; ")
    status = web_status(F.col("results"))
    p = payloads.select("query", status.alias("status"), F.when(status == "throttled", F.concat(F.lit("no result: "), text(engines))).otherwise("").alias("note"), F.posexplode_outer(F.slice("results", 1, n)).alias("pos", "r"))
    return p.select("query", "status", "note", (F.col("pos") + 1).alias("rank"), "r.title", "r.url", web_snippet(F.col("r.content")).alias("snippet"), "r.engine")


def cached(cache: DataFrame, key: str, now: float, ttl: float = TTL) -> DataFrame:
    return cache.where((F.col("key") == key) & (F.lit(now) - F.col("fetched") <= ttl))


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the latest of each key."""
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("fetched")))
    return cache.unionByName(new).withColumn("_n", latest).where("_n = 1").drop("_n")


def waits(calls: DataFrame, *by: str) -> DataFrame:
    """calls (…, at in seconds) with the seconds that each must wait after the one before."""
    before = F.lag("at").over(Window.partitionBy(*by).orderBy("at"))
    return calls.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), INTERVAL - (F.col("at") - before)), F.lit(0.0)))


def key_of(query: str, parameters: dict) -> str:
    return hashlib.sha256(" ".join(query.lower().split()).encode() + b"\0" + json.dumps(parameters, sort_keys=True).encode()).hexdigest()


class OwnTurns:
    """Calls of one process, interval seconds apart."""

    def __init__(self):
        self.last = float("-inf")

    @contextmanager
    def __call__(self, interval: float, clock: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[float]:
        if (wait := interval - (clock() - self.last)) > 0:
            sleep(wait)
        self.last = clock()
        yield self.last


class Lookup:
    """refused, then cached, then fetched, throttled or skipped: privacy comes before the cache, the cache before the network.

    cache and turns are those of this process, unless shared ones are given (lease.Answers, lease.Turns). A call that gets no turn is skipped, one that
    fails is throttled; neither is kept.
    """

    def __init__(self, fetch: Callable[[str], dict], private: Callable[[str], str], clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, cache=None, turns=None):
        self.fetch, self.private, self.clock, self.sleep = fetch, private, clock, sleep
        self.cache = {} if cache is None else cache
        self.turns = OwnTurns() if turns is None else turns

    def __call__(self, query: str, parameters: dict | None = None, allowed: bool = True) -> dict:
        if why := self.private(query):
            return {"status": "refused", "note": why, "cached": False, "results": []}
        key, now = key_of(query, parameters or {}), self.clock()
        if (kept := self.cache.get(key)) and now - kept[0] <= TTL:
            return kept[1] | {"cached": True}
        if not allowed:
            return {"status": "skipped", "note": "web search is off", "cached": False, "results": []}
        try:
            with self.turns(INTERVAL, self.clock, self.sleep) as at:
                try:
                    payload = self.fetch(query)
                except OSError as e:
                    return {"status": "throttled", "note": f"request failed: {e}", "cached": False, "results": []}
        except TimeoutError as e:
            return {"status": "skipped", "note": f"no turn: {e}", "cached": False, "results": []}
        results = payload.get("results") or []
        note = "" if results else "; ".join(": ".join(e) for e in payload.get("unresponsive_engines") or [])
        out = {"status": "ok" if results else "throttled", "note": note, "cached": False, "results": results}
        if results:
            self.cache[key] = (at, out)
        return out


def private_reason(query: str) -> str:
    """The driver's twin of the column predicate, for one query."""
    from marlspike.functions.predicates import PRIVATE

    return next((why for p, why in PRIVATE if re.search(re.sub(r"\(\?iu\)", "(?i)", p), query)), "")
