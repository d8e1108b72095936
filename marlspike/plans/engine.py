"""The engine as one object: search, get, stats, audit and ingest, described by one table of operations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators import aggregates, evidence, retrieval
from marlspike.operators.store import Snapshot, Store, complete

#: Operations: method, path, parameters with their types, whether a tool of that name is listed.
OPS = {
    "health": ("GET", "/health", {}, False),
    "search": ("GET", "/search", {"q": "string", "limit": "integer", "root": "string", "repo": "string", "as_of": "string", "sort": "string", "hop": "integer"}, True),
    "get": ("GET", "/get", {"id": "string"}, True),
    "stats": ("GET", "/stats", {}, False),
    "audit": ("GET", "/audit", {}, True),
    "ingest": ("POST", "/ingest", {"leafs": "array"}, False),
}
LIMITS = (1, 100)
#: Steps of a hop: the edge table, the table of the nodes that it leads to, their label.
STEPS = (("leaf_file", "files", "File"), ("file_commit", "commits", "Commit"), ("commit_person", "persons", "Person"))
SHOWN = ("id", "text", "root", "confidence", "source", "score", "snippet", "valid_from", "valid_to")


def check(q: str, n: int, root: str = "", as_of: str = "", sort: str = "", hop: int = 0) -> None:
    """Raises ValueError for what a search can't mean."""
    if not q.strip():
        raise ValueError("a query is needed")
    if not LIMITS[0] <= n <= LIMITS[1]:
        raise ValueError("limit must be within 1 and 100")
    if root not in ("", "facts", "info"):
        raise ValueError("root must be facts or info")
    if as_of and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", as_of):
        raise ValueError("as_of must be YYYY-MM-DD")
    if sort not in ("", "asc", "desc"):
        raise ValueError("sort must be asc or desc")
    if not 0 <= hop <= 3:
        raise ValueError("hop must be within 0 and 3")


class Engine:
    """embed: text to vector, or None for word search alone. lookup: a second source, asked when hits hold no confirmed fact."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[str], list[float]] | None = None, lookup: Callable[[str], dict] | None = None):
        self.spark, self.store, self.embed, self.lookup = spark, Store(spark, path), embed, lookup

    def search(self, q: str, limit: int = 10, root: str = "", repo: str = "", as_of: str = "", sort: str = "", web: bool = True, hop: int = 0) -> dict:
        """The best hits by words and vectors, all of one version; both come from the store's index once build_index() was called. hop: steps along stored edges."""
        check(q, limit, root, as_of, sort, hop)
        try:
            vector = self.embed(q) if self.embed else None
        except Exception:  # noqa: BLE001  vectors are optional, words aren't
            vector = None
        now = self.store.snapshot()
        near = now.near(vector) if vector else None
        hits = retrieval.hybrid(now.read(), q, vector, limit, now.words(), near, root=root, repo=repo, as_of=as_of, sort=sort).select(*SHOWN)
        rows = hits.collect()  # limit rows
        found = self.spark.createDataFrame(rows, hits.schema)
        reached = self.hops(found, hop, now)
        second = evidence.deduce(found, (lambda: self.lookup(q)) if self.lookup else None, root, not web)
        return {"query": q, "hits": [r.asDict() | ({"hops": reached.get(r["id"], [])} if hop else {}) for r in rows], "second_source": second}

    def hops(self, hits: DataFrame, depth: int, now: Snapshot | None = None) -> dict[str, list[dict]]:
        """id to what is reached within depth steps, by one batched join a step; steps whose tables aren't stored end the way."""
        edges, now = [], now or self.store.snapshot()
        for edge, nodes, label in STEPS[:depth]:
            e, n = now.table(edge), now.table(nodes)
            if e is None or n is None:
                break
            named = next(c for c in ("path", "subject", "name", "id") if c in n.columns)
            edges.append((e, n.select("id", F.col(named).alias("name")), label))
        if not edges:
            return {}
        done = retrieval.attach_hops(hits.select("id"), retrieval.hops(hits, edges, depth))
        return {r["id"]: [h.asDict() for h in r["hops"]] for r in done.collect()}

    def build_index(self) -> int:
        """Postings and vector lists of what has none yet; batches bring theirs from then on."""
        return self.store.index()

    def get(self, key: str) -> dict | None:
        row = self.store.read().drop("embedding").where(F.col("id") == key).first()
        return row.asDict() if row else None

    def stats(self) -> dict:
        return {r["root"] or "total": r["n"] for r in aggregates.stats(self.store.read()).collect()}

    def audit(self) -> list[dict]:
        return [r.asDict() for r in aggregates.audit_counts(self.store.read()).orderBy("root", "confidence").collect()]

    def ingest(self, leafs: DataFrame | list[dict], now: str) -> dict:
        """The new version; for a list also its leafs' ids, in its order. Of two leafs with one id the later stays."""
        from marlspike.sources.corpus import LEAF_INPUT, leafs_of_json

        if not isinstance(leafs, DataFrame):
            if any(not str(x.get("text") or "").strip() or not str(x.get("source") or "").strip() for x in leafs):
                raise ValueError("a leaf needs text and source")
            rows = self.spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(leafs)], "seq int, value string")
            new = leafs_of_json(rows, more=("seq",)) if leafs else self.spark.createDataFrame([], LEAF_INPUT + ", seq int")
            ids = [r["id"] for r in complete(new, now, "seq").orderBy("seq").select("id").collect()]
            return {"version": self.store.add(new, now, "seq"), "ids": ids}
        return {"version": self.store.add(leafs, now)}

    def call(self, name: str, arguments: dict) -> object:
        """A tool call by name; unlisted operations are served too."""
        if name not in OPS or name == "health":
            raise ValueError(f"no operation {name}")
        return getattr(self, name)(**arguments)


def tools() -> list[dict]:
    return [{"name": k, "inputSchema": {"type": "object", "properties": {p: {"type": t} for p, t in v[2].items()}}} for k, v in OPS.items() if v[3]]


def openapi() -> dict:
    paths: dict = {}
    for k, (method, path, parameters, _) in OPS.items():
        paths.setdefault(path, {})[method.lower()] = {"operationId": k, "parameters": [{"name": p, "in": "query", "schema": {"type": t}} for p, t in parameters.items()]}
    return {"openapi": "3.0.0", "info": {"title": "marlspike", "version": "1"}, "paths": paths}


def dispatch(engine: Engine, request: dict) -> dict:
    """JSON-RPC: initialize, tools/list, tools/call."""
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    try:
        if method == "initialize":
            return reply | {"result": {"serverInfo": {"name": "marlspike"}, "capabilities": {"tools": {}}}}
        if method == "tools/list":
            return reply | {"result": {"tools": tools()}}
        if method == "tools/call":
            out = engine.call(params["name"], params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out, default=str)}]}}
    except (ValueError, TypeError, KeyError) as e:
        return reply | {"error": {"code": -32602, "message": str(e)}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
