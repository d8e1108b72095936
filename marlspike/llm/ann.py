"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import map_batches, materialize, prepare

#: Bounds of what the driver fits and every executor holds: lists, and numbers (rows x dimensions) of the sample.
MOST_LISTS, SAMPLE_NUMBERS = 8192, 1 << 23
#: Rows of a list as planned, rows of a list that one task scans at once, and queries that it scans for.
LIST_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 256, 1024, 256
#: Lists that a boundary vector is copied to at most, and how far (as a ratio to the nearest centroid's distance) they may lie.
COPIES, COPY_RATIO = 4, 1.15
#: Lists that a query considers, and how far they may lie; the nearest LEAST_LISTS are always searched.
BEAM, LEAST_LISTS, LIST_RATIO = 64, 12, 1.3


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Centroids of balanced clusters: Lloyd's rounds, then clusters beyond twice the mean are split again; copies can't be parted."""
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=len(centroids))
        filled = sizes > 0
        centroids[filled] = (sums[filled] / sizes[filled, None]).astype(x.dtype)
        centroids = centroids[filled]
    near = nearest(x, centroids)
    sizes, out = np.bincount(near, minlength=len(centroids)), []
    for c in range(len(centroids)):
        parts = int(sizes[c] // max(1, 2 * len(x) // k))
        own = x[near == c] if parts > 1 and len(centroids) + len(out) < 2 * k else None
        out.append(kmeans(own, parts, 3, seed + 1) if own is not None and len(np.unique(own, axis=0)) > parts else centroids[c : c + 1])
    return np.concatenate(out)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ c.T - half).argmax(1) for a in range(0, len(x), 4096)])


class Graph:
    """Centroids as a graph in memory: each has edges to its nearest and to a few others; a beam search walks it."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, far: int = 4, entries: int = 16):
        self.c, n = centroids.astype(np.float32), len(centroids)
        self.norms = (self.c**2).sum(1)
        rng = np.random.default_rng(3)
        near = []
        for a in range(0, n, 1024):
            d = self.norms[None, :] - 2 * self.c[a : a + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near.append(np.argsort(d, axis=1, kind="stable")[:, : min(degree, n - 1)])
        others = rng.integers(0, n, (n, far))
        self.edges = np.concatenate([np.concatenate(near), others], axis=1) if n > 1 else np.zeros((1, 1), np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(int))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of nearest centroids found for each row, and their squared distances; shorter beams end in infinite ones."""
        b, n = len(x), len(self.c)
        beam = min(beam, n)
        own, rows = (x * x).sum(1), np.arange(b)
        seen, opened = np.zeros((b, n), bool), np.zeros((b, n), bool)
        ids = np.tile(self.entries[:beam], (b, 1))
        seen[:, ids[0]] = True
        dist = own[:, None] + self.norms[ids] - 2 * np.einsum("bd,bmd->bm", x, self.c[ids])
        while True:
            closed = np.where(opened[rows[:, None], ids], np.inf, dist)
            step = np.argsort(closed, axis=1, kind="stable")[:, :2]
            pick = np.take_along_axis(ids, step, 1)
            live = np.isfinite(np.take_along_axis(closed, step, 1))
            if not live.any():
                break
            opened[rows[:, None], pick] |= live
            new = self.edges[pick].reshape(b, -1)
            d = own[:, None] + self.norms[new] - 2 * np.einsum("bd,bmd->bm", x, self.c[new])
            d[seen[rows[:, None], new] | ~np.repeat(live, self.edges.shape[1], axis=1)] = np.inf
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(d, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            d[twice] = np.inf
            seen[np.repeat(rows, new.shape[1])[np.isfinite(d).ravel()], new.ravel()[np.isfinite(d).ravel()]] = True
            ids, dist = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist = np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1)
        best = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, best, 1), np.maximum(np.take_along_axis(dist, best, 1), 0)


def lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Vectors with one more coordinate, all of norm 1, so that the nearest has the largest inner product."""
    x = x.astype(np.float64) / top
    n2 = (x * x).sum(1)
    if query:
        return np.concatenate([x / np.sqrt(n2)[:, None], np.zeros((len(x), 1))], 1).astype(np.float32)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - n2))[:, None]], 1).astype(np.float32)


def lists_of(graph: Graph, x: np.ndarray, copies: int, ratio: float) -> list[np.ndarray]:
    """Lists of each vector: the nearest, and others within the ratio that no chosen centroid is nearer to than the vector."""
    out = []
    for a in range(0, len(x), 512):
        ids, dist = graph.search(x[a : a + 512], 4 * copies)
        for row, d in zip(ids, dist, strict=True):
            chosen = [row[0]]
            for c, far in zip(row[1:], d[1:], strict=True):
                if len(chosen) == copies or far > ratio * ratio * d[0] or not np.isfinite(far):
                    break
                if all(((graph.c[c] - graph.c[k]) ** 2).sum() >= far for k in chosen):
                    chosen.append(c)
            out.append(np.array(chosen))
    return out


def probes_of(graph: Graph, x: np.ndarray, beam: int, least: int, ratio: float) -> list[np.ndarray]:
    out = []
    for a in range(0, len(x), 512):
        ids, dist = graph.search(x[a : a + 512], beam)
        out += [row[np.isfinite(d) & ((np.arange(len(row)) < least) | (d <= ratio * ratio * d[0]))] for row, d in zip(ids, dist, strict=True)]
    return out


def matrix(column) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    )


def best_rows(q_id: np.ndarray, q_x: np.ndarray, r_id: np.ndarray, r_x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the `top` rows of largest score, ties to the smaller id, without its own: places of queries and of rows, scores.

    A matrix product, whose last bits depend on its blocks, picks what comes near the last place; the reported product of each pair orders them.
    """
    own = q_id[:, None] == r_id[None, :]
    with np.errstate(invalid="ignore", over="ignore"):
        rough = q_x @ r_x.T
        k = min(top, rough.shape[1])
        last = -np.partition(np.where(own, np.inf, -rough), k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * np.linalg.norm(q_x, axis=1) * np.linalg.norm(r_x, axis=1).max()
        at, row = np.nonzero(~own & ~(rough < np.where(np.isfinite(last), last - slack, last)[:, None]))
        exact = np.einsum("nd,nd->n", q_x[at], r_x[row])
    order = np.lexsort((r_id[row], -exact, at))
    at, row, exact = at[order], row[order], exact[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < top], row[place < top], exact[place < top]


OUT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by `every`, the `top` largest inner products found among other rows.

    Vectors null, zero, with null or non-finite components or a null vec_id take no part, nor do those whose length isn't the most
    common one (the longer on ties). Centroids are fitted on a sample of at most SAMPLE_NUMBERS numbers; every vector is indexed.
    Lists longer than BLOCK_ROWS are scanned in blocks, queries of a list in blocks of BLOCK_QUERIES, and each pair of blocks is dealt by itself, so
    that neither a common vector nor a common query fills a task. Scores are double inner products of the original vectors; ties go to the smaller vec_id. A
    vec_id that several rows share counts once, by its largest score, as a candidate; as a query each of its rows asks and the best
    answers are returned once. An empty table gives no rows; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors).withColumn("size", F.size("embedding"))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v))
    facts = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(length).alias("longest")).orderBy(F.desc("n"), F.desc("size")).first()
    if facts is None:
        return spark.createDataFrame([], OUT)
    dims, n, longest = facts
    rows = rows.where(F.col("size") == dims).select("vec_id", "embedding")
    k = int(min(MOST_LISTS, max(1, n // LIST_ROWS)))
    share = min(1.0, min(64 * k, SAMPLE_NUMBERS // dims) / n)
    u = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("vec_id", "embedding", u.alias("u")).where(F.col("u") <= share).orderBy("u", "vec_id").limit(SAMPLE_NUMBERS // dims).select("embedding").toArrow()
    sample = matrix(drawn["embedding"].combine_chunks()) if drawn.num_rows else np.ones((1, dims))
    shared = spark.sparkContext.broadcast((Graph(kmeans(lifted(sample, longest, query=False), k)), longest))

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        graph, top_norm = shared.value
        for b in batches:
            lists = lists_of(graph, lifted(matrix(b["embedding"]), top_norm, query=False), COPIES, COPY_RATIO)
            yield spread(b, lists)

    def ask(batches: Iterator[dict]) -> Iterator[dict]:
        graph, top_norm = shared.value
        for b in batches:
            yield spread(b, probes_of(graph, lifted(matrix(b["embedding"]), top_norm, query=True), BEAM, LEAST_LISTS, LIST_RATIO))

    def spread(b: dict, lists: list[np.ndarray]) -> dict:
        at = np.repeat(np.arange(len(lists)), [*map(len, lists)])
        return {"list": np.concatenate(lists), "vec_id": b["vec_id"].take(at), "embedding": b["embedding"].take(at)}

    schema = "list int, vec_id long, embedding array<double>"
    index = materialize(map_batches(rows, place, schema), "lists")
    asked = materialize(map_batches(rows.where(F.col("vec_id") % every == 0), ask, schema), "probes")

    def parts(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}_parts"))

    # every pair of a part of a list's rows and a part of its queries is dealt by itself, so that a hot list is shared among tasks
    sizes = materialize(parts(index, BLOCK_ROWS, "rows").join(parts(asked, BLOCK_QUERIES, "queries"), "list"), "list-sizes")

    def dealt(df: DataFrame, name: str, other: str) -> DataFrame:
        """The vectors (name) of each part of each list, once for every part of the other side."""
        part = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.col(f"{name}_parts")).cast("int")
        held = df.join(F.broadcast(sizes), "list")  # a row for each list: MOST_LISTS doubled at most
        held = held.groupBy("list", f"{other}_parts", part.alias(f"{name}_part")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias(name))
        return held.select("list", f"{name}_part", F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part"), name)

    pairs = dealt(index, "rows", "queries").join(dealt(asked, "queries", "rows"), ["list", "rows_part", "queries_part"]).select("rows", "queries")

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for r, q in zip(b["rows"], b["queries"], strict=True):
                r_id, r_x = unpack(r.values)
                q_id, q_x = unpack(q.values)
                at, row, exact = best_rows(q_id, q_x, r_id, r_x, top)
                yield {"query_id": q_id[at], "vec_id": r_id[row], "score": exact}

    def unpack(pairs) -> tuple[np.ndarray, np.ndarray]:
        return pairs.field("vec_id").to_numpy(), matrix(pairs.field("embedding"))

    found = map_batches(pairs, scan, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
