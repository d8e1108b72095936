"""What a store keeps beside a segment of leafs: blocks of postings with their maxima, and lists of near vectors. Neither changes once written."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators.blocks import BLOCK, block_rows, block_schema, small
from marlspike.operators.retrieval import K1, B, best, postings_of, terms_of, tokens

#: Postings of the asked terms up to which they are all read; beyond, blocks that can't reach the best k are skipped.
READ_ALL = 200_000
BLOCKS = block_schema()


def write_blocks(leafs: DataFrame, path: str) -> int:
    """Postings of leafs (id, text) in rows of (term, block); returns how many tokens they hold."""
    block_rows(leafs.select("id", tokens(F.col("text")).alias("t")), BLOCK).write.parquet(path)
    return leafs.sparkSession.read.schema("total long").parquet(path).agg(F.sum("total")).first()[0] or 0


class SegmentWords:
    """Words of segments: [(key, path of blocks)], dead: (segment, id, len, terms; leafs of segments that are no more) or None, n leafs and their tokens,
    loose: (id, text) of leafs that aren't indexed."""

    def __init__(self, spark: SparkSession, paths: list[tuple[str, str]], dead: DataFrame | None, dead_rows: int, n: int, total: int, loose: DataFrame | None = None):
        self.n, self.mean, self.dead, self.dead_rows, self.loose = n, total / n if n else 1.0, dead, dead_rows, loose
        stored = [spark.read.schema(BLOCKS).parquet(p).withColumn("segment", F.lit(key)) for key, p in paths]
        self.blocks = reduce(DataFrame.unionByName, stored) if stored else spark.createDataFrame([], BLOCKS + ", segment string")
        self.blocks_read: DataFrame | None = None

    def counts(self, words: list[str]) -> tuple[dict[str, int], int]:
        """Leafs that hold each word, and the postings stored for them."""
        held = self.blocks.where(F.col("term").isin(words)).groupBy("term").agg(F.sum("n").alias("n"))
        df = {r["term"]: r["n"] for r in held.collect()}  # a row for each word asked
        stored = sum(df.values())
        for rows, sign in ((self.dead, -1), (self.loose, 1)):
            if rows is not None:
                terms = F.col("terms") if sign < 0 else F.array_distinct(tokens(F.col("text")))
                lost = rows.select(F.explode(F.array_intersect(terms, F.array(*map(F.lit, words)))).alias("term")).groupBy("term").count()
                for r in lost.collect():
                    df[r["term"]] = df.get(r["term"], 0) + sign * r["count"]
        return df, stored

    def _score(self, df: dict[str, int], tf: Column, size: Column) -> Column:
        idf = F.create_map(*[F.lit(x) for w, k in df.items() for x in (w, math.log(1 + (self.n - k + 0.5) / (k + 0.5)))])
        return F.element_at(idf, F.col("term")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def _scored(self, rows: DataFrame, df: dict[str, int], loose: bool) -> DataFrame:
        """id and score of what is in rows (blocks), without dead leafs, and of loose leafs."""
        met = rows.select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.*")
        if self.dead is not None:
            met = met.join(small(self.dead.select("segment", "id"), self.dead_rows), ["segment", "id"], "left_anti")
        met = met.select("term", "id", "tf", "len")
        if loose and self.loose is not None:
            met = met.unionByName(postings_of(self.loose).where(F.col("term").isin([*df])).select("term", "id", "tf", "len"))
        return met.groupBy("id").agg(F.round(F.sum(self._score(df, F.col("tf"), F.col("len"))), 9).alias("score"))

    def search(self, query: str, k: int | None = None) -> DataFrame:
        """id and score as bm25() has them. Of many postings, blocks of which all terms together can't reach the k-th best score are left out: that
        score is at least the k-th best among the leafs of the k blocks of the highest bounds."""
        words = terms_of(query)
        df, stored = self.counts(words) if words else ({}, 0)
        df = {w: x for w, x in df.items() if x > 0}
        asked = self.blocks.where(F.col("term").isin([*df]))
        if not df:
            return self.blocks.select(F.col("segment").alias("id"), F.lit(0.0).alias("score")).where("false")
        if k is not None and stored > READ_ALL:
            at = ["segment", "block"]
            bounds = asked.groupBy(*at).agg(F.sum(self._score(df, F.col("most"), F.col("least"))).alias("bound"))
            first = bounds.orderBy(F.desc("bound"), *at).limit(k).select(*at)
            reached = best(self._scored(asked.join(F.broadcast(first), at, "left_semi"), df, True), k).agg(F.count("*"), F.min("score")).first()
            if reached[0] == k:
                open_ = bounds.where(F.col("bound") >= reached[1] - 1e-6).select(*at)  # scores are rounded
                asked = asked.join(open_, at, "left_semi")
        self.blocks_read = asked
        return best(self._scored(asked, df, True), k)


#: Lists of a segment's vectors: as many as the root of their number, this many at most; vectors sampled for each list; share of lists that a search reads, and how many at least.
MOST_LISTS, SAMPLE, ROUNDS, SHARE, AT_LEAST = 1024, 64, 8, 0.25, 8


LISTS = "list int, direction array<double>, needed int"


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


#: Vectors of the sample that are searched for, how many of the nearest, and the share of these that lists must hold between them.
PROBES, NEAREST, ENOUGH = 400, 10, 0.99


def lists_needed(m: np.ndarray, c: np.ndarray) -> int:
    """How many of the lists nearest to a query hold ENOUGH of its NEAREST others, over PROBES vectors of the sample m: vectors without clusters need nearly all.

    The sample is thinner than the whole, so its nearest lie farther away and in more lists: the number errs to the safe side.
    """
    if len(m) < 2 or not len(c):
        return len(c)
    asked = np.random.default_rng(1).permutation(len(m))[:PROBES]
    at, k, ranks = (m @ c.T).argmax(1), min(NEAREST, len(m) - 1), []
    for some in np.array_split(asked, math.ceil(len(asked) / 50)):
        dots = m[some] @ m.T
        dots[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-dots, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(m[some] @ c.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, at[near], 1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[math.ceil(ENOUGH * len(ranks)) - 1]) + 1


def centroids_of(vectors: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Directions of the lists, by k-means over a sample of SAMPLE vectors for each list, drawn by hash of the id, and how many of them a search needs; n: vectors."""
    lists = min(MOST_LISTS, math.isqrt(max(n, 1)))
    size = SAMPLE * lists
    sample = vectors if n <= size else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil((1 << 20) * 1.1 * size / n))
    drawn = [r["embedding"] for r in sample.select("embedding").limit(size).toLocalIterator()]
    widths = [len(x) for x in drawn]
    width = max(set(widths), key=widths.count) if widths else 0
    m = unit(np.array([x for x in drawn if len(x) == width and None not in x], np.float64).reshape(-1, width or 1))
    m = m[np.isfinite(m).all(1) & (m != 0).any(1)]
    c = m[np.random.default_rng(0).permutation(len(m))[:lists]]
    for _ in range(ROUNDS):
        at = (m @ c.T).argmax(1) if len(c) else np.zeros(0, int)
        c = unit(np.array([m[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))]).reshape(-1, m.shape[1]))
    return c, lists_needed(m, c)


def write_lists(vectors: DataFrame, path: str, n: int) -> None:
    """vectors (id, embedding) sorted by list, and the lists' directions beside them; vectors without a direction are in list -1."""
    spark, (c, needed) = vectors.sparkSession, centroids_of(vectors, n)
    shared = spark.sparkContext.broadcast(c)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for f in frames:
            fits = [len(c) > 0 and len(x) == c.shape[1] for x in f["embedding"]]
            at = np.full(len(f), -1)
            if any(fits):
                m = np.nan_to_num(np.array([*f["embedding"][fits]], np.float64))
                at[fits] = np.where((m != 0).any(1), (m @ c.T).argmax(1), -1)
            yield f.assign(list=at)

    rows = vectors.select("id", "embedding").mapInPandas(assign, "id string, embedding array<float>, list int")
    rows.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").write.parquet(f"{path}/vectors")
    spark.createDataFrame([(i, [*map(float, x)], needed) for i, x in enumerate(c)], LISTS).coalesce(1).write.parquet(f"{path}/lists")


def near_vectors(spark: SparkSession, path: str, query: list[float], share: float = SHARE) -> DataFrame:
    """(id, embedding) of the lists nearest to the query, and of those without a direction: the share of the lists, AT_LEAST of them at least, and as many as
    were measured to be needed when they were made (null where an older store didn't measure)."""
    lists = spark.read.schema(LISTS).parquet(f"{path}/lists").collect()  # MOST_LISTS at most
    dots = {r["list"]: sum(a * b for a, b in zip(r["direction"], query, strict=False)) for r in lists}
    chosen = sorted(dots, key=lambda i: -dots[i])[: max([AT_LEAST, math.ceil(share * len(dots)), *(r["needed"] or len(dots) for r in lists)])]
    return spark.read.schema("id string, embedding array<float>, list int").parquet(f"{path}/vectors").where(F.col("list").isin([-1, *chosen])).drop("list")
