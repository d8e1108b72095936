"""Hybrid retrieval: BM25 and cosine rankings, reciprocal rank fusion, filters, order and hops."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.predicates import active_at
from marlspike.functions.text import text
from marlspike.operators.blocks import block_rows, block_schema, small
from marlspike.session import hadoop, written

if TYPE_CHECKING:
    from marlspike.operators.segments import SegmentWords

#: BM25 saturation and length weight, and the constant of reciprocal ranks.
K1, B, RRF = 1.2, 0.75, 60
#: Rows that each ranking passes on for one that is asked for.
OVERFETCH = 3


def tokens(body: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text(body)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms_of(query: str) -> list[str]:
    import re

    return sorted({w for w in re.findall(r"[^\W_]+", query.lower())})


def bm25(leafs: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """id and score of leafs (id, text) that hold a term of the query; the best k by (score desc, id) if k is given.

    One pass without a shuffle of texts: each row counts the few query terms in its own token array; only the sums over all rows (documents,
    mean length, documents with each term) are aggregated, to one row.
    """
    words = terms_of(query)
    if not words:
        return leafs.select("id", F.lit(0.0).alias("score")).where("false")
    counted = leafs.select("id", tokens(F.col("text")).alias("t")).select(
        "id", F.size("t").alias("len"), *[F.size(F.filter("t", _is(w))).alias(f"f{i}") for i, w in enumerate(words)]
    )
    sums = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(words))])
    scored = counted.where(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in range(len(words))])).crossJoin(F.broadcast(sums))
    score = reduce(lambda a, b: a + b, [_term(F.col(f"f{i}"), F.col(f"d{i}")) for i in range(len(words))])
    return best(scored.select("id", score.alias("score")), k)


def _is(word: str):
    return lambda x: x == word


def _term(f: Column, df: Column) -> Column:
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)


def best(scored: DataFrame, k: int | None) -> DataFrame:
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def cosine(vectors: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """id and cosine similarity to the query of vectors (id, embedding); a zero vector has 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    e = F.col("embedding").cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(e, e)) * float(sum(x * x for x in query) ** 0.5)
    return best(vectors.select("id", F.when(norm > 0, dot(e, q) / norm).otherwise(0.0).alias("score")), k)


def ranked(scored: DataFrame, *by: str) -> DataFrame:
    """1-based rank by (score desc, id), within the columns by; without them scored must be cut already."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def fuse(words: DataFrame, vectors: DataFrame, *by: str) -> DataFrame:
    """(by, id, score, rrf) of two rankings (by, id, score): rrf is the sum of 1 / (RRF + rank), score the word score unless 0, else the vector's."""
    a = ranked(words, *by).select(*by, "id", F.lit(0).alias("branch"), "score", "rank")
    b = ranked(vectors, *by).select(*by, "id", F.lit(1).alias("branch"), "score", "rank")
    shown = F.coalesce(F.max(F.when((F.col("branch") == 0) & (F.col("score") != 0), F.col("score"))), F.max(F.when(F.col("branch") == 1, F.col("score"))), F.max("score"))
    both = a.unionByName(b).groupBy(*by, "id").agg(shown.alias("score"), F.sum(1.0 / (RRF + F.col("rank"))).alias("rrf"))
    return both


def select_hits(hits: DataFrame, n: int = 0, root: str = "", repo: str = "", as_of: str = "", sort: str = "") -> DataFrame:
    """Root, repo (substring of source) and as-of filters, then order (rrf desc, id; or day, undated last), then the limit; n <= 0: all."""
    if root:
        hits = hits.where(F.col("root") == root)
    if repo:
        hits = hits.where(F.contains("source", F.lit(repo)))
    if as_of:
        hits = hits.where(active_at(F.col("valid_from"), F.col("valid_to"), as_of))
    order = [F.desc("rrf"), F.asc("id")]
    if sort:
        day = F.col("valid_from")
        order = [text(day) == "", day.asc() if sort == "asc" else day.desc(), *order]
    hits = hits.orderBy(*order)
    return hits.limit(n) if n > 0 else hits


def hybrid(leafs: DataFrame, query: str, vector: list[float] | None, n: int = 20, index: WordIndex | SegmentWords | None = None, vectors: DataFrame | None = None, **filters: str) -> DataFrame:
    """Hits of leafs (id, text, root, confidence, source, valid_from, valid_to, embedding) with score, rrf and snippet.

    Words are looked up in a stored index, or counted in the texts where there is none; vectors: (id, embedding) where they aren't the leafs' own.
    Both rankings are cut at OVERFETCH x n before they are fused, and filters apply to what is left, as they do in retrieval stores; the
    fused candidates are few, so the join back to the leafs is a broadcast of at most 2 x OVERFETCH x n rows.
    """
    cut = OVERFETCH * max(n, 1)
    words = index.search(query, cut) if index else bm25(leafs, query, cut)
    vectors = vectors if vectors is not None or "embedding" not in leafs.columns else leafs.where("embedding is not null")
    near = cosine(vectors, vector, cut) if vector and vectors is not None else words.where("false")
    hits = leafs.drop("embedding").join(F.broadcast(fuse(words, near)), "id")
    return select_hits(hits, n, **filters).withColumn("snippet", F.substring("text", 1, 280))


def postings_of(leafs: DataFrame, *by: str) -> DataFrame:
    """(by, term, id, tf, len) of leafs (by, id, text)."""
    t = leafs.select(*by, "id", tokens(F.col("text")).alias("t"))
    return t.select(*by, "id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(*by, "term", "id", "len").agg(F.count("*").alias("tf"))


def sums_of(leafs: DataFrame, *by: str) -> DataFrame:
    """(by, n, tokens): leafs and their tokens, what idf and the mean length come from."""
    return leafs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(F.col("text")))), F.lit(0)).cast("long").alias("tokens"))


#: Queries that meet the blocks of an index at once.
TOGETHER = 128


class WordIndex:
    """Stored blocks of postings (blocks.block_rows) with the number of leafs and of their tokens."""

    def __init__(self, spark: SparkSession, paths: list[str], n: int, tokens: int, id_type: str = "string"):
        self.n, self.mean, self.id_type = n, tokens / n if n else 1.0, id_type
        self.blocks = spark.read.schema(block_schema(id_type)).parquet(*paths) if paths else spark.createDataFrame([], block_schema(id_type))

    def search(self, query: str, k: int | None = None) -> DataFrame:
        """id and score as bm25() has them, by the postings of the query's terms alone."""
        asked = self.blocks.where(F.col("term").isin(terms_of(query)))
        p = asked.join(F.broadcast(asked.groupBy("term").agg(F.sum("n").alias("df"))), "term").select("df", F.inline("postings"))
        met = p.withColumn("n", F.lit(self.n)).withColumn("avg", F.lit(self.mean)).withColumn("score", _term(F.col("tf"), F.col("df")))
        # sums in any order: without rounding, equal texts would differ in their last bits and not tie
        return best(met.groupBy("id").agg(F.round(F.sum("score"), 9).alias("score")), k)

    def batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank) of the best k leafs for each of queries (qid, query).

        Queries meet the index in sets of some TOGETHER: of a block and a set, the scores of all leafs for all queries are one product of matrices, of which the
        best k of each query are kept. So no row is made for a posting and a query, and what is shuffled grows with the postings of the terms asked.
        """
        sets = -(-queries.count() // TOGETHER) or 1
        asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"), F.pmod(F.xxhash64("qid"), F.lit(sets)).alias("set"))
        df = self.blocks.select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        weight = F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
        terms = written(asked.groupBy("set", "term").agg(F.collect_list("qid").alias("qids")).join(df, "term").select("set", "term", "qids", weight.alias("weight")), "asked")
        met = self.blocks.select("term", "block", "postings").join(small(terms, terms.count()), "term")
        qid, mean = queries.schema["qid"].dataType.simpleString(), self.mean

        def score(met: pa.Table) -> pa.Table:
            lists, asked, weight = met.column("postings").combine_chunks(), met.column("qids").combine_chunks(), met.column("weight").to_numpy()
            ids, tf, size = lists.flatten().flatten()
            leafs, qids = ids.dictionary_encode(), asked.flatten().dictionary_encode()
            term, f = np.repeat(np.arange(len(met)), pc.list_value_length(lists).to_numpy()), tf.to_numpy().astype(np.float64)
            held = np.zeros((len(leafs.dictionary), len(met)))
            held[leafs.indices.to_numpy(), term] = weight[term] * f / (f + K1 * (1 - B + B * size.to_numpy() / mean))
            wanted = np.zeros((len(met), len(qids.dictionary)))
            wanted[np.repeat(np.arange(len(met)), pc.list_value_length(asked).to_numpy()), qids.indices.to_numpy()] = 1
            scores = np.round(held @ wanted, 9)
            order = np.empty(len(held), np.int64)
            order[pc.sort_indices(leafs.dictionary).to_numpy()] = np.arange(len(held))
            some, least = min(k, len(held)), np.partition(scores, -min(k, len(held)), axis=0)[-min(k, len(held))]
            found = []
            for q in range(scores.shape[1]):
                at = np.flatnonzero((scores[:, q] >= least[q]) & (scores[:, q] > 0))
                found.append(at[np.lexsort((order[at], -scores[at, q]))[:some]])
            leaf, query = np.concatenate(found), np.repeat(np.arange(len(found)), [*map(len, found)])
            return pa.table({"qid": qids.dictionary.take(pa.array(query)), "id": leafs.dictionary.take(pa.array(leaf)), "score": pa.array(scores[leaf, query])})

        scored = met.groupBy("set", "block").applyInArrow(score, f"qid {qid}, id {self.id_type}, score double")
        return ranked(scored, "qid").where(F.col("rank") <= k)


def index_of(leafs: DataFrame, path: str) -> WordIndex:
    """The index of leafs (id, text) at path, written first where it isn't there; a write that fails leaves no sums, and so no index."""
    spark, sums = leafs.sparkSession, f"{path}/sums"
    at, fs = hadoop(spark, f"{sums}/_SUCCESS")
    if not fs.exists(at):
        fs.delete(hadoop(spark, path)[0], True)
        block_rows(leafs.select("id", tokens(F.col("text")).alias("t"))).write.parquet(f"{path}/postings")
        held = spark.read.schema("total long").parquet(f"{path}/postings").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"))
        leafs.agg(F.count("*").alias("n")).crossJoin(held).write.parquet(sums)
    n, total = spark.read.parquet(sums).select("n", "tokens").first()
    return WordIndex(spark, [f"{path}/postings"], n, total, leafs.schema["id"].dataType.simpleString())


def hops(hits: DataFrame, edges: list[tuple[DataFrame, DataFrame, str]], depth: int) -> DataFrame:
    """(id, node, name, label, depth) reached from hits (id) along edges: a list of (edges (src, dst), nodes (id, name), label), one a step.

    One batched join a step for all hits, instead of a query for each hit and depth.
    """
    at, out = hits.select("id", F.col("id").alias("at")), None
    for d, (edge, nodes, label) in enumerate(edges[:depth], 1):
        at = at.join(edge, F.col("at") == F.col("src")).select("id", F.col("dst").alias("at")).distinct()
        here = at.join(nodes.select(F.col("id").alias("at"), "name"), "at").select("id", F.col("at").alias("node"), "name", F.lit(label).alias("label"), F.lit(d).alias("depth"))
        out = here if out is None else out.unionByName(here)
    return out


def attach_hops(hits: DataFrame, reached: DataFrame) -> DataFrame:
    """hits with hops: array<struct<id, label, name, depth>> in order of depth and id, empty where none is."""
    one = F.struct(F.col("node").alias("id"), "label", "name", "depth")
    listed = reached.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "node", one.alias("hop")))).alias("h"))
    return hits.join(listed, "id", "left").withColumn("hops", F.coalesce(F.transform("h", lambda x: x["hop"]), F.array())).drop("h")
