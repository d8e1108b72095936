"""Aggregates: leaf statistics, quantiles, latency reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(leafs: DataFrame, *by: str) -> DataFrame:
    """root (or by), n, and the totals as rows with nulls."""
    return leafs.rollup(*(by or ("root",))).agg(F.count("*").alias("n"))


def audit_counts(leafs: DataFrame) -> DataFrame:
    return leafs.groupBy("root", "confidence").agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min, p50, p95, max, avg with continuous quantiles."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"), F.avg(v).alias("avg"))


def at_index(df: DataFrame, value: str, by: list[str], places: dict[str, str]) -> DataFrame:
    """Percentiles read at an index of the sorted values. places: name to an expression of n, the 0-based index.

    Values are ranked within a group by a window, so that no task gathers a group's values in an array.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("n", F.count("*").over(w))
    picks = [F.max(F.when(F.col("_i") == F.expr(e), F.col(value))).alias(k) for k, e in places.items()]
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("min"), *picks, F.max(value).alias("max"), F.avg(value).alias("avg"))


#: Fixed index formulas of the two harnesses, and of the upper median.
SYSTEM = {"p50": "int(n / 2)", "p95": "int(n * 0.95)"}
STRESS = {"p50": "int((n - 1) * 0.5)", "p95": "int((n - 1) * 0.95)", "p99": "int((n - 1) * 0.99)"}
UPPER_MEDIAN = {"median": "int(n / 2)"}


def endpoint_report(calls: DataFrame, seconds: float) -> DataFrame:
    """calls (endpoint, ok) by endpoint: n, ok, errors, err_pct to one place, per_second."""
    ok = F.count_if("ok")
    n = F.count("*")
    return calls.groupBy("endpoint").agg(n.alias("n"), ok.alias("n_ok"), (n - ok).alias("errors"), F.round((n - ok) * 100.0 / n, 1).alias("err_pct"), F.round(n / seconds, 3).alias("per_second"))


def gates(report: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: each condition over all rows, and all of them together."""
    row = report.agg(*[F.bool_and(c).alias(k) for k, c in conditions.items()])
    together = F.lit(True)
    for k in conditions:
        together = together & F.col(k)
    return row.withColumn("all_pass", together)


def recall_at(hits: DataFrame, questions: DataFrame, least: float = 0.95) -> DataFrame:
    """hits (qid, text) of the best few, questions (qid, fragment): n, recall to three places, pass."""
    found = questions.join(hits, "qid", "left").groupBy("qid").agg(F.max(F.coalesce(F.contains(F.lower("text"), F.lower("fragment")), F.lit(False)).cast("int")).alias("hit"))
    return found.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 3).alias("recall")).withColumn("pass", F.col("recall") >= least)


def semver_bump(subjects: DataFrame, *by: str) -> DataFrame:
    """bump of commit subjects: major for a breaking one, else minor for a feature, else patch."""
    s = F.col("subject")
    breaking = F.lower(s).rlike("breaking[ -]change") | F.contains(F.split_part(s, F.lit(":"), F.lit(1)), F.lit("!"))
    return subjects.groupBy(*by).agg(F.when(F.count("*") == 0, "none").when(F.bool_or(breaking), "major").when(F.bool_or(s.startswith("feat:")), "minor").otherwise("patch").alias("bump"))


def next_version(current: Column, bump: Column) -> Column:
    part = lambda i: F.coalesce(F.try_element_at(F.split(F.regexp_replace(current, "^v", ""), r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    version = lambda *p: F.concat(F.lit("v"), F.concat_ws(".", *[x.cast("string") for x in p]))
    z = F.lit(0)
    return F.when(bump == "major", version(part(1) + 1, z, z)).when(bump == "minor", version(part(1), part(2) + 1, z)).when(bump == "patch", version(part(1), part(2), part(3) + 1))
