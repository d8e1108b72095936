"""Read-only queries of other databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.predicates import read_only


def query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """The result of one reading statement; anything else is refused before it is sent."""
    row = spark.range(1).select(F.lit(sql).alias("q")).select(read_only(F.col("q")).alias("ok")).first()
    if not row["ok"]:
        raise ValueError("only a single reading statement is allowed")
    return spark.read.format("jdbc").options(url=url, query=sql.rstrip().rstrip(";"), **options).load()


def sample(spark: SparkSession, url: str, table: str, n: int = 10, **options: str) -> DataFrame:
    return query(spark, url, f"SELECT * FROM {name(table)} LIMIT {int(n)}", **options)


def columns(spark: SparkSession, url: str, table: str, **options: str) -> list[str]:
    return query(spark, url, f"SELECT * FROM {name(table)} WHERE 1 = 0", **options).columns


def name(table: str) -> str:
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", table):
        raise ValueError(f"not a table's name: {table}")
    return table
