"""Commit history as a table and as leafs."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import first_line, or_else, text

COMMITS = "id string, repo string, author string, email string, date string, message string, n_parents int, files array<string>"


def repo_name(origin: Column, folder: Column) -> Column:
    """owner/name of the origin, else the folder's name."""
    found = F.regexp_extract(F.regexp_replace(text(origin), r"\.git/*$", ""), r"([^/:]+/[^/:]+)$", 1)
    return or_else(found, F.element_at(F.split(F.regexp_replace(folder, "/+$", ""), "/"), -1))


def read_log(path: str, repo: str = "") -> list[tuple]:
    """Commits of one repository with the files that each changed against its first parent."""
    git = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True, check=True).stdout
    out = []
    for record in git("log", "--format=%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cI%x1f%B%x1f", "--name-only", "--root", "-m", "--first-parent").split("\x1e")[1:]:
        sha, parents, author, mail, date, message, names = record.split("\x1f")
        out.append((sha, repo or os.path.basename(os.path.abspath(path)), author, mail, date, message, len(parents.split()), sorted(x for x in names.split("\n") if x)))
    return out


def commits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Commits of several repositories; each is read by one task where it can be reached by all executors."""
    repos = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def read(batches):
        import pandas as pd

        for b in batches:
            for p in b["path"]:
                rows = read_log(p)
                if rows:
                    yield pd.DataFrame(rows, columns=["id", "repo", "author", "email", "date", "message", "n_parents", "files"])

    return repos.mapInPandas(read, COMMITS)


def log(rows: DataFrame, since: str = "", limit: int = 0) -> DataFrame:
    """Newest first, without merges."""
    rows = rows.where(F.col("n_parents") <= 1)
    if since:
        rows = rows.where(F.to_timestamp("date") >= F.to_timestamp(F.lit(since)))
    rows = rows.orderBy(F.to_timestamp("date").desc(), "id")
    return rows.limit(limit) if limit > 0 else rows


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash differs between two trees (path, hash), sorted."""
    b = before.select("path", F.col("hash").alias("old"))
    return b.join(after.select("path", F.col("hash").alias("new")), "path", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("path").orderBy("path")


def as_leafs(rows: DataFrame) -> DataFrame:
    """Info leafs: id, repository and subject, author, date and files; known by repository and whole id."""
    short = F.substring("id", 1, 12)
    head = F.concat(F.lit("commit "), short, F.lit(" in "), F.col("repo"), F.lit(" — "), first_line(F.col("message")))
    files = F.when(F.coalesce(F.size("files"), F.lit(0)) > 0, F.concat(F.lit("Changing: "), F.array_join("files", ", ")))
    lines = F.concat_ws("\n", head, F.concat(F.lit("Author: "), F.col("author"), F.lit(" <"), F.col("email"), F.lit(">")), F.concat(F.lit("Date: "), F.col("date")), files)
    return rows.select(
        lines.alias("text"), F.concat("repo", F.lit("@"), "id").alias("source"), F.col("id").alias("source_rev"),
        F.lit("info").alias("root"), F.lit("commit").alias("type"), F.lit("import-git").alias("how"), F.substring("date", 1, 10).alias("valid_from"),
    )
