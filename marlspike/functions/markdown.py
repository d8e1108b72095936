"""Markdown as tables: front matter and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.text import or_else

FRONT = r"(?s)^---\s*\n(.*?)\n---"


def front_matter(content: Column) -> Column:
    """map<string, string> of 'key: value' lines between the opening and closing dashes, quotes off, the last of a key."""
    lines = F.filter(F.split(F.regexp_extract(content, FRONT, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"""^["']+|["']+$""", "")
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONT + r"[^\n]*\n?", "")


def sections(files: DataFrame) -> DataFrame:
    """Leafs (source, repo, heading, text, type, status, related) of files (path, repo, content).

    A section starts at each '## ' line, which stays in it; text before the first is dropped, as are blank lines. The title is the last
    '# ' line; it stands before the first section's text, or is the heading of the one section of a file without '## '.
    """
    meta = front_matter(F.col("content"))
    lines = F.transform(F.split(body(F.col("content")), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    f = files.select("path", "repo", meta.alias("meta"), lines.alias("lines"))
    title = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("lines", lambda x: x["line"].rlike(r"^# \S")), lambda x: F.trim(F.substring(x["line"], 3, 1 << 20)))), -1)
    f = f.withColumn("title", title).withColumn("has_h2", F.exists("lines", lambda x: x["line"].rlike(r"^## \S")))
    rows = f.select("path", "repo", "meta", "title", "has_h2", F.explode("lines").alias("x")).select("*", "x.pos", "x.line").drop("x")
    starts = F.sum(F.col("line").rlike(r"^## \S").cast("int")).over(Window.partitionBy("path", "repo").orderBy("pos"))
    rows = rows.withColumn("section", starts).where((F.trim("line") != "") & (~F.col("has_h2") | (F.col("section") > 0)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    s = rows.groupBy("path", "repo", "section").agg(F.first("meta").alias("meta"), F.first("title").alias("title"), F.first("has_h2").alias("has_h2"), text.alias("text"))
    heading = F.when(F.col("has_h2"), F.trim(F.regexp_extract("text", r"^## ([^\n]*)", 1))).otherwise(F.col("title"))
    first = (F.col("section") == 1) & (F.col("title") != "")
    get = lambda k, default: or_else(F.try_element_at("meta", F.lit(k)), default)
    return s.select(
        F.col("path").alias("source"), "repo", heading.alias("heading"),
        F.when(first, F.concat("title", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("text"),
        get("type", "reference").alias("type"), get("status", "current").alias("status"), get("related", "").alias("related"),
    )
