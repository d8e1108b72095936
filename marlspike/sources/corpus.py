"""Corpora: markdown, YAML, mail folders, fact files and JSON lines as leafs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.markdown import front_matter, sections
from marlspike.functions.predicates import indexable
from marlspike.functions.text import or_else, text
from marlspike.schema import MESSAGES

#: Fixed list of what a repository's default corpus holds.
DEFAULT = ("README.md", "PLAN.md", "AGENTS.md", "docs", "skills")
YAML_BYTES = 20_000
LEAF_INPUT = "text string, root string, confidence string, source string, source_rev string, how string, loc string, type string, valid_from string, valid_to string, embedding array<float>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """path, content (bytes), modified of files below path that may be indexed; a missing path gives none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, content binary, modified timestamp")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    found = reader.load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.col("modificationTime").alias("modified"))
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$") if suffixes else F.lit(True)
    relative = F.regexp_replace("path", "^" + path.rstrip("/").replace(".", r"\."), "")
    return found.where(wanted & indexable(relative))


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def markdown(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """Sections of every markdown file below path, with the heading before the text as it is stored."""
    found = files(spark, path, ".md", ".markdown").select("path", F.lit(repo).alias("repo"), decoded(F.col("content")).alias("content"))
    return sections(found).withColumn("text", F.when(F.col("heading") == "", F.col("text")).otherwise(F.concat("heading", F.lit("\n\n"), "text")))


def yaml_seeds(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """One leaf for each YAML file: its first YAML_BYTES bytes, headed by its stem."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files(spark, path, ".yaml", ".yml").select(
        F.col("path").alias("source"), F.lit(repo).alias("repo"), stem.alias("heading"), decoded(F.substring("content", 1, YAML_BYTES)).alias("text"),
        F.lit("seed").alias("type"), F.lit("current").alias("status"), F.lit("").alias("related"),
    )


def corpus(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    return markdown(spark, path, repo).unionByName(yaml_seeds(spark, path, repo))


def default_corpus(spark: SparkSession, root: str, repo: str = "") -> DataFrame:
    found = [markdown(spark, f"{root}/{x}", repo) for x in DEFAULT if exists(spark, f"{root}/{x}")]
    out = markdown(spark, f"{root}/.absent", repo)
    for x in found:
        out = out.unionByName(x)
    return out


def mail_leafs(spark: SparkSession, path: str, since: str = "", limit: int = 0) -> DataFrame:
    """Sections of message.md and attachments/*.md of mail folders; the date is the first ten characters of the front matter's."""
    found = files(spark, path, ".md").select("path", decoded(F.col("content")).alias("content"))
    at = F.regexp_extract("path", r"([^/]+)/(?:attachments/)?[^/]+$", 1)
    found = found.withColumn("message", at).withColumn("day", F.substring(text(F.try_element_at(front_matter(F.col("content")), F.lit("date"))), 1, 10))
    messages = found.groupBy("message").agg(F.max("day").alias("day"))
    if since:
        messages = messages.where(F.col("day") >= since)
    if limit > 0:
        messages = messages.orderBy(F.desc("day"), "message").limit(limit)
    kept = found.drop("day").join(messages, "message")
    name = F.regexp_extract("path", r"[^/]+$", 0)
    source = kept.select(F.concat(F.lit("mail:"), "message", F.lit(":"), name).alias("path"), F.lit("").alias("repo"), "content", "day")
    return sections(source).join(source.select(F.col("path").alias("source"), F.col("day").alias("valid_from")), "source")


def message_day(json: Column) -> Column:
    return F.substring(F.coalesce(F.get_json_object(json, "$.receivedDate"), F.get_json_object(json, "$.receivedAt"), F.lit("")), 1, 10)


def leafs_of_json(payload: DataFrame, key: str = "leafs", column: str = "value", more: tuple[str, ...] = ()) -> DataFrame:
    """Leaf inputs of JSON strings that are an object, a list, or {key: [...]}; rows without text or source are dropped; more: columns to keep."""
    v = F.trim(F.col(column))
    listed = F.when(v.startswith("["), F.from_json(v, f"array<struct<{as_struct()}>>")).otherwise(
        F.coalesce(F.from_json(v, f"struct<{key}:array<struct<{as_struct()}>>>")[key], F.array(F.from_json(v, f"struct<{as_struct()}>")))
    )
    return payload.select(F.explode(listed).alias("l"), *more).select("l.*", *more).where((F.trim(text("text")) != "") & (F.trim(text("source")) != ""))


def as_struct() -> str:
    return ",".join(":".join(x.split(" ")) for x in LEAF_INPUT.split(", "))


def facts_of_json(payload: DataFrame, column: str = "value") -> DataFrame:
    """Facts of JSON strings: a list or {"facts": [...]}, with the defaults of facts."""
    f = leafs_of_json(payload, "facts", column)
    return f.withColumns({"root": F.lit("facts"), "confidence": or_else(text("confidence"), "confirmed"), "how": or_else(text("how"), "extract"), "type": or_else(text("type"), "fact")})


#: Bytes of a JSON line that is read; longer ones are dropped as malformed.
LINE_BYTES = 1 << 20


def json_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """lines with their JSON as columns of schema; blank, malformed and overlong lines are dropped."""
    v = F.col(column)
    read = F.from_json(v, f"struct<{schema}, _bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where((F.trim(v) != "") & (F.octet_length(v) <= LINE_BYTES)).withColumn("_j", read)
    return rows.where("_j is not null and _j._bad is null").select(*[c for c in lines.columns if c != column], "_j.*").drop("_bad")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, as json_rows() reads them."""
    return json_rows(spark.read.text(path), ", ".join(":".join(x.split(" ", 1)) if ":" not in x else x for x in schema.split(", ")))


def together(*corpora: DataFrame) -> DataFrame:
    """All rows of corpora of the same columns, in any order of them; repeats stay."""
    return reduce(DataFrame.unionByName, corpora)


def chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Messages of chat files, the chat_id from the file's name and seq in file order."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    meta = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), F.from_json("value", MESSAGES).alias("m"))
    return meta.where("m is not null and (m.id is not null or m.text is not null)").select(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("chat_id"), "seq", "m.*")


def fingerprint(found: DataFrame) -> DataFrame:
    return found.agg(F.max("modified").alias("stamp"), F.count("*").alias("n"))
