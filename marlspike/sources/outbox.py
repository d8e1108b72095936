"""Named files as a data source to write to, stored messages as markdown beside them, attachments as text."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from marlspike.functions.predicates import route
from marlspike.functions.text import body_markdown, decode_bytes, html_text, text, trimmed
from marlspike.session import hadoop, written
from marlspike.sources.mail import message_markdown, parse_message

#: A stored message as the raw sink leaves it.
STORED = (
    "source string, id string, folder string, subject string, `from` string, `to` string, receivedAt string, date string, htmlBody string, textBody string, "
    "attachments array<struct<fileName:string,storedName:string,contentType:string>>, broken string"
)
STATUSES = ("ok", "skip", "fail")


@dataclass
class Counts(WriterCommitMessage):
    ok: int = 0
    skip: int = 0
    fail: int = 0


def usable(name: str | None) -> bool:
    """A relative name that stays below its folder."""
    return bool(name) and not name.startswith("/") and posixpath.normpath(name) == name and name.split("/")[0] not in ("..", ".")


class FileWriter(DataSourceWriter):
    """Each task writes its files whole under another name and then moves them to theirs, so a name holds a whole file or none.

    Commit adds up what tasks counted and leaves the sums as _reports/<run>.json. An aborted run leaves whole files, which the next one skips; a task
    that runs again counts those of its lost attempt as present.
    """

    def __init__(self, path: str, run: str, force: bool, dry: bool):
        self.path, self.run, self.force, self.dry = path, run, force, dry

    def write(self, iterator: Iterator[Row]) -> Counts:
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        n = Counts()
        for row in iterator:
            if not usable(row["name"]):
                n.fail += 1
                continue
            place = f"{root}/{row['name']}"
            if not self.force and (fs.get_file_info(place).size or 0) > 0:
                n.skip += 1
            elif row["content"] is None:
                n.fail += 1
            else:
                if not self.dry:
                    content = row["content"]
                    put(fs, place, content.encode() if isinstance(content, str) else bytes(content))
                n.ok += 1
        return n

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m]
        fs, root = arrow_fs.FileSystem.from_uri(self.path)
        put(fs, f"{root}/_reports/{self.run}.json", json.dumps({s: sum(getattr(m, s) for m in done) for s in STATUSES}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Whole files stay."""


def put(fs: arrow_fs.FileSystem, place: str, content: bytes) -> None:
    folder, name = posixpath.split(place)
    fs.create_dir(folder, recursive=True)
    aside = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(aside) as f:
        f.write(content)
    fs.move(aside, place)


class NamedFiles(DataSource):
    """df.write.format("named-files").option("force", …).option("dry", …).mode("append").save(path): rows of name and content (string or binary)."""

    @classmethod
    def name(cls) -> str:
        return "named-files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named files are replaced by name (option force), never as a whole: write with mode append")
        if missing := {"name", "content"} - {*schema.names}:
            raise ValueError(f"named files need the columns {sorted(missing)}")
        on = lambda key: str(self.options.get(key, "false")).lower() == "true"
        return FileWriter(self.options["path"], self.options.get("run", uuid.uuid4().hex), on("force"), on("dry"))


def save_files(df: DataFrame, path: str, force: bool = False, dry: bool = False) -> dict[str, int]:
    """Write rows of df (name, content) as files under path, a folder that all executors see; ok, skip and fail are counted.

    Files that are there and not empty stay, unless forced. Rows without a usable name or without content fail. Of rows of one name the one with the
    least content is written, so runs agree. dry counts and writes nothing.
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    p, fs = hadoop(spark, path)
    where, run = fs.makeQualified(p).toString(), uuid.uuid4().hex
    rows = df.select("name", "content")
    once = rows.where("name is not null").groupBy("name").agg(F.min("content").alias("content")).union(rows.where("name is null"))
    once.write.format("named-files").option("run", run).option("force", str(force)).option("dry", str(dry)).mode("append").save(where)
    store, root = arrow_fs.FileSystem.from_uri(where)
    with store.open_input_stream(f"{root}/_reports/{run}.json") as f:
        return json.loads(f.read())


def mail_text(content: pd.Series) -> pd.Series:
    """Text of raw messages, or of their HTML behind a NUL; null where they can't be read."""

    def one(raw: bytes | None) -> str | None:
        try:
            m = parse_message(bytes(raw or b""))
        except Exception:  # noqa: BLE001  one broken message mustn't stop the rest
            return None
        return m["text"] or ("\0" + m["html"] if m["html"] else "")

    return content.map(one)


def event_lines(content: Column) -> Column:
    """The start, summary and place of each event of a calendar, as written."""
    flat = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), "\n[ \t]", "")
    events = F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))

    def lines(e: Column) -> Column:
        of = lambda key, label: F.when(e.rlike(rf"(?m)^{key}[;:]"), F.concat(F.lit(f"- {label}: "), F.regexp_extract(e, rf"(?m)^{key}(?:;[^:\n]*)?:(.*)$", 1)))
        return F.concat_ws("\n", of("DTSTART", "when"), of("SUMMARY", "what"), of("LOCATION", "where"))

    return F.array_join(F.filter(F.transform(events, lines), lambda x: x != ""), "\n")


def attachment_markdown(name: Column, media: Column, content: Column) -> Column:
    """Text of an attachment by its route; what has no reader here (images, PDF and office files) is described. Never null, never an error.

    content is binary; null content is an attachment of unknown size.
    """
    handler = route(media, F.regexp_extract(text(name), r"(\.[^./]*)$", 1))
    plain = text(decode_bytes(content))
    size = F.coalesce(F.concat(F.octet_length(content).cast("string"), F.lit(" bytes")), F.lit("unknown size"))
    described = F.concat(F.lit("<!-- attachment: "), text(name), F.lit(" ("), size, F.lit(") -->"))
    # a Python function of a branch is computed for every row: other rows hand in nothing
    mail = F.pandas_udf(mail_text, "string")(F.when(handler == "eml", content))
    read = F.when(mail.startswith("\0"), html_text(F.substring(mail, 2, 2**31 - 1))).otherwise(trimmed(mail))
    shown = (
        F.when(handler == "text", plain).when(handler == "html", html_text(plain)).when(handler == "structured", F.concat(F.lit("```\n"), plain, F.lit("\n```")))
        .when(handler == "ical", event_lines(plain)).when(handler == "image", F.lit("\n<!-- image skipped -->\n"))
        .when(handler == "eml", F.coalesce(read, F.concat(F.lit("\n<!-- "), text(name), F.lit(": unreadable message -->\n")))).otherwise(described)
    )
    return F.when(content.isNull(), described).otherwise(F.coalesce(shown, described))


#: Bytes of contents that go back to Spark at once.
READ_BYTES = 8 << 20


def walked(spark: SparkSession, root: str) -> DataFrame:
    """Stored rows path (relative to root) and length of the files below root, but for hidden ones (names that begin with a dot or an underscore).

    Tasks list folders, a level at a time, so the driver gets no names; a folder's own entries are listed by one task.
    """
    at, fs = hadoop(spark, root)
    uri = fs.makeQualified(at).toString()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs.FileSystem.from_uri(uri)
        for b in batches:
            for folder in b.column("path").to_pylist():
                found = fs.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                found = [x for x in found if x.base_name[:1] not in (".", "_") and x.type in (arrow_fs.FileType.File, arrow_fs.FileType.Directory)]
                for i in range(0, len(found), 4096):
                    some = found[i : i + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [posixpath.join(folder, x.base_name) for x in some], "length": [x.size or 0 for x in some], "folder": [x.type == arrow_fs.FileType.Directory for x in some]},
                        schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.bool_())]),
                    )

    levels, folders = [], spark.createDataFrame([("",)], "path string")
    while not levels or not folders.isEmpty():
        level = written(spread(folders).mapInArrow(entries, "path string, length long, folder boolean"), "listing")
        levels.append(level.where(~F.col("folder")).select("path", "length"))
        folders = level.where("folder").select("path")
    return reduce(DataFrame.union, levels)


def spread(rows: DataFrame) -> DataFrame:
    """rows by path over all cores, as tables of names are small and so few partitions."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def contents(files: DataFrame, root: str) -> DataFrame:
    """Rows of files (path, …) with the content of each (binary), read by tasks."""
    at, fs = hadoop(files.sparkSession, root)
    uri = fs.makeQualified(at).toString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_fs.FileSystem.from_uri(uri)
        for b in batches:
            held, size, first = [], 0, 0
            for k, path in enumerate(b.column("path").to_pylist()):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= READ_BYTES or k + 1 == len(b):
                    part = b.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*b.schema.names, "content"])
                    held, size, first = [], 0, k + 1

    return spread(files).mapInArrow(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def named(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.substring_index("path", "/", -1) == name)


def stored_messages(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """dir (relative to root) and the message of every message.json below root; one that isn't a message has nulls but for broken. files: walked(), if known."""
    raw = contents(named(walked(spark, root) if files is None else files, "message.json").select("path"), root).withColumn("value", F.col("content").cast("string"))
    body = F.from_json("value", STORED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = raw.select(F.regexp_replace("path", "/?message[.]json$", "").alias("dir"), body.alias("m"), "value")
    return rows.select("dir", "m.*", (F.col("m.broken").isNotNull() | F.col("m").isNull() | ~trimmed("value").startswith("{")).alias("failed")).drop("broken")


def message_day(date: Column, received: Column) -> Column:
    """The UTC day of a message's date, else of its arrival, else ''. Times of the year 1 are none."""
    of = lambda c: F.when(~text(c).startswith("0001-01-01"), F.to_date(F.try_to_timestamp(c)))
    return text(F.coalesce(of(date), of(received)).cast("string"))


def convert_messages(spark: SparkSession, root: str, force: bool = False, dry: bool = False) -> dict[str, int]:
    """message.md beside every message.json below root, and the text of its attachments beside them; ok, skip and fail are counted.

    A message whose message.md is there and not empty is left alone unless forced; one that can't be parsed fails. Attachments are written first, so that a
    run that ends between the two does them again. An attachment is looked for under its stored name, else its own; one without either, without a file or
    without text gives none.
    """
    files = walked(spark, root)
    rows = stored_messages(spark, root, files)
    markdown = message_markdown(
        body_markdown(F.col("textBody"), F.col("htmlBody")), id=F.col("id"), folder=F.col("folder"), source=F.col("source"), subject=F.col("subject"),
        sender=F.col("from"), to=F.col("to"), date=message_day(F.col("date"), F.col("receivedAt")),
    )
    name = F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit("message.md"))
    if not dry:
        todo = rows.where("not failed")
        if not force:
            todo = todo.join(present_messages(files), "dir", "left_anti")
        save_files(attachment_files(files, root, todo), root, force=True)
    return save_files(rows.select(name.alias("name"), F.when(~F.col("failed"), markdown).alias("content")), root, force, dry)


def present_messages(files: DataFrame) -> DataFrame:
    return named(files, "message.md").where("length > 0").select(F.regexp_replace("path", "/?message[.]md$", "").alias("dir"))


def attachment_files(files: DataFrame, root: str, rows: DataFrame) -> DataFrame:
    """name and content of the texts of attachments of rows (dir, attachments) that lie below root."""
    asked = rows.select("dir", F.explode("attachments").alias("a")).select("dir", F.nullif(text("a.fileName"), F.lit("")).alias("own"), F.nullif(text("a.storedName"), F.lit("")).alias("stored"), F.col("a.contentType").alias("media"))
    at = lambda file: F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit("attachments"), file)
    asked = asked.withColumn("file", F.coalesce("stored", "own")).where("file is not null")
    met = contents(asked.withColumn("path", at(F.col("file"))).join(files.where(F.col("path").rlike("(^|/)attachments/")).select("path"), "path"), root)
    made = met.select(F.concat(at(F.coalesce("own", "stored")), F.lit(".md")).alias("name"), attachment_markdown(F.col("file"), F.col("media"), F.col("content")).alias("content"))
    return made.where("content <> ''")
