"""Mail: mbox files, MIME messages, attachments, calendars and incremental listings."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from datetime import timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.functions.text import normal_markdown, recipient, text

#: Fixed pattern of a line that separates messages of an mbox file.
SEPARATOR = r"^From (?:$|\S+\s+[A-Z][a-z]{2} [A-Z][a-z]{2} )"
MESSAGE = "id string, subject string, sender string, receivers string, day string, text string, html string, attachments array<struct<name:string,type:string,content:binary>>"
DEPTH = 16


def is_separator(line: Column) -> Column:
    return line.rlike(SEPARATOR)


def split_mbox(spark: SparkSession, path: str) -> DataFrame:
    """file, n, message: a running count of separator lines numbers the messages of a file; what stands before the first one belongs to none.

    Files are read by byte ranges, so a mailbox of any size is many tasks' work. Separators are counted in two levels: those of the ranges before, then
    those of the range so far. A message may cross ranges. Lines end with LF or CRLF; the last message of a file ends as the file does (of a compressed
    file, whose length is another, without a line end).
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    lines = raw.select(F.rtrim("value", F.lit("\r")).alias("line"), F.octet_length("value").alias("bytes"), at.alias("at")).select("line", "bytes", "at.*")
    ranges = lines.groupBy("file", "block", "size").agg(F.count_if(is_separator(F.col("line"))).alias("seps"), F.sum(F.col("bytes").cast("long") + 1).alias("read"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    # each line counts one byte for its end; a byte order mark of three isn't part of a line
    placed = ranges.select(
        "file", "block", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("base"),
        ((F.max("block").over(whole) == F.col("block")) & (F.col("size") - F.sum("read").over(whole)).isin(0, 3)).alias("ends"),
    )
    # rows of a range are read in order by one task
    own = F.sum(is_separator(F.col("line")).cast("long")).over(Window.partitionBy("file", "block").orderBy("seq"))
    numbered = lines.select("file", "block", "line", F.monotonically_increasing_id().alias("seq")).withColumn("own", own)
    rows = numbered.join(placed, ["file", "block"]).withColumn("n", (F.col("base") + F.col("own")).cast("long")).where("n > 0")
    text_of = F.transform(F.array_sort(F.collect_list(F.when(~is_separator(F.col("line")), F.struct("block", "seq", "line")))), lambda x: F.regexp_replace(x["line"], "^>(>*From )", "$1"))
    found = rows.groupBy("file", "n").agg(text_of.alias("lines"), F.max_by("ends", F.struct("block", "seq")).alias("ends"))
    last = F.col("ends") & (F.col("n") == F.max("n").over(whole)) & (F.size("lines") > 0)
    return found.select("file", "n", F.concat(F.array_join("lines", "\n"), F.when(last, "\n").otherwise("")).alias("message"))


def parts_of(message: email.message.Message, depth: int = 0) -> Iterator[email.message.Message]:
    if depth > DEPTH:
        return
    if message.is_multipart():
        for part in message.get_payload():
            yield from parts_of(part, depth + 1)
    else:
        yield message


def parse_message(raw: bytes, key: str = "") -> dict:
    """A MIME message flattened: first text, first HTML, named parts as attachments; the day is the UTC day."""
    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    head = lambda k: str(email.header.make_header(email.header.decode_header(m.get(k, "")))).strip()
    out = {"id": m.get("Message-ID", key).strip("<> ") or key, "subject": head("Subject"), "sender": head("From"), "receivers": head("To"), "day": "", "text": "", "html": "", "attachments": []}
    try:
        out["day"] = parsedate_to_datetime(m["Date"]).astimezone(timezone.utc).date().isoformat()
    except (TypeError, ValueError):
        pass
    for part in parts_of(m):
        body, kind, name = part.get_payload(decode=True) or b"", part.get_content_type(), part.get_filename()
        if name and not (kind.startswith("image/") and (part.get("Content-Disposition") or "").startswith("inline")):
            out["attachments"].append({"name": name, "type": kind, "content": body})
        elif kind in ("text/plain", "text/html"):
            slot = "text" if kind == "text/plain" else "html"
            if not out[slot]:
                try:
                    out[slot] = body.decode(part.get_content_charset() or "utf-8")
                except (LookupError, UnicodeDecodeError):
                    out[slot] = body.decode("latin-1")
    return out


def messages(df: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """Parsed messages of raw bytes; a message that can't be read is an empty one with its key as id."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b["k"], b["c"], strict=True):
                try:
                    rows.append(parse_message(bytes(raw), k))
                except Exception:  # noqa: BLE001  one broken message mustn't stop the rest
                    rows.append({"id": k, "subject": "", "sender": "", "receivers": "", "day": "", "text": "", "html": "", "attachments": []})
            if rows:
                yield pd.DataFrame(rows)

    return df.select(F.col(key).cast("string").alias("k"), F.col(content).cast("binary").alias("c")).mapInPandas(parse, MESSAGE)


#: Fields of a message's front matter, in order, before its type.
FRONT = ("id", "folder", "source", "subject", "from", "to", "date")


def message_markdown(body: Column, **fields: Column) -> Column:
    """Front matter of FRONT (sender stands for from; missing ones are empty), a heading, the body."""
    from marlspike.functions.text import quoted

    of = lambda k: fields.get("sender" if k == "from" else k, F.lit(""))
    front = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), quoted(of(k))) for k in FRONT], F.lit("type: mail"), F.lit("---"))
    title = F.coalesce(F.nullif(F.coalesce(of("subject"), F.lit("")), F.lit("")), F.lit("(no subject)"))
    return F.concat(front, F.lit("\n\n# "), title, F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))


def unescape_ics(value: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\N"), F.lit("\n")), r"\\([,;\\])", "$1")


def event_time(value: Column, zone: Column) -> Column:
    """'YYYY-MM-DD HH:MM' with the zone as written, or the day alone; other shapes stay as they are."""
    day = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")
    clock = F.regexp_replace(value, r"^\d{8}T(\d{2})(\d{2}).*$", "$1:$2")
    mark = F.when(value.endswith("Z"), F.lit(" UTC")).when(zone != "", F.concat(F.lit(" "), zone)).otherwise("")
    return F.when(value.rlike(r"^\d{8}$"), day).when(value.rlike(r"^\d{8}T\d{6}Z?$"), F.concat(day, F.lit(" "), clock, mark)).otherwise(value)


def calendar_markdown(content: Column) -> Column:
    """The events of a calendar as markdown; other text is only normalised."""
    flat = F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), "\n[ \t]", "")
    events = F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    get = lambda e, name: unescape_ics(F.trim(F.regexp_extract(e, rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)))
    zone = lambda e, name: F.regexp_extract(e, rf'(?m)^{name};[^:\n]*TZID="?([^":;\n]+)', 1)
    line = lambda label, v: F.when(v != "", F.concat(F.lit(f"- {label}: "), v))
    mail = lambda v: F.regexp_replace(v, "(?i)^mailto:", "")

    def attendees(e: Column) -> Column:
        rows = F.regexp_extract_all(e, F.lit(r"(?m)^ATTENDEE[^\n]*$"), F.lit(0))
        one = lambda r: F.concat(mail(F.regexp_extract(r, r"(?i)(mailto:[^\n]*)$", 1)), F.when(r.rlike("PARTSTAT="), F.concat(F.lit(" ("), F.lower(F.regexp_extract(r, "PARTSTAT=([^;:]+)", 1)), F.lit(")"))).otherwise(""))
        return F.array_join(F.transform(rows, one), ", ")

    def event(e: Column) -> Column:
        start, end = event_time(get(e, "DTSTART"), zone(e, "DTSTART")), event_time(get(e, "DTEND"), zone(e, "DTEND"))
        when = F.concat(start, F.when(end != "", F.concat(F.lit(" to "), end)).otherwise(""))
        return F.concat_ws("\n", F.concat(F.lit("## "), get(e, "SUMMARY")), line("when", when), line("where", get(e, "LOCATION")), line("what", get(e, "DESCRIPTION")), line("organizer", mail(get(e, "ORGANIZER"))), line("attendees", attendees(e)))

    method = F.regexp_extract(flat, r"(?m)^METHOD:(.*)$", 1)
    body = F.array_join(F.transform(events, event), "\n\n")
    head = F.when(method != "", F.concat(F.lit("method: "), F.trim(method), F.lit("\n\n"))).otherwise("")
    return F.when(F.contains(flat, F.lit("BEGIN:VCALENDAR")), F.concat(head, body)).otherwise(normal_markdown(content))


def folders(listed: DataFrame, excluded: list[str]) -> DataFrame:
    return listed.where(~F.lower("name").isin([x.lower() for x in excluded]))


def delta_ids(pages: DataFrame) -> DataFrame:
    """folder, id of changed messages of pages (folder, page, value: array<struct<id, removed>>): tombstones are dropped."""
    return pages.select("folder", F.explode("value").alias("v")).where("v.removed is null").select("folder", "v.id").distinct()


def delta_links(pages: DataFrame, taken: DataFrame) -> DataFrame:
    """folder and the link to go on from: the last page's new link only if every message of the folder was taken, else the old one.

    taken: (folder, id) of messages that are stored. pages: folder, page (its number; where there is none, pages are in the order of the table),
    old_link, delta_link, value.
    """
    wanted = delta_ids(pages)
    open_ = wanted.join(taken, ["folder", "id"], "left_anti").select("folder").distinct().withColumn("_open", F.lit(True))
    pages = pages if "page" in pages.columns else pages.withColumn("page", F.monotonically_increasing_id())
    last = pages.groupBy("folder").agg(F.max_by("old_link", F.when(F.col("old_link").isNotNull(), F.col("page"))).alias("old_link"), F.max_by("delta_link", "page").alias("delta_link"))
    return last.join(open_, "folder", "left").select("folder", F.when(F.col("_open") | F.col("delta_link").isNull(), F.col("old_link")).otherwise(F.col("delta_link")).alias("link"))


def normalise(raw: DataFrame) -> DataFrame:
    """Messages of JSON rows (id, subject, from, to, body {type, content}, preview, attachments {name, inline}) as the store has them."""
    html = F.lower(text(F.col("body.type"))) == "html"
    people = lambda c: F.array_join(F.transform(c, lambda r: recipient(r["name"], r["address"])), ", ")
    return raw.select(
        "id", text("subject").alias("subject"), recipient(F.col("from.name"), F.col("from.address")).alias("sender"), people(F.col("to")).alias("receivers"),
        F.when(html, text("preview")).otherwise(text(F.col("body.content"))).alias("text"), F.when(html, text(F.col("body.content"))).otherwise("").alias("html"),
        F.filter("attachments", lambda a: ~F.coalesce(a["inline"], F.lit(False))).alias("attachments"),
    )


def read_env(lines: list[str]) -> dict[str, str]:
    """key=value lines; comments and blank lines aside, quotes off."""
    pairs = (x.split("=", 1) for x in lines if "=" in x and not re.match(r"\s*#", x))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}
