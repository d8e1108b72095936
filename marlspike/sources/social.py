"""Inboxes and conversations of a social network as text pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.predicates import day_header
from marlspike.functions.text import clean_sender, text

PAGE = "url string, sections map<string,string>, references map<string,array<struct<kind:string,url:string,text:string,context:string>>>"
#: Fixed pattern of the line that opens a message.
MARKER, CLOCK = r"^(.+?) sent the following messages? at (.+)$", r"\d{1,2}:\d{2}\s*[AP]M"
SERVICE_CHAT = "777000"


def thread_id(url: Column) -> Column:
    """The last part of a thread's URL, or ''."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    return F.when(last.isin("thread", "messaging", "") | ~last.rlike(r"^[A-Za-z0-9=_-]{4,}$"), F.lit("")).otherwise(last)


def inbox(pages: DataFrame) -> DataFrame:
    """chat_id, name of conversations that a page (value: JSON) refers to, each once."""
    refs = pages.select(F.from_json("value", PAGE).alias("p")).select(F.explode(F.flatten(F.map_values("p.references"))).alias("r"))
    found = refs.where("r.kind = 'conversation'").select(thread_id(F.col("r.url")).alias("chat_id"), clean_sender(text(F.col("r.text"))).alias("name"))
    return found.where("chat_id <> ''").groupBy("chat_id").agg(F.max("name").alias("name"))


def conversation(pages: DataFrame) -> DataFrame:
    """chat_id, seq, day, clock, from, text of pages (chat_id, body): a marker line opens a message, a marker or another day's header ends it, and day
    headers carry forward. Lines outside of messages, links to profiles and the sender's own heading with a time are dropped, as are messages that
    have no other line."""
    rows = pages.select("chat_id", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy("chat_id").orderBy("pos")
    is_day, marks = day_header(F.col("line")), F.col("line").rlike(MARKER)
    rows = rows.withColumn("day", F.last(F.when(is_day, F.col("line")), ignorenulls=True).over(w))
    rows = rows.withColumn("turns", is_day & ~F.col("line").eqNullSafe(F.lag("day").over(w)))
    rows = rows.withColumn("seq", F.sum(marks.cast("int")).over(w)).withColumn("piece", F.sum((marks | F.col("turns")).cast("int")).over(w))
    rows = rows.withColumn("mark", F.first(F.when(marks, F.col("line")), ignorenulls=True).over(Window.partitionBy("chat_id", "piece").orderBy("pos")))
    sender = F.trim(F.regexp_extract("mark", MARKER, 1))
    profile = F.col("line").startswith("View ") & F.col("line").rlike("['’]s profile$")
    kept = rows.where("mark is not null").where(~(marks | is_day | profile | (F.startswith("line", sender) & F.col("line").rlike(CLOCK))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = kept.groupBy("chat_id", "seq").agg(F.first("mark").alias("mark"), F.first("day").alias("day"), text.alias("text"))
    return found.select("chat_id", "seq", "day", F.trim(F.regexp_extract("mark", MARKER, 2)).alias("clock"), clean_sender(sender).alias("from"), "text")


def clock_time(day: Column, clock: Column, now: Column) -> Column:
    """The timestamp of a weekday, relative or 'MON D' header and a clock: a weekday is the last one whose time isn't after now, a month's day the last that
    isn't after today; 'THIS WEEK' and 'LAST WEEK' are their Sundays. null without such a header or clock."""
    today = F.to_date(now)
    names = ("SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY")
    since_sunday = F.dayofweek(today) - 1
    date = F.when(F.upper(day) == "TODAY", today).when(F.upper(day) == "YESTERDAY", F.date_sub(today, 1))
    date = date.when(F.upper(day) == "THIS WEEK", F.date_sub(today, since_sunday)).when(F.upper(day) == "LAST WEEK", F.date_sub(today, since_sunday + 7))
    for i, name in enumerate(names):
        date = date.when(F.upper(day) == name, F.date_sub(today, F.pmod(since_sunday - i, F.lit(7))))
    md = F.try_to_timestamp(F.concat(F.initcap(F.regexp_replace(day, r"\s+", " ")), F.lit(" "), F.year(today).cast("string")), F.lit("MMM d yyyy")).cast("date")
    date = date.otherwise(F.when(md > today, F.add_months(md, -12)).otherwise(md))
    at = F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), F.regexp_replace(clock, r"\s+", " ")), F.lit("yyyy-MM-dd h:mm a"))
    return F.when(F.upper(day).isin(*names) & (at > now), at - F.expr("INTERVAL 7 DAYS")).otherwise(at)


def incoming(messages: DataFrame) -> DataFrame:
    """Messages of people (chat_id, kind, outgoing, text, media): bots, the service chat, own and empty ones are dropped; media has a placeholder."""
    shown = F.coalesce(F.nullif(F.trim(text("text")), F.lit("")), F.concat(F.lit("["), "media", F.lit("]")))
    kept = messages.where((F.col("kind") == "user") & (F.col("chat_id") != SERVICE_CHAT) & ~F.coalesce("outgoing", F.lit(False)))
    return kept.withColumn("text", shown).where("text is not null")


def never_empty(new: DataFrame, old: DataFrame) -> DataFrame:
    """What to store: the new rows, or the old ones where nothing new came."""
    return old if new.isEmpty() else new
