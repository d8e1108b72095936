"""Chats: facts in messages, participants, senders and the markdown of a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.predicates import valid_phone
from marlspike.functions.text import digits_only, text

#: Fixed patterns of facts in messages.
PHONE = r"[+\d][\d\s\-()]{6,25}\d"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
PROFILE = r"linkedin\.com/in/[A-Za-z0-9_-]+"
PROJECT = r"(?iu)project\s*[:/]\s*([^\n]+)"
DEAL = r"(?iu)(?:deal|opportunity)\s*[:/]\s*([^\n]+)"
SKILL = r"(?iu)(?:works?|worked|working)\s+(?:at|on|with)\s+[A-Z][A-Za-z0-9_\s]+"


FACTS = "array<struct<fact_type:string,value:string>>"


def every(body: Column, pattern: str, kind: str, mark: str = "") -> Column:
    """All matches of pattern; a text without mark, which every match holds, isn't searched."""
    found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("fact_type"), v.alias("value")))
    return F.when(F.contains(body, F.lit(mark)), found).otherwise(F.array().cast(FACTS)) if mark else found


def one(body: Column, pattern: str, group: int, kind: str) -> Column:
    """The first match of pattern, none if there is none: a group of these patterns isn't empty, so one search tells both."""
    found = F.filter(F.array(F.regexp_extract(body, pattern, group)), lambda v: v != "")
    return F.transform(found, lambda v: F.struct(F.lit(kind).alias("fact_type"), F.trim(v).alias("value")))


def facts_in(body: Column) -> Column:
    """array<struct<fact_type, value>>: every phone, mail address and profile, the first project, deal and work phrase."""
    change = lambda a, f: F.transform(a, lambda x: F.struct(x["fact_type"].alias("fact_type"), f(x["value"]).alias("value")))
    phones = change(every(body, PHONE, "phone"), lambda v: F.regexp_replace(F.trim(v), r"^[()\-\t ]+|[()\-\t ]+$", ""))
    phones = F.filter(phones, lambda x: valid_phone(x["value"]))
    emails = change(every(body, EMAIL, "email", "@"), F.lower)
    profiles = change(every(body, PROFILE, "linkedin", "linkedin.com/in/"), lambda v: F.concat(F.lit("https://"), v))
    return F.concat(phones, emails, profiles, one(body, PROJECT, 1, "project"), one(body, DEAL, 1, "deal"), one(body, SKILL, 0, "skill"))


def chat_facts(messages: DataFrame) -> DataFrame:
    """Facts of messages (chat_id, id, seq, from, text, platform), with the chat's first named sender so far as chat_name."""
    so_far = Window.partitionBy("chat_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = messages.withColumn("chat_name", text(F.first(F.nullif(F.col("from"), F.lit("")), ignorenulls=True).over(so_far)))
    found = named.select("chat_id", "chat_name", "platform", F.col("id").alias("message_id"), "seq", F.posexplode(facts_in(text("text"))).alias("n", "f"))
    return found.select("chat_id", "chat_name", "platform", "f.fact_type", "f.value", F.concat(F.lit("chat:"), "message_id").alias("source"), "message_id", "seq", "n")


def histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("fact_type").agg(F.count("*").alias("n"))


def fact_key(kind: Column, value: Column) -> Column:
    """What makes two facts one: phones by their digits, the rest by their value in lower case."""
    return F.when(kind == "phone", digits_only(value)).otherwise(F.lower(F.trim(value)))


def first_of(df: DataFrame, key: list, *order) -> DataFrame:
    """The first row of each key."""
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def dedupe_facts(facts: DataFrame) -> DataFrame:
    keyed = facts.withColumn("_key", fact_key(F.col("fact_type"), F.col("value")))
    return first_of(keyed, ["chat_id", "fact_type", "_key"], "seq", "n").drop("_key")


def main_sender(messages: DataFrame) -> DataFrame:
    """chat_id and the most frequent sender, empty and unknown ones aside; ties to the smaller name."""
    counts = messages.where((text("from") != "") & (F.col("from") != "unknown")).groupBy("chat_id", "from").agg(F.count("*").alias("n"))
    return first_of(counts, ["chat_id"], F.desc("n"), "from").select("chat_id", F.col("from").alias("sender"), "n")


def participants(messages: DataFrame) -> DataFrame:
    """chat_id, participants (sorted, distinct), n_participants, kind: a group beyond three."""
    listed = messages.groupBy("chat_id").agg(F.array_sort(F.collect_set(F.when(text("from") != "", F.col("from")))).alias("who"))
    n = F.size("who").cast("long")
    return listed.select("chat_id", F.array_join("who", ",").alias("participants"), n.alias("n_participants"), F.when(n > 3, "group").otherwise("personal").alias("kind"))


def chat_markdown(messages: DataFrame) -> DataFrame:
    """chat_id and the chat as markdown: front matter, then a line for each message in order."""
    line = F.concat(F.lit("**"), text("from"), F.lit("**: "), text("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    joined = messages.groupBy("chat_id").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(F.lit("---\nchat: "), F.col("chat_id").cast("string"), F.lit("\nmessages: "), F.col("n").cast("string"), F.lit("\n---\n\n"))
    return joined.select("chat_id", F.concat(head, "body").alias("markdown"))


def apply_plan(facts: DataFrame, contacts: DataFrame) -> DataFrame:
    """What would be written for facts (name, fact_type, value) to contacts (contact_id, name, infos): a plan, never an effect.

    Names meet on equality, in lower case; a fact that a contact has is skipped, one it lacks is added, an unmatched name is created.
    """
    c = contacts.select("contact_id", F.lower(F.trim("name")).alias("key"), "infos")
    key = F.lower(F.trim("name"))
    joined = facts.withColumn("key", key).join(c, "key", "left")
    have = F.exists("infos", lambda i: F.lower(i) == F.lower("value"))
    action = F.when(F.col("contact_id").isNull(), "persons-create").when(have, "skip").otherwise("info-add")
    return joined.select("name", "fact_type", "value", "contact_id", action.alias("action"))
