"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import materialize, prepare

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds. Possessive runs and a look-behind (or the end of the last match) keep the scan linear on long runs
#: and the matches as they are: if a run's first place doesn't match, no later place of the same run does.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An octet up to 255, leading zeros allowed.
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A mention: a token with a digit or an at sign, without marks around it, as phones and cards are by themselves. Every base span is in one. Other
#: tokens are candidates where they stand in the context of a pattern that is trusted among mentions.
MENTION = rf"{BASE['phone']}|(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){{12,18}}+(?![0-9A-Za-z])|(?<!\S)(?=\S*[0-9@])\S++"
MARKS = r"[^\p{L}\p{N}+]"
#: Code points on either side of a mention that hold its context.
CONTEXT = 64


#: Matches whose places are summed together: places cost (matches / GROUP) ** 2 and matches * GROUP, not matches ** 2.
GROUP = 64


def placed(found: Column, gaps: Column) -> Column:
    """array<struct<start, value>> of the matches found, start in code points from 0; gaps: sizes of the pieces between them. Both must be columns of
    the rows: an expression would be evaluated again for each match.

    Pieces come from split and matches from regexp_extract_all. Both scan alike, so the places are running sums, made in two levels.
    """
    n, empty = F.size(found), F.array().cast("array<struct<start:int,value:string>>")
    span = lambda i: F.get(gaps, i) + F.length(F.get(found, i))

    def step(a: Column, i: Column) -> Column:
        here = F.struct((a["at"] + F.get(gaps, i)).alias("start"), F.get(found, i).alias("value"))
        return F.struct((a["at"] + span(i)).alias("at"), F.concat(a["out"], F.array(here)).alias("out"))

    def members(g: Column) -> Column:
        return F.sequence(g * GROUP, F.least(n, (g + 1) * GROUP) - 1)

    groups = F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int"))
    sums = F.transform(groups, lambda g: F.aggregate(members(g), F.lit(0), lambda t, i: t + span(i)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(sums, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    zipped = F.arrays_zip(groups.alias("g"), starts.alias("at"))
    parts = F.transform(zipped, lambda z: F.aggregate(members(z["g"]), F.struct(z["at"].alias("at"), empty.alias("out")), step)["out"])
    return F.when(n > 0, F.flatten(parts)).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), 1, 64).substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, at: Column) -> Column:
    """The valid ones of placed() matches as array<struct<kind, start, end>>."""
    good = F.filter(at, lambda x: valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def first_overlapping(start: Column, end: Column) -> Column:
    """The first kind, as listed, of which a base span overlaps start..end, null if none: the <kind>_at spans of a kind are in order and apart, so the
    last one that starts before end is found by halving."""

    def one(kind: str) -> Column:
        spans = F.col(f"{kind}_at")

        def half(a: Column, _: Column) -> Column:
            mid = F.shiftright(a["low"] + a["high"], 1)
            before = F.get(spans, mid)["start"] < end
            return F.struct(F.when(before, mid + 1).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(mid).alias("high"))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
        after = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), half)["low"]
        return F.when((F.size(spans) > 0) & (F.get(spans, after - 1)["end"] > start), F.lit(kind))

    return F.coalesce(*map(one, KINDS))


def in_context(m: Column) -> Column:
    """The two contexts of a mention (left, right), hashed: the two words before it, and the word on either side."""
    words = F.regexp_extract_all(m["left"], F.lit(r"[^\s]+"), F.lit(0))
    back = lambda n: F.coalesce(F.try_element_at(words, F.lit(-n)), F.lit("^"))
    after = F.regexp_extract(m["right"], r"^\s*(\S+)", 1)
    return F.array(F.xxhash64(F.concat_ws(" ", F.lit("<"), back(2), back(1))), F.xxhash64(F.concat_ws(" ", F.lit("|"), back(1), F.lit("_"), after)))


def base_spans(docs: DataFrame) -> DataFrame:
    """Stored rows uid, doc_id, base (array<struct<kind, start, end>> by kind, then start), mentions (array<struct<start, end, kind, instance,
    patterns>>, kind null if unseen), pieces (array<struct<text, start>>: what stands between the mentions).

    Everything is made inside its row: work grows with a text's matches and the logarithm of its spans, and nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    could = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.lit(True), "card": F.lit(True)}
    shown = F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("")
    rows = rows.select("doc_id", shown.alias("text"), F.col("text").alias("whole"))
    for kind in KINDS:
        here = F.when(could[kind], F.col("text")).otherwise("")
        rows = rows.withColumn(kind, F.regexp_extract_all(here, F.lit(BASE[kind]), F.lit(0)))
    rows = rows.withColumn("mention", F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)))
    for kind in KINDS:
        gaps = F.transform(F.split("text", BASE[kind], -1), F.length)
        rows = rows.withColumn(f"{kind}_gaps", F.when(F.size(kind) > 0, gaps))
    rows = rows.withColumn("between", F.when(F.size("mention") > 0, F.split("text", MENTION, -1)).otherwise(F.array("whole"))).drop("text", "whole")
    rows = rows.withColumn("mention_gaps", F.transform("between", F.length))
    at = placed(F.col("mention"), F.col("mention_gaps"))
    around = F.transform(
        at,
        lambda x, i: F.struct(
            (x["start"] + F.length(F.regexp_extract(x["value"], rf"^{MARKS}*", 0))).alias("start"),
            trimmed(x["value"]).alias("value"),
            F.lower(F.substring(F.get("between", i), -CONTEXT, CONTEXT)).alias("left"),
            F.lower(F.substring(F.get("between", i + 1), 1, CONTEXT)).alias("right"),
        ),
    )
    ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda m: m["start"] + F.length(m["value"])))
    spans = [spans_of(kind, placed(F.col(kind), F.col(f"{kind}_gaps"))).alias(f"{kind}_at") for kind in KINDS]
    rows = rows.select("doc_id", *spans, F.filter(around, lambda m: F.length(m["value"]) >= 4).alias("around"), "between", ends.alias("ends"))
    found = F.transform(
        "around",
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["start"] + F.length(m["value"])).alias("end"),
            first_overlapping(m["start"], m["start"] + F.length(m["value"])).alias("kind"),
            F.xxhash64(F.lower(m["value"])).alias("instance"),
            in_context(m).alias("patterns"),
        ),
    )
    pieces = F.zip_with("between", "ends", lambda t, n: F.struct(t.alias("text"), n.alias("start")))
    rows = rows.select("doc_id", F.concat(*[f"{kind}_at" for kind in KINDS]).alias("base"), found.alias("mentions"), pieces.alias("pieces"))
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "pii")


def mentions_of(rows: DataFrame) -> DataFrame:
    """A row for each mention: uid, start, end, kind (null if unseen), instance (a hash), patterns (two contexts)."""
    return rows.select("uid", F.explode("mentions").alias("m")).select("uid", "m.*")


def pieces_of(rows: DataFrame) -> DataFrame:
    """A row for each piece of text between mentions: uid, piece, text, start."""
    return rows.select("uid", F.posexplode("pieces").alias("piece", "p")).select("uid", "piece", "p.text", "p.start")


def trimmed(word: Column) -> Column:
    return F.regexp_replace(word, rf"^{MARKS}+|{MARKS}+$", "")


#: Rows of a table that is sent to every task, at most.
SENT_ROWS = 1_000_000


def plain_tokens(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Stored rows uid, piece, place, instance, pattern: the tokens between mentions (place: which of its piece's words) that stand in the context of one
    of patterns (stored; pattern), two words before or a word on either side as in base_spans().

    Up to SENT_ROWS patterns are sent to the tokens, so that only tokens that match leave their task; more than that are met by a join on the
    pattern, whose hot ones adaptive execution splits. Both give the same rows.
    """
    words = pieces_of(rows).select("uid", "piece", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words"))

    def each(w: Column, i: Column) -> Column:
        one, two, after = F.get("words", i - 1), F.get("words", i - 2), F.get("words", i + 1)
        room = F.lit(CONTEXT - 2) - F.length(one)
        back1 = F.coalesce(F.lower(F.right(one, F.lit(CONTEXT - 1))), F.lit("^"))
        back2 = F.coalesce(F.when(room > 0, F.lower(F.right(two, room))), F.lit("^"))
        after = F.coalesce(F.lower(F.substring(after, 1, CONTEXT - 1)), F.lit(""))
        by = F.array(F.xxhash64(F.concat_ws(" ", F.lit("<"), back2, back1)), F.xxhash64(F.concat_ws(" ", F.lit("|"), back1, F.lit("_"), after)))
        return F.struct(i.alias("place"), w.alias("word"), by.alias("by"))

    tokens = words.select("uid", "piece", F.explode(F.transform("words", each)).alias("t")).select("uid", "piece", "t.place", "t.word", F.explode("t.by").alias("pattern"))
    value = trimmed(F.col("word"))
    few = F.broadcast(patterns) if patterns.count() <= SENT_ROWS else patterns
    met = tokens.join(few, "pattern").where(F.length(value) >= 4)
    return materialize(met.select("uid", "piece", "place", F.xxhash64(F.lower(value)).alias("instance"), "pattern"), "plain-tokens")


def plain_spans(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """hits (uid, piece, place, kind) as uid, kind, start, end."""
    at = pieces_of(rows).join(hits.groupBy("uid", "piece").agg(F.collect_list(F.struct("place", "kind")).alias("hits")), ["uid", "piece"])
    at = at.select("uid", "start", "hits", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words"), F.transform(F.split("text", r"\S+", -1), F.length).alias("gaps"))
    at = at.select("uid", "start", "hits", placed(F.col("words"), F.col("gaps")).alias("words"))
    found = F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), F.get("words", h["place"]).alias("word")))
    found = at.select("uid", "start", F.explode(found).alias("f")).select("uid", "f.kind", F.col("f.word.value").alias("word"), (F.col("start") + F.col("f.word.start")).alias("at"))
    start = F.col("at") + F.length(F.regexp_extract("word", rf"^{MARKS}*", 0))
    return found.select("uid", "kind", start.alias("start"), (start + F.length(trimmed(F.col("word")))).alias("end"))


def bootstrap(edges: DataFrame, rounds: int, least_support: int, least_score: float) -> tuple[DataFrame, DataFrame]:
    """instance, kind, score of unseen instances; pattern, kind, trust of the last round's patterns.

    edges: distinct (pattern, instance, kind of a seed or null). Each round scores the patterns by their instances, then the
    instances by their patterns: a pattern's score for a kind is the share of its distinct instances that are of it, seeds counting 1
    and found instances their score, damped by its support; an instance's score is one less the product of its patterns' doubts.
    Patterns under least_score or with fewer than least_support seeds find nothing.
    """
    trusted = None
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    known, found = seeds, None
    for k in range(rounds):
        held = edges.select("pattern", "instance", F.col("kind").alias("seed"))
        total = held.groupBy("pattern").agg(F.count("*").alias("n"))
        scored = held.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("of_kind"), F.sum((F.col("score") == 1.0).cast("int")).alias("support"))
        scored = scored.where(F.col("support") >= least_support).join(total, "pattern")
        scored = scored.withColumn("trust", F.col("of_kind") / F.col("n") * (1 - 1 / (1 + F.col("support"))))
        trusted = materialize(scored.where(F.col("trust") >= least_score).select("pattern", "kind", "trust"), f"patterns-{k}")
        unseen = edges.where("kind is null").select("pattern", "instance")
        score = 1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))
        found = unseen.join(trusted, "pattern").groupBy("instance", "kind").agg(score.alias("score")).where(F.col("score") >= least_score)
        best = F.max_by("kind", F.struct("score", "kind"))
        found = materialize(found.groupBy("instance").agg(best.alias("kind"), F.max("score").alias("score")), f"instances-{k}")
        known = seeds.unionByName(found)
    return found, trusted


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, rounds: int = 2, least_support: int = 5, least_score: float = 0.7) -> DataFrame:
    """Per document doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context (spans that contexts added), n_spans (all).

    Base spans are seeds. Patterns are the two words before a mention, and the word on either side; mentions are tokens with a digit or
    an at sign. Patterns are scored on the mentions first. Other tokens are candidates, and so count as instances, where they stand in the context of
    a pattern that is trusted then; all is scored again with them, and they become spans only in the context of a pattern of their kind that is still
    trusted. (Were each pattern with least_support seeds to bring its tokens, common contexts of a large corpus would bring most of its tokens.)
    A pattern counts each distinct instance once, so copies of a text add no support. An unseen mention that high-confidence
    patterns give a kind becomes a span `context_<kind>` unless a base span overlaps it. Null and empty texts have no spans; a null
    doc_id stays; repeated rows are scanned each; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = base_spans(docs)
    mentions = mentions_of(rows)
    edges = mentions.select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    _, first = bootstrap(edges, rounds, least_support, least_score)
    tokens = plain_tokens(rows, materialize(first.select("pattern").distinct(), "first-patterns"))
    more = tokens.select("pattern", "instance").distinct().withColumn("kind", F.lit(None).cast("string"))
    edges = materialize(edges.unionByName(more).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "all-edges")
    found, trusted = bootstrap(edges, rounds, least_support, least_score)
    unseen = mentions.where("kind is null").select("uid", "start", "end", "instance")
    span = F.struct(F.concat(F.lit("context_"), "kind").alias("kind"), "start", "end")
    plain = tokens.join(found.select("instance", "kind"), "instance").join(trusted.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    plain = plain_spans(rows, plain.select("uid", "piece", "place", "kind").distinct())
    spans = unseen.join(found.select("instance", "kind"), "instance").select("uid", "kind", "start", "end").unionByName(plain)
    added = spans.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("added"))
    out = rows.join(added, "uid", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    # context_ kinds follow the base kinds they belong to none of, by kind as listed, then start
    later = F.concat(*[of_kind("added", f"context_{k}") for k in KINDS])
    return out.select(
        "doc_id",
        *[F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", later)).alias("spans"),
        F.size("added").cast("long").alias("n_context"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
