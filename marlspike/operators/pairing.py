"""Pairings of two sources: equal names, mentions, fuzzy labels, shared tokens, and what is missing on one side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.operators.chat import first_of
from marlspike.session import written

#: Code points of the runs by which a needle meets what may contain it.
GRAM = 3


def own_declarations(running: DataFrame, declared: DataFrame) -> DataFrame:
    """running (name, dir) with the first file of declared (name, dir, file) in its own directory."""
    first = declared.groupBy("dir", "name").agg(F.min("file").alias("file"))
    return running.join(first, ["dir", "name"])


def running_and_declared(running: DataFrame, declared: DataFrame) -> DataFrame:
    return running.join(declared.select("name").distinct(), "name", "left_semi")


def names_in_both(a: DataFrame, b: DataFrame, by: str = "name") -> DataFrame:
    """Names of both sides, each once."""
    return a.select(by).intersect(b.select(by))


def mentions(hosts: DataFrame, docs: DataFrame) -> DataFrame:
    """host and the first path of docs (path, text) that mention it as a whole word, case ignored, with ASCII bounds.

    A host's first run of ASCII letters and digits meets the runs of a text in an equi-join, and what meets is verified.
    """
    runs = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[0-9a-z_]+"), F.lit(0))
    h = hosts.select("host", F.get(runs(F.col("host")), F.lit(0)).alias("_run")).where("_run is not null").distinct()
    d = docs.select("path", "text", F.explode(F.array_distinct(runs(F.col("text")))).alias("_run"))
    whole = F.expr(r"text rlike concat('(?iu)(?<![0-9A-Za-z_])\\Q', host, '\\E(?![0-9A-Za-z_])')")
    return h.join(d, "_run").where(whole).groupBy("host").agg(F.min("path").alias("path"))


def words(label: Column) -> Column:
    """Words of at least four ASCII letters, in lower case, marks around them off."""
    bare = F.transform(F.split(F.trim(label), r"\s+"), lambda w: F.regexp_replace(w, r"""^[()/.,'"]+|[()/.,'"]+$""", ""))
    long = F.filter(bare, lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 4)
    return F.array_distinct(F.transform(long, F.lower))


def pieces(value: Column) -> Column:
    """The distinct runs of 1 to GRAM code points of a text."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - k + 1)), lambda i: F.substr(value, i, F.lit(k)))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def containments(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Rows of needles (needle, …) and hays (hay, …) where hay contains needle; either side has each text once, empty and null ones match nothing.

    The grams of a needle are its runs of GRAM code points, or a shorter needle itself. Grams are counted over the hays, and a needle meets them on its
    rarest gram alone, in an equi-join; one with a gram that no hay has is left out before. What meets is verified.
    """
    a = needles.where("needle <> ''")
    met = hays.where("hay <> ''").withColumn("_gram", F.explode(pieces(F.col("hay"))))
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("needle") - GRAM + 1)), lambda i: F.substr(F.col("needle"), i, F.lit(GRAM)))
    grams = a.select("needle", F.explode(F.array_distinct(long)).alias("_gram"))
    known = met.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = grams.join(known, "_gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    keyed = a.join(rarest.where("_r.n > 0").select("needle", F.col("_r._gram").alias("_gram")), "needle")
    return keyed.join(met, "_gram").where(F.contains("hay", "needle")).drop("_gram")


def least_containing(needles: DataFrame, hays: DataFrame, by: str) -> DataFrame:
    """needle (each once) and the least value of hays' column by (hay, by) among the texts that contain it."""
    least = hays.groupBy("hay").agg(F.min(by).alias(by))
    return containments(needles.select("needle").distinct(), least).groupBy("needle").agg(F.min(by).alias(by))


def least_contained(needles: DataFrame, hays: DataFrame, by: str) -> DataFrame:
    """hay (each once) and the least value of needles' column by (needle, by) among the texts that it contains."""
    least = needles.groupBy("needle").agg(F.min(by).alias(by))
    return containments(least, hays.select("hay").distinct()).groupBy("hay").agg(F.min(by).alias(by))


def contains_any(left: DataFrame, right: DataFrame, needles: str, hay: str) -> DataFrame:
    """Pairs of left and right where the lower-cased hay of right contains one of left's needles (an array), each once.

    Texts that are equal are compared once, see containments; rows are joined to what was found.
    """
    a = left.withColumn("needle", F.explode(F.array_distinct(needles)))
    b = right.withColumn("hay", F.lower(hay))
    found = containments(a.select("needle").distinct(), b.select("hay").distinct())
    return a.join(found, "needle").join(b, "hay").drop("needle", "hay").distinct()


def label_matches(orgs: DataFrame, companies: DataFrame) -> DataFrame:
    """orgs (org, label) with the first company (company) by name that contains the label's first word or one of its ' / ' parts."""
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("org"))
    first = F.lower(F.element_at(F.split(label, " "), 1))
    needles = F.filter(F.concat(F.array(first), F.transform(F.split(F.lower("label"), " / "), lambda w: F.trim(w))), lambda t: t != "")
    return first_company(orgs.select("org", F.explode(F.array_distinct(needles)).alias("needle")), companies)


def first_company(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """asked (org, needle) as org with the first company (company) by name that contains one of its needles."""
    found = least_containing(asked, companies.select(F.lower("company").alias("hay"), "company"), "company")
    return asked.join(found, "needle").groupBy("org").agg(F.min("company").alias("company"))


def word_pairs(left: DataFrame, right: DataFrame, label: str, name: str) -> DataFrame:
    """Pairs that share a whole significant word: an equi-join for labels of any number."""
    a = left.withColumn("_w", F.explode(words(F.col(label))))
    b = right.withColumn("_w", F.explode(words(F.col(name))))
    return a.join(b, "_w").drop("_w").distinct()


def token_matches(orgs: DataFrame, companies: DataFrame) -> DataFrame:
    """orgs (org, label) with the first company (company) by name that contains one of the label's significant words."""
    return first_company(orgs.select("org", F.explode(words(F.col("label"))).alias("needle")), companies)


def project_matches(companies: DataFrame, projects: DataFrame) -> DataFrame:
    """Companies (company) and projects (project, parent) where one's name contains the other's parent."""
    p = projects.where(F.trim("parent") != "").withColumn("needles", F.array(F.lower(F.trim("parent"))))
    return contains_any(p, companies, "needles", "company").select("company", "project")


def unmatched(orgs: DataFrame, matches: DataFrame, by: str = "org") -> DataFrame:
    return orgs.join(matches, by, "left_anti")


def contact_lookup(chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """chats (chat_id, name) with a contact_id of contacts (contact_id, name, email), by falling priority.

    Equal names, a contact that contains the name, a name that contains the contact's first word, a mail address that contains the name's
    first word; then the smaller contact_id (contacts without one are never taken). The ways are tried in stages: each one sees only the names that
    no earlier one matched, once each, and a name or address stands for the least contact that has it, so pairs of equal ones aren't made.
    """
    word = lambda x: F.element_at(F.split(x, r"\s+"), 1)
    a = chats.select("chat_id", "name", F.lower(F.trim("name")).alias("_a")).where("_a <> ''")
    b = contacts.select("contact_id", F.lower(F.trim("name")).alias("_b"), F.lower("email").alias("_email")).where("_b <> '' and contact_id is not null")
    named, mailed = b.select(F.col("_b").alias("hay"), "contact_id"), b.select(F.col("_email").alias("hay"), "contact_id")
    first_words = b.select(word(F.col("_b")).alias("needle"), "contact_id")

    def by_mail(open_: DataFrame) -> DataFrame:
        asked = open_.select("_a", word(F.col("_a")).alias("needle"))
        return asked.join(least_containing(asked, mailed, "contact_id"), "needle").select("_a", "contact_id")

    ways = [
        lambda open_: open_.join(b.groupBy(F.col("_b").alias("_a")).agg(F.min("contact_id").alias("contact_id")), "_a"),
        lambda open_: least_containing(open_.withColumnRenamed("_a", "needle"), named, "contact_id").withColumnRenamed("needle", "_a"),
        lambda open_: least_contained(first_words, open_.withColumnRenamed("_a", "hay"), "contact_id").withColumnRenamed("hay", "_a"),
        by_mail,
    ]
    open_, found = a.select("_a").distinct(), []
    for k, way in enumerate(ways):
        matched = way(open_).select("_a", "contact_id", F.lit(k).alias("priority"))
        if k + 1 < len(ways):
            state = written(open_.join(matched, "_a", "left"), "lookup")
            matched, open_ = state.where("priority is not null"), state.where("priority is null").select("_a")
        found.append(matched)
    pairs = a.join(reduce(DataFrame.unionByName, found), "_a")
    return first_of(pairs, ["chat_id"], "priority", "contact_id").select("chat_id", "name", "contact_id", "priority")


def reconcile(contacts: DataFrame, known: DataFrame) -> DataFrame:
    """contacts (…, emails) with action match or create, by the first mail address among known (email)."""
    first = F.lower(F.get("emails", F.lit(0)))
    k = known.select(F.lower("email").alias("_email")).distinct().withColumn("_there", F.lit(True))
    joined = contacts.withColumn("_email", first).join(k, "_email", "left")
    return joined.withColumn("action", F.when(F.col("_there"), "match").otherwise("create")).drop("_email", "_there")
