"""Evidence: adjudication of claims, audits of stored facts, escalation to a second source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.predicates import confirmed_fact
from marlspike.functions.text import source_sides, text


def distinct_sources(side: Column) -> Column:
    """Independent sources; one without id counts by its kind and place, so blanks don't fall together."""
    name = lambda s, i: F.coalesce(F.nullif(s["id"], F.lit("")), F.concat(s["kind"], F.lit("#"), i.cast("string")))
    return F.coalesce(F.size(F.array_distinct(F.transform(side, name))), F.lit(0))


def fresh(side: Column) -> Column:
    return F.coalesce(F.size(F.filter(side, lambda s: ~F.coalesce(s["stale"], F.lit(False)))), F.lit(0))


def strong(side: Column) -> Column:
    return F.coalesce(F.size(F.filter(side, lambda s: s["kind"].isin("runtime", "config"))), F.lit(0))


def adjudicate(claims: DataFrame) -> DataFrame:
    """claims (…, yes, no: arrays of struct<id, kind, when, stale>) with n_yes, n_no, confidence, confirmed, rule, winner.

    Two independent sources on one side only: confirmed. On both: the side that alone is fresh, else the side that alone is strong,
    else unresolved.
    """
    counts = {f"{c}_{side}": f(F.col(side)) for side in ("yes", "no") for c, f in (("n", distinct_sources), ("fresh", fresh), ("strong", strong))}
    c = claims.withColumns(counts)
    n = lambda name: F.col(name) >= 2
    both = n("n_yes") & n("n_no")

    def ladder(single: Callable[[str], object], fresher: Callable[[str], object], stronger: Callable[[str], object], none, open_) -> Column:
        steps = [(~both & n("n_yes"), single("yes")), (~both & n("n_no"), single("no")), (~both, none)]
        for name, value in (("fresh", fresher), ("strong", stronger)):
            steps += [(n(f"{name}_yes") & ~n(f"{name}_no"), value("yes")), (n(f"{name}_no") & ~n(f"{name}_yes"), value("no"))]
        return F.coalesce(*[F.when(w, F.lit(v)) for w, v in steps], F.lit(open_))

    rule = ladder(lambda _: "two_source", lambda _: "temporal_freshness", lambda _: "authority_pairing", "single_source", "unresolved")
    winner = ladder(str, str, str, "", "")
    return (
        c.withColumn("rule", rule).withColumn("winner", winner).withColumn("confirmed", F.col("winner") != "")
        .withColumn("confidence", F.when(F.col("confirmed"), "confirmed").otherwise("hypothesis"))
        .drop("fresh_yes", "fresh_no", "strong_yes", "strong_no")
    )


def problems(source: Column, loc: Column, how: Column, confidence: Column) -> Column:
    """What is wrong with a stored fact, in order: codes of its evidence, its place and its method."""
    yes, no = source_sides(source)
    pair = lambda s: F.contains(s, F.lit(" x "))
    known = confidence.isin("confirmed", "partial", "hypothesis")
    checks = [
        (confidence == "confirmed") & F.contains(source, F.lit(" vs ")), "contradiction kept",
        (confidence == "confirmed") & ~pair(source), "needs two sources",
        (confidence == "hypothesis") & ((no == "") | ~pair(yes) | ~pair(no)), "needs both sides",
        ~known, "unknown confidence", loc == "", "missing loc", how == "", "missing how",
    ]
    found = [F.when(w, F.lit(name)) for w, name in zip(checks[::2], checks[1::2], strict=True)]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def audit_facts(facts: DataFrame) -> DataFrame:
    """id and problem, a row for each problem of facts (id, source, loc, how, confidence)."""
    cols = [text(c) for c in ("source", "loc", "how", "confidence")]
    return facts.select("id", F.posexplode(problems(*cols)).alias("problem_no", "problem"))


def audit_text(plan: str, readme: str) -> list[str]:
    """What the documents of a deployment fail to mention."""
    import re

    checks = [
        ("recall@5" in plan, "plan: no recall@5 gate"),
        (re.search(r"(?i)two[- ]source|2[- ]source|two independent sources", plan), "plan: no two-source rule"),
        ("temporal_freshness" in plan and "authority_pairing" in plan, "plan: no adjudication rules"),
        (re.search(r"(?i)search|retriev", readme), "readme: no description of search"),
    ]
    return [what for ok, what in checks if not ok]


def should_escalate(hits: DataFrame, root: str = "") -> DataFrame:
    """One row: escalate. True without a root filter and without a confirmed fact among the hits."""
    any_confirmed = F.coalesce(F.bool_or(confirmed_fact(F.col("root"), F.col("confidence"))), F.lit(False))
    return hits.agg((F.lit(root == "") & ~any_confirmed).alias("escalate"))


def deduce(hits: DataFrame, lookup: Callable[[], dict] | None, root: str = "", no_web: bool = False) -> dict | None:
    """The second source's answer, asked only where the hits call for it."""
    if root or no_web or lookup is None or not should_escalate(hits, root).first()["escalate"]:
        return None
    return lookup()


def claims_of(payload: DataFrame, column: str = "value") -> DataFrame:
    """Claims of JSON strings that are a claim, a list of claims or {"claims": [...]}."""
    from marlspike.schema import CLAIMS

    one, v = CLAIMS.simpleString(), F.trim(F.col(column))
    listed = F.when(v.startswith("["), F.from_json(v, f"array<{one}>")).otherwise(
        F.coalesce(F.from_json(v, f"struct<claims:array<{one}>>")["claims"], F.array(F.from_json(v, one)))
    )
    return payload.select(F.explode(listed).alias("c")).select("c.*").where("text is not null")
