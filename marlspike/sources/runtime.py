"""Runtime state as tables: services, hosts, organisations and the CRM graph, read from text that was taken elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.functions.text import text

GRAPH = "companies_with_persons map<string,array<string>>, projects_contacts map<string,struct<title:string,companies:array<string>>>"


def compose_services(files: DataFrame) -> DataFrame:
    """dir, file, name of services declared in compose files (path, content): the keys one level below 'services:'."""
    block = F.regexp_extract("content", r"(?ms)^services:[ \t]*\n((?:[ \t#][^\n]*(?:\n|\z)|\n)*)", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?m)^  ([A-Za-z0-9_.-]+):"), F.lit(1))
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), F.col("path").alias("file"), F.explode(names).alias("name"))


def ssh_hosts(files: DataFrame) -> DataFrame:
    """host of ssh configurations (content); several on a line, patterns dropped, sorted."""
    lines = F.regexp_extract_all("content", F.lit(r"(?im)^[ \t]*host[ \t]+(.+?)[ \t]*$"), F.lit(1))
    hosts = files.select(F.explode(lines).alias("line")).select(F.explode(F.split("line", r"\s+")).alias("host"))
    return hosts.where(~F.col("host").rlike(r"[*?!]") & (F.col("host") != "")).distinct().orderBy("host")


#: Fixed: the keys that may follow a mesh's block of organisations.
SIBLINGS = "clients|timeline|tech_weights|nodes|edges"


def orgs(files: DataFrame) -> DataFrame:
    """org, label, kind, period, website of the list under 'orgs:' of YAML files (content), which ends at the next of its sibling keys.

    An entry starts at '- id:'; of entries with one id the last counts, of a field's values the last; values stay as written, without a sibling no
    block ends and there are no organisations.
    """
    block = F.regexp_extract("content", rf"(?ms)^orgs:\n(.*?)\n^(?:{SIBLINGS}):", 1)
    entries = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- id:[ \t]*\S+[^\n]*(?:\n(?![ \t]*- id:[ \t]*\S)[^\n]*)*"), F.lit(0))
    name = lambda e: F.regexp_extract(e, r"^[ \t]*- id:[ \t]*(\S+)", 1)
    rows = files.select(entries.alias("all")).withColumn("names", F.transform("all", name))
    last = F.filter("all", lambda e, i: ~F.array_contains(F.slice("names", i + 2, F.size("names")), name(e)))
    get = lambda k: F.coalesce(F.try_element_at(F.regexp_extract_all("b", F.lit(rf"(?m)^[ \t]+{k}:[ \t]*(.*)$"), F.lit(1)), F.lit(-1)), F.lit(""))
    one = rows.select(F.explode(last).alias("b"))
    return one.select(name(F.col("b")).alias("org"), *[F.trim(get(k)).alias(k) for k in ("label", "kind", "period", "website")])


def crm_graph(payload: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Persons (company, person) and project companies (project, title, company) of a graph's JSON."""
    g = payload.select(F.from_json(column, GRAPH).alias("g"))
    persons = g.select(F.explode("g.companies_with_persons").alias("company", "persons")).select("company", F.explode_outer("persons").alias("person"))
    projects = g.select(F.explode("g.projects_contacts").alias("project", "p")).select("project", "p.title", F.explode_outer("p.companies").alias("company"))
    return persons, projects


def titles(projects: DataFrame) -> DataFrame:
    """project, title, parent of titles that are split by a bar."""
    parts = F.split(text("title"), r"\x7C")
    return projects.select("project", F.trim(F.element_at(parts, -1)).alias("title"), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, 1))).otherwise("").alias("parent"))


def facts(running: DataFrame, declared: DataFrame, hosts: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts that two sources agree on: text, source 'a x b', how.

    Containers (name, dir) with their own declaration, running names that are declared anywhere, containers named as hosts, hosts that
    docs (path, text) mention. Hosts meet documents through their words, so documents aren't compared with every host.
    """
    from marlspike.operators.pairing import mentions, own_declarations, running_and_declared

    row = lambda df, body, source, how: df.select(body.alias("text"), source.alias("source"), F.lit(how).alias("how"))
    own = own_declarations(running, declared)
    a = row(own, F.concat(F.lit("service "), "name", F.lit(" runs as declared")), F.concat(F.lit("runtime x "), "file"), "pair-compose")
    both = running_and_declared(running.select("name").distinct(), declared)
    b = row(both, F.concat(F.lit("service "), "name", F.lit(" is declared and runs")), F.lit("runtime x compose"), "pair-names")
    named = running.select(F.col("name").alias("host")).distinct().join(hosts, "host")
    c = row(named, F.concat(F.lit("host "), "host", F.lit(" is a running service")), F.lit("runtime x ssh"), "pair-hosts")
    mentioned = mentions(hosts, docs)
    d = row(mentioned, F.concat(F.lit("host "), "host", F.lit(" is documented")), F.concat(F.lit("ssh x "), "path"), "pair-docs")
    return a.unionByName(b).unionByName(c).unionByName(d).dropDuplicates(["text"])
