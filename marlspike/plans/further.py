"""Further named queries: sources, scalars, pairings and reports over the driver's tables, each with the same query in DuckDB's SQL.

Inputs that no table holds (contacts, pages, configuration files) are made from the tables by expressions that both engines read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlspike.functions import predicates as P
from marlspike.functions import render as V
from marlspike.functions import text as X
from marlspike.operators import evidence as E
from marlspike.operators import pairing as J
from marlspike.operators import reports as T
from marlspike.plans.catalogue import query, table
from marlspike.session import shared_dir
from marlspike.sources import contacts as N
from marlspike.sources import corpus as K
from marlspike.sources import git as G
from marlspike.sources import mail as M
from marlspike.sources import outbox as B
from marlspike.sources import runtime as U
from marlspike.sources import social as L
from marlspike.sources import web as W

# --- contacts -------------------------------------------------------------------------------------------------------------

PERSON = "CASE c_custkey % 3 WHEN 0 THEN 'Ann ' || c_custkey % 50 WHEN 1 THEN 'X' || c_custkey % 30 ELSE 'Bob' END"
CHAT = "CASE s_suppkey % 4 WHEN 0 THEN 'ann ' || s_suppkey % 60 WHEN 1 THEN 'x' || s_suppkey % 40 || ' more' WHEN 2 THEN 'bob' ELSE ' ' END"
MAIL = "'ann' || c_custkey % 10 || '@X.org'"


@query(
    f"""WITH c AS (SELECT c_custkey, lower(trim({PERSON})) AS b, lower({MAIL}) AS m FROM customer), s AS (SELECT s_suppkey, lower(trim({CHAT})) AS a FROM supplier WHERE trim({CHAT}) <> ''),
    p AS (SELECT s_suppkey, c_custkey, CASE WHEN a = b THEN 0 WHEN contains(b, a) THEN 1 WHEN contains(a, split_part(b, ' ', 1)) THEN 2 WHEN contains(m, split_part(a, ' ', 1)) THEN 3 END AS priority FROM s, c)
    SELECT s_suppkey AS chat_id, c_custkey AS contact_id, priority FROM p WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY priority, c_custkey) = 1"""
)
def contact_lookup(spark, d):
    chats = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chat_id"), F.expr(CHAT).alias("name"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("contact_id"), F.expr(PERSON).alias("name"), F.expr(MAIL).alias("email"))
    return J.contact_lookup(chats, people).select("chat_id", "contact_id", "priority")


def people(spark, d):
    """customer as contacts: names, organisations, mails and phones that some lack."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    several = lambda n, mark: F.when(k % n == 0, F.array()).when(k % n == 1, F.array(F.concat("c_name", F.lit(mark)))).otherwise(F.array(F.concat("c_name", F.lit(mark)), F.lit(f"second{mark}"))).cast("array<string>")
    return c.select(
        "c_custkey", F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.when(k % 2 == 0, "Ann").otherwise("").alias("given"), F.when(k % 3 == 0, "Lee").otherwise("").alias("family"),
        F.when(k % 7 == 0, F.col("c_mktsegment")).otherwise("").alias("org"), F.lit("").alias("title"), F.lit("").alias("photo"), F.col("c_mktsegment").alias("source"), several(4, "@x").alias("emails"), several(3, "+1").alias("phones"),
    )


NAMED = """CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Ann Lee' WHEN c_custkey % 2 = 0 THEN 'Ann' WHEN c_custkey % 3 = 0 THEN 'Lee'
  WHEN c_custkey % 4 <> 0 THEN c_name || '@x' WHEN c_custkey % 3 <> 0 THEN c_name || '+1' ELSE '(unnamed)' END"""


@query(f"SELECT c_custkey, {NAMED} AS name FROM customer")
def display_names(spark, d):
    return people(spark, d).select("c_custkey", N.named().alias("name"))


@query("SELECT c_custkey, c_custkey % 5 <> 0 OR c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 7 = 0 OR c_custkey % 4 <> 0 OR c_custkey % 3 <> 0 AS known FROM customer")
def contact_identity(spark, d):
    return people(spark, d).select("c_custkey", P.has_identity(*map(F.col, ("full_name", "given", "family", "org")), lists=(F.col("emails"), F.col("phones"))).alias("known"))


@query(
    """SELECT coalesce(source, 'total') AS source, count(*) AS n, sum(e)::BIGINT AS n_emails, sum(p)::BIGINT AS n_phones
    FROM (SELECT c_mktsegment AS source, least(c_custkey % 4, 2) AS e, least(c_custkey % 3, 2) AS p FROM customer) GROUP BY ROLLUP (source)"""
)
def contact_counts(spark, d):
    return N.counts(people(spark, d)).withColumn("source", F.coalesce("source", F.lit("total")))


@query(
    f"""SELECT 'Contact: ' || n || CASE WHEN c_custkey % 7 = 0 THEN ' @ ' || c_mktsegment ELSE '' END
    || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Emails: ' || c_name || '@x' ELSE chr(10) || 'Emails: ' || c_name || '@x, second@x' END
    || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Phones: ' || c_name || '+1' ELSE chr(10) || 'Phones: ' || c_name || '+1, second+1' END AS text, 'contact:' || n AS source
    FROM (SELECT *, {NAMED} AS n FROM customer)"""
)
def contact_leafs(spark, d):
    return N.as_leafs(people(spark, d)).select("text", "source")


@query(
    """SELECT c_mktsegment || ',' || CASE c_custkey % 4 WHEN 0 THEN '""' WHEN 1 THEN c_name || '@x' ELSE c_name || '@x;second@x' END AS csv, NULL AS json FROM customer
    UNION ALL SELECT NULL, '{"source":"' || c_mktsegment || '","given":"' || CASE WHEN c_custkey % 2 = 0 THEN 'Ann' ELSE '' END || '"}' FROM customer"""
)
def contact_renderings(spark, d):
    p = people(spark, d)
    numbered = lambda f, *c: f(p, *c).withColumnRenamed("value", f.__name__[3:])
    return numbered(V.as_csv, "source", "emails").withColumn("json", F.lit(None).cast("string")).unionByName(numbered(V.as_json, "source", "given").withColumn("csv", F.lit(None).cast("string")))


@query("SELECT n_name AS full_name, 'Ann' || n_nationkey AS given, 'Lee;x' AS family, 'a@' || lower(replace(n_name, ' ', '')) || '.org' AS email, '+1 ' || n_nationkey AS phone FROM nation")
def vcard_contacts(spark, d):
    key = F.col("n_nationkey").cast("string")
    card = F.concat(
        F.lit("BEGIN:VCARD\r\nVERSION:2.1\r\nN:Lee\\;x;Ann"), key, F.lit("\r\nFN:"), "n_name", F.lit("\r\nTEL;HOME:+1 "), key,
        F.lit("\r\nEMAIL;TYPE=work:a@"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".org\r\nEND:VCARD\r\n"),
    )
    v = N.vcards_of(table(spark, d, "nation").select(card.alias("value")))
    return v.select("full_name", "given", "family", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))


@query("SELECT n_name AS full_name, 'a@x' || n_nationkey AS email, '+4' || n_nationkey AS phone FROM nation")
def csv_contacts(spark, d):
    head = "Name,E-mail 1 - Value,Phone 1 - Value,Notes"
    body = F.concat(F.lit(f'{head}\n"'), "n_name", F.lit('",a@x'), F.col("n_nationkey").cast("string"), F.lit(",+4"), F.col("n_nationkey").cast("string"), F.lit("\n"))
    v = N.csv_of(table(spark, d, "nation").select(body.alias("value")))
    return v.select("full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"))


@query("SELECT n_name AS full_name, 'a(b)' AS org, 'm' || n_nationkey || '@x' AS email FROM nation")
def mork_contacts(spark, d):
    key = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("<(80=DisplayName)(81=Company)(82=PrimaryEmail)>\n<(90=m"), key, F.lit("@x)>\n[1:^80(^80="), F.col("n_name"), F.lit(")(^81=a\\(b\\))(^82^90)]"))
    v = N.mork_of(table(spark, d, "nation").select(body.alias("value")))
    return v.select("full_name", "org", F.get("emails", F.lit(0)).alias("email"))


@query("SELECT c_mktsegment AS source, min(c_name) AS full_name FROM customer GROUP BY c_mktsegment")
def contact_dedupe(spark, d):
    c = table(spark, d, "customer")
    same = c.select(F.col("c_mktsegment").alias("full_name"), F.lit("").alias("given"), F.lit("").alias("family"), F.lit("").alias("org"), F.array().cast("array<string>").alias("emails"), F.array().cast("array<string>").alias("phones"), F.col("c_name").alias("source"))
    return N.dedupe(same).select(F.col("full_name").alias("source"), F.col("source").alias("full_name"))


# --- pairings -------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT t.p_type AS company, p.p_partkey AS project FROM (SELECT DISTINCT p_type FROM part) t, part p WHERE p_partkey % 3 <> 0 AND contains(lower(t.p_type), lower(split_part(p.p_type, ' ', 1)))")
def parent_match(spark, d):
    p = table(spark, d, "part")
    projects = p.select(F.col("p_partkey").alias("project"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("parent"))
    return J.project_matches(p.select(F.col("p_type").alias("company")).distinct(), projects)


@query(
    """SELECT org, min(company) AS company FROM (SELECT n_name AS org, unnest(list_filter(string_split(lower(n_name), ' '), lambda w: length(regexp_replace(w, '[^a-z]', '', 'g')) >= 4)) AS w FROM nation),
    (SELECT 'the ' || lower(n_name) || 's of ' || r_name AS company FROM nation JOIN region ON r_regionkey = n_regionkey) WHERE contains(lower(company), w) GROUP BY org"""
)
def token_contained_match(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    companies = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("the "), F.lower("n_name"), F.lit("s of "), "r_name").alias("company"))
    return J.token_matches(n.select(F.col("n_name").alias("org"), F.col("n_name").alias("label")), companies)


@query(
    """WITH r AS (SELECT lower(replace(n_name, ' ', '-')) AS name, n_nationkey AS k, '/d' || n_regionkey AS dir FROM nation), h AS (SELECT name AS host FROM r WHERE k % 4 = 0),
    f AS (SELECT 'service ' || name || ' runs as declared' AS text, 'runtime x /d' || (k % 2) || '/c.yml' AS source, 'pair-compose' AS how FROM r WHERE k % 3 = 0 AND dir = '/d' || (k % 2)
      UNION ALL SELECT 'service ' || name || ' is declared and runs', 'runtime x compose', 'pair-names' FROM r WHERE k % 3 = 0
      UNION ALL SELECT 'host ' || host || ' is a running service', 'runtime x ssh', 'pair-hosts' FROM h
      UNION ALL SELECT 'host ' || name || ' is documented', 'ssh x doc' || k, 'pair-docs' FROM r WHERE k % 4 = 0) SELECT * FROM f"""
)
def two_source_facts(spark, d):
    n = table(spark, d, "nation")
    name, k = F.lower(F.translate("n_name", " ", "-")), F.col("n_nationkey")
    running = n.select(name.alias("name"), F.concat(F.lit("/d"), F.col("n_regionkey").cast("string")).alias("dir"))
    file = F.concat(F.lit("/d"), (k % 2).cast("string"), F.lit("/c.yml"))
    declared = n.where(k % 3 == 0).select(name.alias("name"), F.concat(F.lit("/d"), (k % 2).cast("string")).alias("dir"), file.alias("file"))
    docs = n.select(F.concat(F.lit("doc"), k.cast("string")).alias("path"), F.concat(F.lit("Our <"), F.upper(name), F.lit("> host")).alias("text"))
    return U.facts(running, declared, n.where(k % 4 == 0).select(name.alias("host")), docs).select("text", "source", "how")


# --- runtime --------------------------------------------------------------------------------------------------------------


@query("SELECT '/d' || n_nationkey AS dir, unnest(['web', 'db' || n_nationkey]) AS name FROM nation")
def compose_scan(spark, d):
    key = F.col("n_nationkey").cast("string")
    content = F.concat(F.lit("version: 3\nservices:\n  web:\n    image: x\n  db"), key, F.lit(":\n    image: y\nvolumes:\n  data:\n"))
    return U.compose_services(table(spark, d, "nation").select(F.concat(F.lit("/d"), key, F.lit("/compose.yml")).alias("path"), content.alias("content"))).select("dir", "name")


@query("SELECT DISTINCT unnest([lower(replace(n_name, ' ', '-')), 'alias' || n_regionkey]) AS host FROM nation")
def ssh_scan(spark, d):
    content = F.concat(F.lit("Host "), F.lower(F.translate("n_name", " ", "-")), F.lit(" alias"), F.col("n_regionkey").cast("string"), F.lit("\n  User x\nhost *\n  Port 22\n"))
    return U.ssh_hosts(table(spark, d, "nation").select(content.alias("content")))


@query(
    """SELECT unnest(['o' || n_nationkey, 'twice']) AS org, unnest([n_name, '"second"']) AS label, unnest(['client', '']) AS kind, unnest(['', '2006–present']) AS period,
    unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'https://x.org' ELSE '' END, '']) AS website FROM nation"""
)
def org_block_scan(spark, d):
    """Lists of organisations, one of them named twice, before each of the keys that may follow; without such a key there are none."""
    key = F.col("n_nationkey")
    entry = F.concat(F.lit("orgs:\n- id: twice\n  label: first\n  kind: own\n- id: o"), key.cast("string"), F.lit("\n  label: "), "n_name", F.lit("\n  kind: client\n"), F.when(key % 2 == 0, "  website: https://x.org\n").otherwise(""))
    content = F.concat(F.lit("people:\n- id: no\n"), entry, F.lit('- id: twice\n  label: "second"\n  period: 2006–present\n'), F.element_at(F.array(*map(F.lit, U.SIBLINGS.split("|"))), (key % 5 + 1).cast("int")), F.lit(":\n- id: o99\n  label: no\n"))
    open_ = F.lit("orgs:\n- id: never\n  label: ended\n")
    rows = table(spark, d, "nation").select(F.explode(F.array(content, open_)).alias("content"))
    return U.orgs(rows)


@query("SELECT n_nationkey AS project, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'Top' ELSE '' END AS parent FROM nation")
def title_split(spark, d):
    title = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Top | "), "n_name")).otherwise(F.concat(F.lit(" "), "n_name"))
    return U.titles(table(spark, d, "nation").select(F.col("n_nationkey").alias("project"), title.alias("title")))


@query("SELECT r_name AS company, unnest(['p' || r_regionkey, 'q']) AS person FROM region")
def crm_graph_persons(spark, d):
    body = F.concat(F.lit('{"companies_with_persons": {"'), "r_name", F.lit('": ["p'), F.col("r_regionkey").cast("string"), F.lit('", "q"]}, "projects_contacts": {}}'))
    return U.crm_graph(table(spark, d, "region").select(body.alias("value")))[0]


# --- commits --------------------------------------------------------------------------------------------------------------


def commits(spark, d):
    """orders as commits, of which every tenth is a merge."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    subject = F.concat(F.lit(" feat: "), "o_orderpriority", F.lit(" \r\n\nbody"))
    return o.select(
        F.concat(k.cast("string"), F.lit("-0123456789abcdef")).alias("id"), F.lit("o/r").alias("repo"), F.concat(F.lit("A"), (F.col("o_custkey") % 9).cast("string")).alias("author"), F.lit("A@x").alias("email"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), subject.alias("message"), F.when(k % 10 == 0, 2).otherwise(1).alias("n_parents"), F.array(F.lit("a.py"), F.concat(F.lit("f"), (k % 4).cast("string"))).alias("files"),
    )


@query(
    """SELECT 'commit ' || substr(s, 1, 12) || ' in o/r — feat: ' || o_orderpriority || chr(10) || 'Author: A' || o_custkey % 9 || ' <A@x>' || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || chr(10)
      || 'Changing: a.py, f' || o_orderkey % 4 AS text, 'o/r@' || s AS source, strftime(o_orderdate, '%Y-%m-%d') AS valid_from FROM (SELECT *, o_orderkey || '-0123456789abcdef' AS s FROM orders) WHERE o_orderkey % 10 <> 0"""
)
def commit_leafs(spark, d):
    return G.as_leafs(G.log(commits(spark, d))).select("text", "source", "valid_from")


@query("SELECT o_orderkey || '-0123456789abcdef' AS id FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, id LIMIT 50")
def commit_log(spark, d):
    return G.log(commits(spark, d), "1997-01-01", 50).select("id")


@query("SELECT c_custkey || '.md' AS path FROM customer WHERE c_custkey % 4 IN (1, 2, 3) AND NOT (c_custkey % 4 = 3 AND c_custkey % 8 <> 3)")
def changed_paths(spark, d):
    """Removed (1), added (2) and, of those in both trees (0 and 3), changed ones (3 of every 8)."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    tree = lambda keep, h: c.where(keep).select(F.concat(k.cast("string"), F.lit(".md")).alias("path"), h.alias("hash"))
    return G.changed_files(tree(k % 4 != 2, F.lit("h")), tree(k % 4 != 1, F.when(k % 8 == 3, "i").otherwise("h")))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'o/' || lower(replace(n_name, ' ', '')) WHEN 1 THEN 'team/r' ELSE 'folder' END AS name FROM nation")
def repo_names(spark, d):
    k = F.col("n_nationkey")
    origin = F.when(k % 3 == 0, F.concat(F.lit("git@h.org:o/"), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".git"))).when(k % 3 == 1, "https://h.org/team/r.git/").otherwise("")
    return table(spark, d, "nation").select("n_nationkey", G.repo_name(origin, F.lit("/x/folder/")).alias("name"))


@query("SELECT o_orderkey, 'feat: ' || o_orderpriority AS subject FROM orders")
def first_lines(spark, d):
    return commits(spark, d).select(F.split_part("id", F.lit("-"), F.lit(1)).cast("long").alias("o_orderkey"), X.first_line(F.col("message")).alias("subject"))


# --- scalars --------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS since, strftime(to_timestamp(o_orderkey * 1000)::TIMESTAMP, '%Y-%m-%d') AS day FROM orders")
def times_read(spark, d):
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    shown = lambda c, p: F.date_format(c, p)
    return table(spark, d, "orders").select("o_orderkey", shown(X.since(written), "yyyy-MM-dd HH:mm:ss").alias("since"), shown(X.from_millis((F.col("o_orderkey") * 1000000).cast("string")), "yyyy-MM-dd").alias("day"))


@query(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 9 WHEN 0 THEN DATE '2024-03-15' WHEN 1 THEN DATE '2024-03-14' WHEN 2 THEN DATE '2024-03-10' WHEN 3 THEN DATE '2024-03-03' WHEN 4 THEN DATE '2024-03-08' WHEN 5 THEN DATE '2024-03-14'
      WHEN 6 THEN NULL ELSE CASE WHEN m > DATE '2024-03-15' THEN m - INTERVAL 1 YEAR ELSE m END END, '%Y-%m-%d') || CASE o_orderkey % 9 WHEN 7 THEN ' 09:05' ELSE ' 15:07' END AS at
      FROM (SELECT *, make_date(2024, month(o_orderdate), least(day(o_orderdate), 28)) AS m FROM orders)"""
)
def clock_times(spark, d):
    """Seen on a Friday at noon: days, weeks, the same weekday with a later clock, another weekday, no header, months."""
    k = F.col("o_orderkey") % 9
    header = F.element_at(F.array(*map(F.lit, ("TODAY", "YESTERDAY", "THIS WEEK", "LAST WEEK", "FRIDAY", "THURSDAY", "some day"))), F.least(k + 1, F.lit(7)).cast("int"))
    header = F.when(k < 7, header).otherwise(F.concat(F.upper(F.date_format("o_orderdate", "MMM")), F.lit(" "), F.least(F.dayofmonth("o_orderdate"), F.lit(28)).cast("string")))
    at = L.clock_time(header, F.when(k == 7, "9:05 AM").otherwise("3:07 PM"), F.lit("2024-03-15 12:00:00").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text || chr(10) || ' ' || chr(10) || chr(10) || 'end', '(\n[ \t]*){3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS normal FROM documents""")
def markdown_normalised(spark, d):
    body = F.concat(F.translate("text", "", ""), F.lit("\n \n\n​en\x00d­"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normal_markdown(body), 256).alias("normal"))


STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'),
  '<style[^>]*>.*?</style>', '', 'gis'), '<br\s*/?>', chr(10), 'gi'), '</p>', chr(10) || chr(10), 'gi'), '<[^>]+>', '', 'gs')"""
PLAIN = f"""replace(replace(replace(replace(replace(replace(replace(replace(replace({STRIPPED}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&#34;', '"'), '&#x27;', ''''), '&amp;', '&')"""
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"SELECT page_id, sha256(CASE WHEN page_id % 3 = 0 THEN 'plain' ELSE trim({PLAIN}, {SPACE}) END) AS body FROM pages")
def body_choice(spark, d):
    plain = F.when(F.col("page_id") % 3 == 0, " plain\n").otherwise(" \n")
    return table(spark, d, "pages").select("page_id", F.sha2(X.body_markdown(plain, F.col("html")), 256).alias("body"))


@query("SELECT c_custkey, c_name || 'é' AS name FROM customer")
def bytes_decoded(spark, d):
    name = F.concat("c_name", F.lit("é"))
    raw = F.when(F.col("c_custkey") % 2 == 0, F.encode(name, "ISO-8859-1")).otherwise(F.encode(name, "UTF-8"))
    return table(spark, d, "customer").select("c_custkey", X.decode_bytes(raw).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '"' || c_name || '"' WHEN 1 THEN c_mktsegment ELSE '""' END AS value FROM customer""")
def yaml_scalars(spark, d):
    value = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise("")
    return table(spark, d, "customer").select("c_custkey", X.yaml_scalar(value).alias("value"))


@query("SELECT event_id, event_id % 3 = 0 AS leak, event_id % 5 < 2 AS transient FROM events")
def answer_predicates(spark, d):
    k = F.col("event_id")
    content = F.when(k % 3 == 0, F.concat(F.lit("so <Tool_Call name="), "event_type", F.lit(">"))).otherwise(F.concat("event_type", F.lit(" <b>")))
    error = F.when(k % 5 == 0, "HTTP 503 busy").when(k % 5 == 1, "read Timed Out").otherwise("no such file")
    return table(spark, d, "events").select("event_id", X.xml_leak(content).alias("leak"), P.transient(error).alias("transient"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 100 ELSE turn % 4 END::BIGINT AS cap, role || ' ' || turn AS q, turn % 3 = 0 AS header, turn % 2 = 0 AS calendar FROM conversations")
def small_scalars(spark, d):
    t = F.col("turn")
    line = F.when(t % 3 == 0, F.when(t % 2 == 0, "Monday").otherwise("JAN 12")).otherwise(F.concat("role", F.lit(" 12")))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.message_cap(t % 4).cast("long").alias("cap"), X.joined_words(F.array(F.col("role"), t.cast("string"))).alias("q"),
        P.day_header(line).alias("header"), P.calendar_file(F.when(t % 2 == 0, "A.ICS").otherwise("a.ics.txt")).alias("calendar"),
    )


# --- mail -----------------------------------------------------------------------------------------------------------------


@query(
    """SELECT conv_id, turn, '---' || chr(10) || 'id: "<' || conv_id || '>"' || chr(10) || 'folder: "in\\\\box"' || chr(10) || 'source: "imap"' || chr(10) || 'subject: "' || CASE WHEN turn % 3 = 0 THEN '' ELSE '\\"' || role || '\\" ' || turn END || '"' || chr(10)
      || 'from: "a: ' || role || '"' || chr(10) || 'to: "b@x"' || chr(10) || 'date: "2024-01-02"' || chr(10) || 'type: mail' || chr(10) || '---' || chr(10) || chr(10) || '# ' || CASE WHEN turn % 3 = 0 THEN '(no subject)' ELSE '"' || role || '" ' || turn END || chr(10) || chr(10)
      || coalesce(text, '') || chr(10) AS markdown FROM conversations"""
)
def mail_markdown(spark, d):
    subject = F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit('"'), "role", F.lit('" '), F.col("turn").cast("string")))
    key = F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit(">"))
    body = M.message_markdown(F.col("text"), id=key, folder=F.lit("in\\box"), source=F.lit("imap"), subject=subject, sender=F.concat(F.lit("a: "), "role"), to=F.lit("b@x"), date=F.lit("2024-01-02"))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("markdown"))


LETTERS = "trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g'))"


@query(f"SELECT 'Subject: ' || conv_id || '.' || turn AS subject, sha256({LETTERS} || chr(10) || 'From here on' || chr(10) || 'end') AS body FROM conversations")
def mbox_messages(spark, d):
    """Mailboxes written from the conversations, split again: a quoted line, and one that only looks like a separator at first."""
    head = F.concat(F.lit("From a@x Mon Jan 1 10:00:00 2024\r\nSubject: "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("\r\n\r\n"))
    body = F.concat(F.trim(F.regexp_replace(X.text(F.col("text")), "[^a-z]+", " ")), F.lit("\n>From here on\nend"))
    place = f"{shared_dir(spark)}/mbox-{uuid.uuid4().hex}"
    table(spark, d, "conversations").select(F.concat(head, body).alias("value")).write.text(place)
    got = F.rtrim(F.col("message"), F.lit("\n"))
    return M.split_mbox(spark, place).select(F.substring_index(got, "\n", 1).alias("subject"), F.sha2(F.regexp_replace(got, r"^[^\n]*\n\n", ""), 256).alias("body"))


@query(
    """SELECT 'n' || s_nationkey || '/s' || s_suppkey || '.md' AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'old ' ELSE 'new ' END || s_name AS content,
      (SELECT count(*) FROM supplier WHERE s_suppkey % 2 <> 0) AS ok, (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS skip, 1::BIGINT AS fail FROM supplier"""
)
def named_files(spark, d):
    """Files of half of the suppliers, then of all and of an unusable name: those that are there stay."""
    place = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".md"))
    rows = lambda word: table(spark, d, "supplier").select(name.alias("name"), F.concat(F.lit(word), "s_name").alias("content"), "s_suppkey")
    B.save_files(rows("old ").where("s_suppkey % 2 = 0"), place)
    counts = B.save_files(rows("new ").select("name", "content").union(spark.range(1).select(F.lit("../up"), F.lit("x"))), place)
    files = B.contents(B.walked(spark, place).where(F.col("path").endswith(".md")).select("path"), place)
    return files.select(F.col("path").alias("name"), F.col("content").cast("string").alias("content"), *[F.lit(v).cast("long").alias(k) for k, v in counts.items()])


@query(
    """SELECT 's' || s_suppkey AS dir, '---' || chr(10) || 'id: "' || s_suppkey || '"' || chr(10) || 'folder: "in"' || chr(10) || 'source: "imap"' || chr(10) || 'subject: "' || s_name || '"' || chr(10) || 'from: ""' || chr(10)
      || 'to: ""' || chr(10) || 'date: "2024-01-03"' || chr(10) || 'type: mail' || chr(10) || '---' || chr(10) || chr(10) || '# ' || s_name || chr(10) || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'plain' ELSE 'a & b' END || chr(10) AS markdown,
      'nation ' || s_nationkey AS attached, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0) AS ok, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 = 0) AS fail FROM supplier WHERE s_suppkey % 7 <> 0"""
)
def stored_messages(spark, d):
    """message.json of every supplier with an attachment, some of them broken, turned into message.md and the attachment's text."""
    place, key = f"{shared_dir(spark)}/mail-{uuid.uuid4().hex}", F.col("s_suppkey").cast("string")
    fields = F.to_json(F.struct(
        key.alias("id"), F.lit("in").alias("folder"), F.lit("imap").alias("source"), F.col("s_name").alias("subject"), F.lit("2024-01-02T23:30:00-02:00").alias("date"),
        F.when(F.col("s_suppkey") % 2 == 0, " plain ").alias("textBody"), F.lit("<p>a &amp; b</p>").alias("htmlBody"),
        F.array(F.struct(F.lit("a.txt").alias("fileName"), F.lit("01.txt").alias("storedName"), F.lit("text/plain").alias("contentType"))).alias("attachments"),
    ))
    s, dir_ = table(spark, d, "supplier"), F.concat(F.lit("s"), key)
    parts = F.array(F.struct(F.concat(dir_, F.lit("/message.json")).alias("name"), F.when(F.col("s_suppkey") % 7 == 0, "{").otherwise(fields).alias("content")), F.struct(F.concat(dir_, F.lit("/attachments/01.txt")).alias("name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("content")))
    B.save_files(s.select(F.inline(parts)), place)
    counts = B.convert_messages(spark, place)
    files = B.walked(spark, place)
    at = lambda name, value: B.contents(B.named(files, name).select("path"), place).select(F.regexp_extract("path", "^(s[0-9]+)/(?:attachments/)?[^/]+$", 1).alias("dir"), F.col("content").cast("string").alias(value))
    return at("message.md", "markdown").join(at("a.txt.md", "attached"), "dir").select("*", F.lit(counts["ok"]).cast("long").alias("ok"), F.lit(counts["fail"]).cast("long").alias("fail"))


@query(
    f"""SELECT doc_id, sha256(CASE WHEN text IS NULL THEN '<!-- attachment: f' || doc_id || (CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.json' WHEN 2 THEN '.bin' ELSE '.eml' END) || ' (unknown size) -->'
      WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '```' || chr(10) || text || chr(10) || '```'
      WHEN doc_id % 4 = 2 THEN '<!-- attachment: f' || doc_id || '.bin (' || strlen(text) || ' bytes) -->' ELSE {LETTERS} END) AS shown FROM documents"""
)
def attachment_texts(spark, d):
    """Every document as an attachment: plain text, a structured one, one that is only described, a message."""
    k = F.col("doc_id") % 4
    pick = lambda *of: F.when(k == 0, of[0]).when(k == 1, of[1]).when(k == 2, of[2]).otherwise(of[3])
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), pick(".txt", ".json", ".bin", ".eml"))
    media = pick("text/plain", "application/json", "application/octet-stream", "application/octet-stream")
    mail = F.concat(F.lit("Subject: x\r\nContent-Type: text/plain\r\n\r\n"), F.trim(F.regexp_replace("text", "[^a-z]+", " ")))
    content = F.encode(F.when(k == 3, mail).otherwise(F.col("text")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.sha2(B.attachment_markdown(name, media, content), 256).alias("shown"))


@query("SELECT '<' || conv_id || '.' || turn || '>' AS id, role AS subject, '2024-01-02' AS day, sha256(trim(regexp_replace(coalesce(text, ''), '[^a-z]+', ' ', 'g'))) AS body, 'a.bin' AS attachment FROM conversations")
def mime_messages(spark, d):
    """Raw messages of two parts, with an offset that moves the day."""
    key = F.concat(F.lit("<"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit(">"))
    head = F.concat(F.lit("Message-ID: "), key, F.lit("\r\nSubject: "), "role", F.lit("\r\nDate: Mon, 01 Jan 2024 23:30:00 -0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=zzz\r\n\r\n--zzz\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"))
    tail = F.lit("\r\n--zzz\r\nContent-Type: application/x-y\r\nContent-Disposition: attachment; filename=a.bin\r\n\r\nabc\r\n--zzz--\r\n")
    plain = F.trim(F.regexp_replace(X.text(F.col("text")), "[^a-z]+", " "))
    raw = table(spark, d, "conversations").select(key.alias("path"), F.encode(F.concat(head, plain, tail), "UTF-8").alias("content"))
    got = M.messages(raw)
    return got.select(F.concat(F.lit("<"), "id", F.lit(">")).alias("id"), "subject", "day", F.sha2(X.trimmed(F.col("text")), 256).alias("body"), F.get("attachments", F.lit(0))["name"].alias("attachment"))


@query("SELECT 'f' || user_id % 5 AS folder, CASE WHEN user_id % 5 = 2 THEN 'old' ELSE 'link' || max(event_id) END AS link FROM events GROUP BY user_id % 5")
def delta_links(spark, d):
    """events as pages of five folders; of folder f2 nothing was taken, others have all; the last page counts, not the largest link."""
    f = F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"))
    pages = table(spark, d, "events").select(
        f.alias("folder"), F.col("event_id").alias("page"), F.lit("old").alias("old_link"), F.concat(F.lit("link"), F.col("event_id").cast("string")).alias("delta_link"),
        F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "deleted").alias("removed"))).alias("value"),
    )
    return M.delta_links(pages, M.delta_ids(pages).where("folder <> 'f2'"))


@query("SELECT DISTINCT 'f' || user_id % 5 AS folder, event_id::VARCHAR AS id FROM events WHERE event_type <> 'error'")
def delta_ids(spark, d):
    f = F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string"))
    value = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "deleted").alias("removed")))
    return M.delta_ids(table(spark, d, "events").select(f.alias("folder"), value.alias("value")))


@query("SELECT n_name AS name FROM nation WHERE n_name NOT IN ('FRANCE', 'CHINA')")
def mail_folders(spark, d):
    return M.folders(table(spark, d, "nation").select(F.col("n_name").alias("name")), ["France", "china"])


@query("SELECT role AS source, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) BETWEEN 4 AND 13")
def per_source_page(spark, d):
    return T.per_source(table(spark, d, "conversations").select(F.col("role").alias("source"), "conv_id", "turn"), 3, 10, "conv_id", "turn")


# --- social and chats -----------------------------------------------------------------------------------------------------


@query("SELECT conv_id AS chat_id, turn, CASE WHEN trim(coalesce(text, '')) = '' THEN '[image]' ELSE text END AS text FROM conversations WHERE role <> 'system' AND turn % 5 <> 0 AND conv_id <> 777000")
def incoming_messages(spark, d):
    c = table(spark, d, "conversations")
    m = c.select("conv_id", F.col("conv_id").cast("string").alias("chat_id"), "turn", F.when(F.col("role") == "system", "bot").otherwise("user").alias("kind"), (F.col("turn") % 5 == 0).alias("outgoing"), "text", F.lit("image").alias("media"))
    return L.incoming(m).select(F.col("conv_id").alias("chat_id"), "turn", "text")


@query(
    """SELECT n_nationkey::VARCHAR AS chat_id, unnest([1, 2, 4]) AS seq, unnest(['MONDAY', 'TODAY', 'AUG 3']) AS day, unnest(['9:05 AM', '9:05 AM', '1:00 PM']) AS clock, unnest(['Ann', 'Ann', 'Bo']) AS sender,
    unnest(['hello' || chr(10) || 'there ' || n_nationkey, n_name || chr(10) || 'still today', 'hi']) AS text FROM nation"""
)
def conversation_pages(spark, d):
    """A day's header ends a message, the same one again doesn't; stray lines and headings with a time belong to none; the third message is empty."""
    key = F.col("n_nationkey").cast("string")
    mark = "Ann (she) sent the following messages at 9:05 AM\n"
    body = F.concat(
        F.lit(f"before\nMONDAY\n{mark}View Ann's profile\nAnn (she) (She/Her) 9:05 AM\nhello\nthere "), key, F.lit(f"\nTODAY\nstray\n{mark}"), "n_name",
        F.lit("\nTODAY\n\nstill today\nAUG 3\nBo sent the following message at 8:00 AM\nBo 8:00 AM\nBo sent the following message at 1:00 PM\nhi\nSUNDAY\nstray\n"),
    )
    return L.conversation(table(spark, d, "nation").select(key.alias("chat_id"), body.alias("body"))).select("chat_id", F.col("seq").cast("int").alias("seq"), "day", "clock", F.col("from").alias("sender"), "text")


@query("SELECT 'abcd' || n_nationkey AS chat_id, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def inbox_pages(spark, d):
    k = F.col("n_nationkey")
    url = F.when(k % 3 == 0, "https://x.org/messaging/thread/").otherwise(F.concat(F.lit("https://x.org/messaging/thread/abcd"), k.cast("string"), F.lit("/?a=1")))
    body = F.concat(F.lit('{"url": "u", "sections": {}, "references": {"inbox": [{"kind": "conversation", "url": "'), url, F.lit('", "text": "'), "n_name", F.lit(' (x)"}, {"kind": "person", "url": "https://x.org/messaging/thread/zzzz9"}]}}'))
    return L.inbox(table(spark, d, "nation").select(body.alias("value")))


# --- web, reports and evidence --------------------------------------------------------------------------------------------


@query(
    r"""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank FROM conversations WHERE turn % 2 = 0), s AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS q FROM r WHERE rank <= 5)
    SELECT c.conv_id, CASE WHEN s.rank IS NULL THEN 'throttled' ELSE 'ok' END AS status, s.rank::INT AS rank, 'u' || s.turn AS url, CASE WHEN length(q) > 150 THEN rtrim(substr(q, 1, 150)) || '...' ELSE q END AS snippet FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id)"""
)
def web_projection(spark, d):
    one = F.struct("turn", "text")
    listed = F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == 0, one)))
    as_results = F.transform(listed, lambda x: F.struct(F.lit("t").alias("title"), F.concat(F.lit("u"), x["turn"].cast("string")).alias("url"), x["text"].alias("content"), F.lit("e").alias("engine")))
    p = table(spark, d, "conversations").groupBy("conv_id").agg(as_results.alias("results")).select(F.col("conv_id").alias("query"), "results", F.array(F.array(F.lit("e"), F.lit("slow"))).alias("unresponsive_engines"))
    return W.project(p).select(F.col("query").alias("conv_id"), "status", "rank", "url", F.when(F.col("rank").isNotNull(), F.col("snippet")).alias("snippet"))


@query("SELECT user_id::VARCHAR AS key, max(epoch_us(ts)) AS fetched FROM events GROUP BY user_id")
def cache_put(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("fetched"), F.col("event_id").alias("value"))
    return W.put(rows.where("value % 2 = 0"), rows.where("value % 2 <> 0")).select("key", "fetched")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 4 <> 0 AND (user_id % 2 = 1 OR event_type = 'click')) AS n_ok, count(*) FILTER (WHERE event_id % 10 = 0) AS n_leaks FROM events")
def tool_report(spark, d):
    k = F.col("event_id")
    calls = F.when(k % 4 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"function": {"name": "'), "event_type", F.lit('", "arguments": "{}"}}]')))
    content = F.when(k % 10 == 0, "<invoke name=x>").otherwise("fine")
    e = table(spark, d, "events").select(k.alias("prompt"), F.concat(F.lit('{"choices": [{"message": {"tool_calls": '), calls, F.lit(', "content": "'), content, F.lit('"}}]}')).alias("body"), F.when(F.col("user_id") % 2 == 0, "click").otherwise(F.col("event_type")).alias("wanted"))
    return T.tool_report(T.tool_calls(e), e.select("prompt", "wanted"))


@query("SELECT n_name AS name, n_nationkey * 3::BIGINT AS mib FROM nation")
def memory_report(spark, d):
    body = F.concat(F.lit('{"models": [{"name": "'), "n_name", F.lit('", "size": '), (F.col("n_nationkey").cast("long") * 3145728 + 5).cast("string"), F.lit("}]}"))
    return T.process_memory(table(spark, d, "nation").select(body.alias("value"))).select("name", F.col("mib").cast("long").alias("mib"))


@query("SELECT CASE event_type WHEN 'error' THEN 'fail' WHEN 'view' THEN 'skip' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def import_statuses(spark, d):
    return T.statuses(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").otherwise("ok").alias("status")))


@query("SELECT CASE WHEN event_id % 100 < 25 THEN 'get' WHEN event_id % 100 < 75 THEN 'search' ELSE 'stats' END AS endpoint, count(*) AS n FROM events GROUP BY 1")
def request_picks(spark, d):
    return T.weighted_pick(table(spark, d, "events"), {"search": 2, "get": 1, "stats": 1}, (F.col("event_id") % 100) / 100.0).groupBy("endpoint").agg(F.count("*").alias("n"))


@query("SELECT event_id, round((event_id % 50 - min(event_id % 50) OVER (PARTITION BY event_type)) * 255.0::DOUBLE / nullif(max(event_id % 50) OVER (PARTITION BY event_type) - min(event_id % 50) OVER (PARTITION BY event_type), 0)) AS stretched FROM events")
def luminance_stretch(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 50).cast("double").alias("v"))
    return T.stretched(e, "v", "event_type").select("event_id", "stretched")


@query("SELECT max(ts)::DATE::VARCHAR AS stamp, count(*) AS n FROM events")
def corpus_fingerprint(spark, d):
    return K.fingerprint(table(spark, d, "events").select(F.col("ts").alias("modified"))).select(F.date_format("stamp", "yyyy-MM-dd").alias("stamp"), "n")


@query("SELECT n_name AS text, 1::BIGINT AS n_yes, n_nationkey % 2::BIGINT AS n_no FROM nation")
def claims_read(spark, d):
    k = F.col("n_nationkey")
    source = '{"id": "a", "kind": "config", "when": "", "stale": false}'
    one = F.concat(F.lit('{"text": "'), "n_name", F.lit(f'", "yes": [{source}], "no": ['), F.when(k % 2 == 1, F.lit(source)).otherwise(""), F.lit("]}"))
    body = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"claims": ['), one, F.lit("]}")))
    return E.claims_of(table(spark, d, "nation").select(body.alias("value"))).select("text", F.size("yes").cast("long").alias("n_yes"), F.size("no").cast("long").alias("n_no"))


@query("SELECT n_name AS text, 's' AS source, 'facts' AS root, 'confirmed' AS confidence, 'extract' AS how, 'fact' AS type FROM nation WHERE n_nationkey % 4 <> 0")
def facts_read(spark, d):
    k = F.col("n_nationkey")
    one = F.concat(F.lit('{"text": "'), F.when(k % 4 == 0, " ").otherwise(F.col("n_name")), F.lit('", "source": "s"}'))
    body = F.when(k % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"facts": ['), one, F.lit("]}")))
    return K.facts_of_json(table(spark, d, "nation").select(body.alias("value"))).select("text", "source", "root", "confidence", "how", "type")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def message_days(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "receivedDate").when(k % 3 == 1, "receivedAt").otherwise("date")
    body = F.concat(F.lit('{"'), name, F.lit('": "'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}'))
    return table(spark, d, "orders").select("o_orderkey", K.message_day(body).alias("day"))


@query("""SELECT c_custkey, '  - source: "' || c_name || '"' || chr(10) || '    text: |-' || chr(10) || '      a' || chr(10) || '      ' || c_mktsegment AS item FROM customer""")
def leaf_items(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("source"), F.concat(F.lit("a\n"), "c_mktsegment").alias("text"))
    return c.select("c_custkey", V.leaf_yaml("source", "text").alias("item"))
