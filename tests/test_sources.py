import json
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from marlspike.plans.engine import Engine, dispatch, openapi, tools
from marlspike.sources import contacts, corpus, git, mail, outbox, runtime, social, web
from marlspike.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_corpus(spark, tmp_path):
    write(tmp_path / "docs/a.md", "# T\n## A\nx")
    write(tmp_path / "docs/keys/b.md", "# T\n## B\ny")
    write(tmp_path / "docs/c.yaml", "k: v\n" * 9000)
    write(tmp_path / "README.md", "# R\nz")
    got = {r["heading"]: r for r in corpus.corpus(spark, str(tmp_path / "docs"), "r").collect()}
    assert {*got} == {"A", "c"} and got["A"]["text"].startswith("A\n\nT") and len(got["c"]["text"]) == corpus.YAML_BYTES
    assert corpus.default_corpus(spark, str(tmp_path)).count() == 2 and corpus.corpus(spark, str(tmp_path / "none")).isEmpty()


def test_mail_leafs(spark, tmp_path):
    for m, day in (("m1", "2024-01-05"), ("m2", "2024-02-05")):
        write(tmp_path / m / "message.md", f"---\ndate: {day}T10:00:00Z\n---\n# S\nbody {m}")
        write(tmp_path / m / "attachments/a.md", "# At\ntext")
    assert corpus.mail_leafs(spark, str(tmp_path)).count() == 4
    assert {r["valid_from"] for r in corpus.mail_leafs(spark, str(tmp_path), limit=1).collect()} <= {"2024-02-05", ""}
    assert corpus.mail_leafs(spark, str(tmp_path), since="2024-02-01").count() == 2


def test_json_leafs(spark):
    one = {"text": "t", "source": "s", "embedding": [1.0]}
    df = spark.createDataFrame([(json.dumps(x),) for x in (one, [one, {"text": "x"}], {"leafs": [one]}, {"facts": [one]})], "value string")
    assert corpus.leafs_of_json(df).count() == 3 and corpus.facts_of_json(df).where("confidence = 'confirmed'").count() == 3


def test_chat_lines(spark, tmp_path):
    write(tmp_path / "c1.jsonl", '{"id": "1", "text": "a"}\n\nnot json\n{"id": "2", "text": "b"}\n')
    assert [(r["chat_id"], r["id"]) for r in corpus.chat_lines(spark, str(tmp_path)).orderBy("seq").collect()] == [("c1", "1"), ("c1", "2")]


def test_contacts(spark, tmp_path):
    write(tmp_path / "g.csv", "Name,Given Name,E-mail 1 - Value,E-mail 2 - Value,Phone 1 - Value\nAnn Lee,Ann,a@x,b@x,123\nBo\n")
    write(tmp_path / "v.vcf", "BEGIN:VCARD\nVERSION:2.1\nN:Lee;Cy;;;\nTEL;HOME:555\nEND:VCARD\nBEGIN:VCARD\nVERSION:3.0\nFN:Di\\, X\nEMAIL;TYPE=HOME:d@x\nEND:VCARD\nBEGIN:VCARD\nEND:VCARD\n")
    write(tmp_path / "sub/m.mab", "<(80=FirstName)(81=PrimaryEmail)>\n<(90=Ed)(91=e$40x)>\n{1:^80 [1(^80^90)(^81^91)]}")
    got = {r["given"] or r["full_name"]: r for r in contacts.load(spark, str(tmp_path)).collect()}
    assert {*got} == {"Ann", "Bo", "Cy", "Di, X", "Ed"} and got["Ann"]["emails"] == ["a@x", "b@x"] and got["Cy"]["phones"] == ["555"] and got["Ed"]["emails"] == ["e@x"]
    assert contacts.mork_unquote("a\\)b$C3$A9") == "a)bé"
    assert contacts.dedupe(contacts.load(spark, str(tmp_path / "g.csv")).union(contacts.load(spark, str(tmp_path / "g.csv")))).count() == 2
    assert "Contact: Ann Lee" in contacts.as_leafs(contacts.load(spark, str(tmp_path / "g.csv"))).orderBy("source").first()["text"]


EML = b"Message-ID: <m@x>\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nFrom: a@x\r\nDate: Mon, 01 Jan 2024 23:30:00 -0200\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nhello\r\n--B\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=a.csv\r\n\r\n1,2\r\n--B--\r\n"


def test_messages(spark):
    r = mail.messages(spark.createDataFrame([("k", bytearray(EML))], "path string, content binary")).first()
    assert (r["id"], r["subject"], r["day"], r["text"].strip()) == ("m@x", "Grüße", "2024-01-02", "hello") and [a["name"] for a in r["attachments"]] == ["a.csv"]


def test_mbox(spark, tmp_path):
    p = write(tmp_path / "x.mbox", "From a@x Mon Jan 1 2024\nSubject: 1\n\nFrom here on\n>From me\nFrom b@x Tue Jan 2 2024\nSubject: 2\n")
    got = [r["message"] for r in mail.split_mbox(spark, p).orderBy("n").collect()]
    assert got == ["Subject: 1\n\nFrom here on\nFrom me", "Subject: 2\n"]


def test_mbox_is_read_by_byte_ranges(spark, tmp_path):
    """Messages cut by ranges of some 200 bytes equal the ones of a plain scan: lone and doubled separators, CRLF, quoted lines, both ends of a file."""
    bodies = ["", "x", ">From me\n>>From you", "line " * 30 + "\nFrom here on", "a\r\nb\n\n", "ü€𝕏 " * 20, "\n\n"] * 9
    texts = {"a": "junk\nmore\n", "b": "", "c": "", "d": "\ufeffnote\n"}
    for k in texts:
        texts[k] += "".join(f"From a{i}@x Mon Jan 1 2024\nSubject: {k}{i}\n\n{x}\n" for i, x in enumerate(bodies))
    texts["b"] = texts["b"].rstrip("\n") + "\nlast"
    texts["e"], texts["f"] = "no separator\n", ""
    for k, t in texts.items():
        (tmp_path / f"{k}.mbox").write_bytes(t.encode())

    def plain(t):
        out = []
        for line in t.split("\n"):
            line = line.rstrip("\r")
            if re.match(mail.SEPARATOR, line):
                out.append([])
            elif out:
                out[-1].append(re.sub("^>(>*From )", r"\1", line))
        return ["\n".join(x) for x in out]

    want = {(k, i + 1): m for k, t in texts.items() for i, m in enumerate(plain(t))}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("200", "3000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {(r["file"].rsplit("/", 1)[1][0], r["n"]): r["message"] for r in mail.split_mbox(spark, str(tmp_path)).collect()}
            assert got == want
            if size == "200":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_calendar(spark):
    ics = "BEGIN:VCALENDAR\r\nMETHOD:REPLY\r\nBEGIN:VEVENT\r\nSUMMARY:Talk\r\nDTSTART;TZID=W. Europe:20240102T103000\r\nDTEND;VALUE=DATE:20240103\r\nATTENDEE;PARTSTAT=ACCEPTED:mailto:a@x\r\nEND:VEVENT\r\nEND:VCALENDAR"
    got = spark.range(1).select(mail.calendar_markdown(F.lit(ics)).alias("a"), mail.calendar_markdown(F.lit("plain\n\n\n\ntext")).alias("b")).first()
    assert got["a"] == "method: REPLY\n\n## Talk\n- when: 2024-01-02 10:30 W. Europe to 2024-01-03\n- attendees: a@x (accepted)" and got["b"] == "plain\n\ntext"


def test_delta_links_move_only_when_all_is_taken(spark):
    schema = "folder string, old_link string, delta_link string, value array<struct<id:string,removed:string>>"
    pages = spark.createDataFrame([("f", "old", "new", [("1", None), ("2", "deleted")]), ("g", "old", "new", [("3", None)])], schema)
    taken = spark.createDataFrame([("f", "1")], "folder string, id string")
    assert {r["folder"]: r["link"] for r in mail.delta_links(pages, taken).collect()} == {"f": "new", "g": "old"}


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q")
    write(tmp_path / "a.txt", "1")
    run("add", ".")
    run("commit", "-qm", "feat: one\n\nbody")
    c = git.log(git.commits(spark, [str(tmp_path)]))
    row = c.first()
    assert row["files"] == ["a.txt"] and git.as_leafs(c).first()["text"].endswith("\nChanging: a.txt") and " — feat: one\nAuthor: " in git.as_leafs(c).first()["text"] and git.as_leafs(c).first()["source"].endswith(row["id"])
    name = spark.range(1).select(git.repo_name(F.lit("git@h:o/r.git"), F.lit("/x/y")).alias("a"), git.repo_name(F.lit(""), F.lit("/x/y/")).alias("b")).first()
    assert (name["a"], name["b"]) == ("o/r", "y")


def test_social(spark):
    page = {"url": "u", "sections": {}, "references": {"inbox": [{"kind": "conversation", "url": "https://h/thread/2-abc=/", "text": "Ann (x)"}, {"kind": "conversation", "url": "https://h/thread/"}, {"kind": "person", "url": "https://h/in/x"}]}}
    assert [tuple(r) for r in social.inbox(spark.createDataFrame([(json.dumps(page),)], "value string")).collect()] == [("2-abc=", "Ann")]
    body = "MONDAY\nAnn sent the following message at 10:05 AM\nView Ann's profile\nAnn 10:05 AM\nhello\nyou\nAUG 3\nBo sent the following messages at 1:00 PM\nhi"
    got = [tuple(r) for r in social.conversation(spark.createDataFrame([("c", body)], "chat_id string, body string")).select("day", "clock", "from", "text").orderBy("seq").collect()]
    assert got == [("MONDAY", "10:05 AM", "Ann", "hello\nyou"), ("AUG 3", "1:00 PM", "Bo", "hi")]
    now = F.lit("2024-08-07 12:00:00").cast("timestamp")  # a Wednesday
    at = spark.range(1).select(*[social.clock_time(F.lit(d), F.lit("1:30 PM"), now).cast("string").alias(d) for d in ("TODAY", "MONDAY", "WEDNESDAY", "AUG 3", "DEC 1", "THIS WEEK", "LAST WEEK")]).first()
    assert list(at) == ["2024-08-07 13:30:00", "2024-08-05 13:30:00", "2024-07-31 13:30:00", "2024-08-03 13:30:00", "2023-12-01 13:30:00", "2024-08-04 13:30:00", "2024-07-28 13:30:00"]
    earlier = spark.range(1).select(social.clock_time(F.lit("WEDNESDAY"), F.lit("9:00 AM"), now).cast("string")).first()[0]
    assert earlier == "2024-08-07 09:00:00"


def test_web():
    now, calls = [100.0], []

    def fetch(q):
        calls.append(q)
        return {"results": [{"title": q}]} if q != "none" else {"results": [], "unresponsive_engines": [["e", "captcha"]]}

    look = web.Lookup(fetch, web.private_reason, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert look("id 1234567")["status"] == "refused" and look("x", allowed=False)["status"] == "skipped" and not calls
    assert look("Hello  World")["status"] == "ok" and look("hello world")["cached"] and len(calls) == 1
    assert look("none")["note"] == "e: captcha" and now[0] == 110.0
    now[0] += web.TTL + 1
    assert not look("hello world")["cached"]


def test_web_projection(spark):
    df = spark.createDataFrame([("q", [("t", "u", "a  b", "e")], []), ("r", [], [["e", "slow"]])], web.PAYLOAD)
    assert [tuple(r) for r in web.project(df).select("query", "status", "rank", "snippet", "note").orderBy("query").collect()] == [("q", "ok", 1, "a b", ""), ("r", "throttled", None, "", "no result: e: slow")]


def test_runtime(spark):
    f = spark.createDataFrame([("/d/compose.yml", "version: 1\nservices:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  v:\n")], "path string, content string")
    declared = runtime.compose_services(f)
    assert {r["name"] for r in declared.collect()} == {"web", "db"}
    hosts = runtime.ssh_hosts(spark.createDataFrame([("Host web b *\n  User x\nhost c?\n",)], "content string"))
    assert [r["host"] for r in hosts.collect()] == ["b", "web"]
    running = spark.createDataFrame([("web", "/d"), ("zz", "/q")], "name string, dir string")
    docs = spark.createDataFrame([("a.md", "the B host"), ("b.md", "bb")], "path string, text string")
    assert {r["how"] for r in runtime.facts(running, declared, hosts, docs).collect()} == {"pair-compose", "pair-names", "pair-hosts", "pair-docs"}
    orgs = runtime.orgs(spark.createDataFrame([("orgs:\n- id: acme\n  label: Acme\n  kind: client\n- id: b\n  label: B\ntimeline:\n- id: c\n  label: C\n",)], "content string"))
    assert {(r["org"], r["label"], r["kind"]) for r in orgs.collect()} == {("acme", "Acme", "client"), ("b", "B", "")}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), lookup=lambda q: {"status": "ok"})
    e.ingest([{"text": "alpha beta", "source": "kb:a", "root": "facts", "confidence": "confirmed"}, {"text": "gamma", "source": "kb:b"}], "2024-01-01T00:00:00Z")
    out = e.search("alpha")
    assert len(out["hits"]) == 1 and out["second_source"] is None and e.search("gamma")["second_source"] == {"status": "ok"}
    assert e.get(out["hits"][0]["id"])["text"] == "alpha beta" and e.stats() == {"facts": 1, "info": 1, "total": 2} and len(e.audit()) == 2
    call = lambda m, **p: dispatch(e, {"id": 1, "method": m, "params": p})
    assert len(call("tools/list")["result"]["tools"]) == 3 == len(tools()) and "error" in call("tools/call", name="search", arguments={"q": "x", "limit": 0})
    assert "alpha" in call("tools/call", name="search", arguments={"q": "alpha"})["result"]["content"][0]["text"] and "/search" in openapi()["paths"]


def test_stream_into_store(spark, tmp_path):
    from marlspike.operators.store import Store

    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("t", "s"), ("u", "s")], "text string, source string")
    for _ in range(2):
        df.write.mode("append").json(str(src))
        ingest.start(ingest.stream(spark, str(src), df.schema, "json"), ingest.into_store(store, lambda: "2024-01-01T00:00:00Z"), str(tmp_path / "cp"), None).awaitTermination()
    assert store.read().count() == 2


def test_a_stream_of_files_keeps_the_last_row_of_an_id(spark, tmp_path):
    from marlspike.operators.store import Store

    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("t", "s", f"row {i}") for i in range(50)], "text string, source string, loc string").coalesce(1)
    df.write.json(str(src))
    ingest.start(ingest.stream(spark, str(src), df.schema, "json", ordered=True), ingest.into_store(store, lambda: "2024-01-01T00:00:00Z"), str(tmp_path / "cp"), None).awaitTermination()
    assert [r["loc"] for r in store.read().collect()] == ["row 49"]


def test_reindex_follows_edits_and_deletes(spark, tmp_path):
    from marlspike.operators.store import Store

    now, docs = "2024-01-01T00:00:00Z", tmp_path / "docs"
    for name, body in {"a.md": "# A\n\n## One\nfirst\n\n## Two\nsecond\n", "b.md": "# B\nbody\n", "sub/c.yaml": "key: value\n"}.items():
        write(docs / name, body)
    store = Store(spark, str(tmp_path / "store"))
    store.add(spark.createDataFrame([("by hand", "hand")], "text string, source string"), now)
    assert ingest.reindex(store, str(docs), now) == {"added": 3, "changed": 0, "removed": 0}
    store.index()
    at = store.current()
    assert not any(ingest.reindex(store, str(docs), now).values()) and store.current() == at
    write(docs / "a.md", "# A\n\n## One\nfirst\n\n## Three\nthird\n")
    write(docs / "d.md", "# D\nnew\n")
    (docs / "b.md").unlink()
    assert ingest.reindex(store, str(docs), now) == {"added": 1, "changed": 1, "removed": 1} and store.current() == at + 1
    again = Store(spark, str(tmp_path / "again"))
    again.add(spark.createDataFrame([("by hand", "hand")], "text string, source string"), now)
    ingest.reindex(again, str(docs), now)
    rows = lambda s: sorted(map(str, s.read().collect()))
    assert rows(store) == rows(again) and any("third" in x for x in rows(store)) and not any("second" in x or "body" in x for x in rows(store))
    found = lambda s: {(r["id"], r["score"]) for r in s.words().search("first third body new", 9).collect()}
    assert found(store) == found(again)


def test_listing_source_reads_and_streams_pages(spark, tmp_path):
    from marlspike.sources.listing import Listing

    spark.dataSource.register(Listing)
    write(tmp_path / "p/inbox/1.json", json.dumps({"folder": "inbox", "value": [{"id": "1"}, {"id": "2", "@removed": {"reason": "deleted"}}]}))
    assert [(r["folder"], r["id"]) for r in spark.read.format("mail-listing").load(str(tmp_path / "p")).collect()] == [("inbox", "1")]
    seen = []

    def run():
        q = spark.readStream.format("mail-listing").load(str(tmp_path / "p")).writeStream.foreachBatch(lambda b, _: seen.extend(r["id"] for r in b.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    write(tmp_path / "p/inbox/2.json", json.dumps({"folder": "inbox", "value": [{"id": "3"}]}))
    run()
    assert seen == ["1", "3"]


def test_waves_and_retries():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("timeout")
        return 7

    assert ingest.retried(flaky, 5, 1.0, 1.5, slept.append) == 7 and slept == [1.0, 1.5]
    assert ingest.wave([("a", lambda: 1), ("b", None), ("c", lambda: 1 / 0)]) == {"a": "ok", "b": "skipped", "c": "failed: division by zero"}


def test_sql_guard(spark):
    import pytest

    from marlspike.sources import sql

    for bad in ("drop table x", "select 1; delete from x"):
        with pytest.raises(ValueError):
            sql.query(spark, "jdbc:none", bad)
    with pytest.raises(ValueError):
        sql.sample(spark, "jdbc:none", "a; drop table b")


def test_late_pages_of_earlier_folders_and_ten_pages(spark, tmp_path):
    from marlspike.sources.listing import Listing

    spark.dataSource.register(Listing)
    page = lambda folder, n: write(tmp_path / f"p/{folder}/{n}.json", json.dumps({"folder": folder, "value": [{"id": f"{folder}{n}"}]}))
    seen = []

    def run():
        q = spark.readStream.format("mail-listing").load(str(tmp_path / "p")).writeStream.foreachBatch(lambda b, _: seen.extend(sorted(r["id"] for r in b.collect())))
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    for n in range(1, 10):
        page("b", n)
    run()
    page("b", 10)
    page("a", 2)
    run()
    page("a", 3)
    run()
    assert seen == [f"b{n}" for n in range(1, 10)] + ["a2", "b10", "a3"]
    schema = "folder string, page int, old_link string, delta_link string, value array<struct<id:string,removed:string>>"
    pages = [("f", n, "old", f"L{n}", [(str(n), None)]) for n in range(1, 11)] + [("g", 1, "old", "L1", []), ("g", 2, None, None, [])]
    links = mail.delta_links(spark.createDataFrame(pages, schema), spark.createDataFrame([("f", str(n)) for n in range(1, 11)], "folder string, id string"))
    assert {r["folder"]: r["link"] for r in links.collect()} == {"f": "L10", "g": "old"}


def test_contacts_of_a_folder(spark, tmp_path):
    write(tmp_path / "c/a.csv", 'Name,E-mail 1 - Value\nAnn,a@x ::: b@x\n')
    write(tmp_path / "c/sub/b.csv", 'Given Name,Phone 1 - Value\n"B, C",+10\nshort\n')
    write(tmp_path / "c/d.vcf", "BEGIN:VCARD\r\nFN:Dee 10\r\nTEL:+10\r\nEND:VCARD\r\n")
    from marlspike.sources import contacts

    got = sorted((r["full_name"] or r["given"], r["emails"], r["phones"]) for r in contacts.load(spark, str(tmp_path / "c")).collect())
    assert got == [("Ann", ["a@x", "b@x"], []), ("B, C", [], ["+10"]), ("Dee 10", [], ["+10"]), ("short", [], [])]


def test_routes_and_hops(spark, tmp_path):
    import threading
    import urllib.request

    from marlspike.operators import store as S
    from marlspike.plans.http import handle, server

    e = Engine(spark, str(tmp_path / "s"))
    assert handle(e, "GET", "/health") == (200, {"status": "ok"}) and handle(e, "GET", "/nope")[0] == 404 and handle(e, "POST", "/search")[0] == 405
    status, out = handle(e, "POST", "/ingest", json.dumps({"leafs": [{"text": "alpha beta", "source": "s1"}, {"text": "gamma", "source": "s2"}]}), "2024-01-01T00:00:00Z")
    first, second = out["ids"]
    assert status == 200 and handle(e, "POST", "/ingest", '[{"text": ""}]')[0] == 400 and handle(e, "GET", "/get?id=none")[0] == 404
    files, edges = S.link_files(e.store.read().where(F.col("id") == first).select("id", F.lit("a.md").alias("path"), F.lit("r").alias("repo")))
    for name, t in (("files", files), ("leaf_file", edges)):
        e.store.put_table(name, t)
    assert e.build_index() > 0
    status, found = handle(e, "GET", "/search?q=alpha&limit=5&hop=3")
    assert status == 200 and [h["id"] for h in found["hits"]] == [first] and [(h["label"], h["name"]) for h in found["hits"][0]["hops"]] == [("File", "a.md")]
    assert handle(e, "GET", "/search?q=&limit=5")[0] == handle(e, "GET", "/search?q=a&hop=4")[0] == handle(e, "GET", "/search?q=a&limit=x")[0] == 400
    assert handle(e, "GET", f"/get?id={second}")[1]["text"] == "gamma" and handle(e, "GET", "/stats")[1]["total"] == 2 and handle(e, "GET", "/audit")[0] == 200
    assert handle(e, "GET", "/openapi.json")[1]["paths"]["/search"] and "result" in handle(e, "POST", "/mcp", '{"id": 1, "method": "tools/list"}')[1]
    s = server(e, workers=2)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/health", timeout=30) as r:
            assert r.status == 200 and json.load(r) == {"status": "ok"}
    finally:
        s.shutdown()
        s.server_close()


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.md", "one"), ("a/2.md", "zwei ü"), ("a/1.md", "other"), ("b c/+3.md", ""), (None, "x"), ("../up.md", "x"), ("/abs.md", "x"), ("a//4.md", "x"), ("a/5.md", None)], "name string, content string")
    at = tmp_path / "out"
    assert outbox.save_files(rows, str(at), dry=True) == {"ok": 3, "skip": 0, "fail": 5} and not (at / "a").exists()
    assert outbox.save_files(rows, str(at)) == {"ok": 3, "skip": 0, "fail": 5}
    files = lambda: {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file() and "_reports" not in p.parts}
    assert files() == {"a/1.md": "one", "a/2.md": "zwei ü", "b c/+3.md": ""} and not (tmp_path / "up.md").exists()
    more = spark.createDataFrame([("a/1.md", bytearray(b"new")), ("a/6.md", bytearray(b"\x00\xff"))], "name string, content binary")
    assert outbox.save_files(more, str(at)) == {"ok": 1, "skip": 1, "fail": 0} and (at / "a/6.md").read_bytes() == b"\x00\xff"
    assert outbox.save_files(more.limit(1), str(at), force=True)["ok"] == 1 and (at / "a/1.md").read_text() == "new"
    assert outbox.save_files(more.limit(0), str(at)) == {"ok": 0, "skip": 0, "fail": 0}


def test_a_task_that_fails_leaves_whole_files(spark, tmp_path):
    """The run stops within a task: what is there is whole, no run is reported, and the next one goes on from it."""
    at = str(tmp_path)
    good = [(f"{k}.md", f"text {k}") for k in range(5)]
    df = spark.createDataFrame(good, "name string, content string").coalesce(1)
    broken = df.unionByName(spark.range(1).select(F.lit("z.md").alias("name"), F.raise_error(F.lit("lost")).cast("string").alias("content"))).coalesce(1)
    spark.dataSource.register(outbox.NamedFiles)
    with pytest.raises(Exception):  # noqa: B017
        broken.write.format("named-files").option("run", "r1").mode("append").save(f"file://{at}")
    assert all(p.read_text() == f"text {p.stem}" for p in tmp_path.glob("*.md")) and not (tmp_path / "_reports").exists()
    left = len([*tmp_path.glob("*.md")])
    assert outbox.save_files(df, at) == {"ok": 5 - left, "skip": left, "fail": 0}


def test_stored_messages_become_markdown(spark, tmp_path):
    def message(where, **fields):
        write(tmp_path / where / "message.json", json.dumps(fields))

    message("in box/m+1", id="<1>", folder="in", source="imap", subject='a "b"', to="b@x", date="2024-01-02T23:30:00-02:00", receivedAt="2024-01-01T00:00:00Z", textBody=" hi \n", **{"from": "a@x"},
            attachments=[{"fileName": "t.txt", "storedName": "01-t.txt", "contentType": "text/plain"}, {"fileName": "none.txt"}, {"fileName": "c.ics", "contentType": "text/calendar"}, {"contentType": "x/y"}])
    write(tmp_path / "in box/m+1/attachments/01-t.txt", "attached")
    write(tmp_path / "in box/m+1/attachments/c.ics", "BEGIN:VCALENDAR\nEND:VCALENDAR")
    message("m2", id="2", htmlBody="<p>x &amp; y</p>", date="0001-01-01T00:00:00Z", receivedAt="2024-03-01T00:00:00Z")
    message("m3", id="3")
    write(tmp_path / "m3/message.md", "kept")
    write(tmp_path / "bad/message.json", '{"id": ')
    write(tmp_path / "list/message.json", "[1]")
    assert outbox.convert_messages(spark, str(tmp_path), dry=True) == {"ok": 2, "skip": 1, "fail": 2} and not (tmp_path / "m2/message.md").exists()
    assert outbox.convert_messages(spark, str(tmp_path)) == {"ok": 2, "skip": 1, "fail": 2}
    first = (tmp_path / "in box/m+1/message.md").read_text()
    assert first == '---\nid: "<1>"\nfolder: "in"\nsource: "imap"\nsubject: "a \\"b\\""\nfrom: "a@x"\nto: "b@x"\ndate: "2024-01-03"\ntype: mail\n---\n\n# a "b"\n\nhi\n'
    second = (tmp_path / "m2/message.md").read_text()
    assert "date: \"2024-03-01\"" in second and second.endswith("# (no subject)\n\nx & y\n")
    assert (tmp_path / "in box/m+1/attachments/t.txt.md").read_text() == "attached" and not (tmp_path / "in box/m+1/attachments/c.ics.md").exists()
    assert (tmp_path / "m3/message.md").read_text() == "kept"
    assert outbox.convert_messages(spark, str(tmp_path)) == {"ok": 0, "skip": 3, "fail": 2}
    assert outbox.convert_messages(spark, str(tmp_path), force=True) == {"ok": 3, "skip": 0, "fail": 2} and (tmp_path / "m3/message.md").read_text().startswith("---")


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    for name, content in (("a/b c/+1.txt", "one"), ("a/2.txt", ""), ("3.txt", "three"), ("a/_hidden.txt", "x"), (".d/4.txt", "x"), ("_reports/5.txt", "x")):
        write(tmp_path / name, content)
    (tmp_path / "empty").mkdir()
    monkeypatch.setattr(outbox, "READ_BYTES", 1)
    files = outbox.walked(spark, str(tmp_path))
    assert sorted(map(tuple, files.collect())) == [("3.txt", 5), ("a/2.txt", 0), ("a/b c/+1.txt", 3)]
    got = outbox.contents(files, str(tmp_path))
    assert {r["path"]: bytes(r["content"]) for r in got.collect()} == {"a/b c/+1.txt": b"one", "a/2.txt": b"", "3.txt": b"three"}
    assert not any(str(tmp_path) in x for x in got.inputFiles() + outbox.stored_messages(spark, str(tmp_path)).inputFiles())  # no index of the files themselves on the driver


def test_attachment_text(spark):
    ics = b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nDTSTART;TZID=X:20240102T1000\r\nSUMMARY:Long \r\n talk\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nLOCATION:Here\r\nEND:VEVENT\r\nEND:VCALENDAR"
    html_mail = b"Content-Type: text/html\n\n<b>bold</b><br>x"
    rows = [
        ("a.txt", "text/plain", "gr\u00fc\u00df".encode("latin-1"), "gr\u00fc\u00df"), ("a.html", "text/html", b"<p>x</p><script>y</script>", "x"), ("a.json", "application/json", b"{}", "```\n{}\n```"),
        ("a.ics", "text/calendar", ics, "- when: 20240102T1000\n- what: Long talk\n- where: Here"), ("m.eml", "application/octet-stream", EML, "hello"), ("h.eml", "application/octet-stream", html_mail, "bold\nx"),
        ("e.eml", "application/octet-stream", b"", ""), ("p.png", "image/png", b"123", "\n<!-- image skipped -->\n"), ("d.doc", "application/msword", b"1234", "<!-- attachment: d.doc (4 bytes) -->"),
        ("x.pdf", "application/pdf", b"1", "<!-- attachment: x.pdf (1 bytes) -->"), ("n.txt", "text/plain", None, "<!-- attachment: n.txt (unknown size) -->"), (None, None, b"", "<!-- attachment:  (0 bytes) -->"),
    ]
    df = spark.createDataFrame([(k, *r[:2], None if r[2] is None else bytearray(r[2])) for k, r in enumerate(rows)], "k int, name string, media string, content binary")
    got = df.select("k", outbox.attachment_markdown(F.col("name"), F.col("media"), F.col("content")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in got] == [r[3] for r in rows]
