"""Quality rules: repetition measures of each text and line frequency across the documents of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import map_batches, materialize, prepare, text_rows

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
DIGITS, GAPS = re.compile(r"[0-9]+"), re.compile(r"[\x20\x09-\x0D]+")


def repeated_words(words: list[bytes]) -> int:
    """Word positions inside a three-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = at[:-1] * len(number) + at[1:]
    if len(number) > 1 << 20:  # three numbers would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[again + k] = True
    return int(covered.sum())


def normalised(line: str) -> str:
    return GAPS.sub(" ", DIGITS.sub("0", line.lower())).strip()


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(normalised(line)) - (1 << 63)


def measures(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hashes of the distinct normalised lines and their words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    by: dict[int, int] = {}
    for x in lines:
        h = line_hash(x)
        by[h] = by.get(h, 0) + len(x.encode("utf-8", "surrogatepass").split())
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len({*lines}),
        repeated_words(words),
        [*by],
        [*by.values()],
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """A stored row for each row of docs: uid, doc_id, doc (what tells documents apart: doc_id, or the text's hash where it is null), host, the counts, base_failed, line hashes and their words, and further columns by name."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)).cast("string")))
    taken = text_rows(docs, F.col("source").cast("string").alias("host"), doc.alias("doc"), *[c for c in more if c != "text"])
    kept = [(c, taken.schema[c].dataType.simpleString()) for c in more]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [measures(x or "") for x in b["text"].to_pylist()]
            cols = dict(zip(COUNTS, map(list, zip(*(r[:5] for r in rows), strict=True)), strict=True))
            yield {"doc_id": b["doc_id"], "host": b["host"], "doc": b["doc"], **cols, "lines": [r[5] for r in rows], "line_words": [r[6] for r in rows], **{c: b[c] for c, _ in kept}}

    schema = f"doc_id long, host string, doc string, {', '.join(f'{c} long' for c in COUNTS)}, lines array<long>, line_words array<long>" + "".join(f", `{c}` {t}" for c, t in kept)
    rows = map_batches(taken, run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return materialize(rows.withColumn("base_failed", failed).withColumn("uid", F.monotonically_increasing_id()), "quality")


#: Documents of a host that have a line before it can be boilerplate, however small the host: two may be copies of one another.
FEWEST = 3
#: Frequent lines that are sent to every task, at most; more are met by a join, in which each line's documents are shared among SALTS tasks.
SENT_LINES, SALTS = 200_000, 32


def losses(rows: DataFrame, least_limit: int, limit_share: float) -> DataFrame:
    """uid, n_removed_words, removed (hashes of the lines) of those of measured() rows that hold a frequent line."""
    host = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("host")
    each = rows.select("uid", host, "doc", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("uid", "host", "doc", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    hosts = rows.select(host, "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    often = each.select("host", "line", "doc").distinct().groupBy("host", "line").agg(F.count("*").alias("docs_with")).where(F.col("docs_with") >= min(FEWEST, least_limit + 1))
    many = (F.col("docs_with") > least_limit) | ((F.col("docs_with") >= FEWEST) & (F.col("docs_with") > F.col("docs") * limit_share))
    above = materialize(often.join(hosts, "host").where(many).select("host", "line"), "lines")
    if above.count() <= SENT_LINES:
        met = each.join(F.broadcast(above), ["host", "line"])
    else:
        salted = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    return met.groupBy("uid").agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed"))


def quality_rules(docs: DataFrame, least_limit: int = 50, limit_share: float = 0.01, most_removed: float = 0.7) -> DataFrame:
    """Per document doc_id, the counts, base_failed, n_removed_words, kept.

    A line counts once for each document and host (source; null is a host of its own). A line is removed from a host's documents when
    more than least_limit of them have it, whatever the host's size, or more than limit_share of them, if these are FEWEST at least; lines
    are compared after lower-casing, digits as 0 and white space as one blank, by a 64-bit hash (two lines of one host are taken for one another with odds of
    their number squared in 2^65). A document that loses more than most_removed of its words is depleted: kept is false,
    as it is where base_failed. Null and empty texts have no words and fail the base rules. Rows of one doc_id are one document of their host, as are
    equal texts without doc_id; equal texts of different doc_ids are documents each, so a host's many copies of one text lose its lines; other columns
    are ignored. Hashes travel instead of lines and are counted before the shuffle.
    """
    prepare(docs.sparkSession)
    rows = measured(docs)
    removed = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    return (
        rows.join(losses(rows, least_limit, limit_share).drop("removed"), "uid", "left")
        .select(
            "doc_id", *COUNTS, "base_failed", removed.alias("n_removed_words"),
            (~F.col("base_failed") & (removed <= most_removed * F.col("n_words"))).alias("kept"),
        )
    )


def without_frequent_lines(docs: DataFrame, least_limit: int = 50, limit_share: float = 0.01, most_removed: float = 0.7) -> DataFrame:
    """The documents that quality_rules keeps (doc_id, text, lang, source, n_chars), their frequent lines removed and n_chars counted anew.

    Every line whose normal form is frequent goes, with its line break; the others stay as they are. Cases are as in quality_rules, of which null
    and empty texts are not kept.
    """
    prepare(docs.sparkSession)
    rows = measured(docs, "text", "lang", "source", "n_chars")
    lost = rows.join(losses(rows, least_limit, limit_share), "uid", "left")
    fits = ~F.col("base_failed") & (F.coalesce("n_removed_words", F.lit(0)) <= most_removed * F.col("n_words"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = []
            for text, removed in zip(b["text"].to_pylist(), b["removed"].to_pylist(), strict=True):
                gone = {*(removed or ())}
                texts.append("\n".join(x for x in text.split("\n") if line_hash(x) not in gone) if gone else text)
            yield {k: b[k] for k in ("doc_id", "lang", "source")} | {"text": texts, "n_chars": [*map(len, texts)]}

    return map_batches(lost.where(fits).select("doc_id", "text", "lang", "source", "removed"), run, "doc_id long, text string, lang string, source string, n_chars long")
