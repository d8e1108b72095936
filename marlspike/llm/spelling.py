"""Spelling variants grouped by anagram hashing: words of which the keys differ by one letter's value meet, and their letter order is verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import discard, materialize, prepare, text_rows

#: Letters of a word: fixed by the task.
LETTERS = r"A-Za-zÀ-ÿ"
#: Shortest words in code points, least occurrences, times that a form must be as frequent as its variant, and one in how many runs is damaged.
LEAST, TWICE, TIMES, DAMAGE = 7, 2, 10, 31
#: A letter's value is this power of its code point; keys are sums of values, modulo a prime so that no length overflows.
POWER, MODULUS = 5, (1 << 61) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and each maximal run of at least `least` letters, A-Z in lower case: shorter runs can't become words."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    return text_rows(docs).select("doc_id", F.explode(found).alias("run"))


def damaged(run: Column, doc_id: Column) -> Column:
    """The run, without one letter where its checksum says so; a null doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, least: int = LEAST, twice: int = TWICE) -> DataFrame:
    """Stored (word, n) of words (word); occurrences are added up before the shuffle."""
    return materialize(words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice), "spelling-words")


def value(letter: Column) -> Column:
    code, out = F.ascii(letter).cast("long"), F.lit(1).cast("long")
    for _ in range(POWER):
        out = out * code
    return out


#: Kinds of rows: exchange with the first or the last half kept, the shorter and the longer word with the first half kept, and with the last.
X0, S0, L0, S1, L1, X1 = range(6)


def keyed(words: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """Rows (key, kind, word, n) of the kinds, by which every two words that one edit parts meet.

    A word's anagram key is the sum of its letters' values. Two words of one length that an exchange parts have equal keys once each gave up one
    letter's value (kinds X); of two that an addition parts, the longer one's key less a letter (L) is the shorter one's own (S). One edit leaves
    the first half or the last half of the shorter word's length as it was, so a key goes with the half opposite to its letter: anagrams
    that share neither half never meet, and classes of anagrams aren't paired among themselves. A word gives a row for each letter of each half.
    """
    size, head, short = F.length("word"), F.floor(F.length("word") / 2).cast("int"), F.floor((F.length("word") - 1) / 2).cast("int")
    first = lambda n: F.substring("word", F.lit(1), n)
    last = lambda n: F.substring("word", size - n + 1, n)
    half = lambda side, shorter, text: F.xxhash64(F.lit(side), shorter, text)
    rows = words.select(
        "word", "n", F.transform(F.split("word", ""), value).alias("values"), size.alias("size"), head.alias("head"), short.alias("short"),
        half(0, size, first(head)).alias("whole_0"), half(1, size, last(size - head)).alias("whole_1"),
        half(0, size - 1, first(short)).alias("less_0"), half(1, size - 1, last(size - 1 - short)).alias("less_1"),
    )
    rows = rows.withColumn("sum", F.aggregate("values", F.lit(0).cast("long"), lambda t, x: F.pmod(t + x, F.lit(MODULUS))))
    letters = {X0: ("head", True), X1: ("head", False), L0: ("short", True), L1: ("short", False)}  # where halves part, and whether the last one's letters are given up
    part = lambda at, end: F.slice("values", F.col(at) + 1, F.col("size")) if end else F.slice("values", F.lit(1), F.col(at))
    none = F.array(F.lit(0).cast("long"))
    each = F.concat(*[F.transform(F.array_distinct(part(*letters[k])) if k in letters else none, _row(k)) for k in kinds])
    rows = rows.withColumn("row", F.explode(each)).select("word", "n", "sum", "row.*", "whole_0", "whole_1", "less_0", "less_1")
    kind = F.col("kind")
    side = F.when(kind <= S0, F.col("whole_0")).when(kind == L0, F.col("less_0")).when(kind == L1, F.col("less_1")).otherwise(F.col("whole_1"))
    return rows.select(F.xxhash64(kind.isin(X0, X1), F.pmod(F.col("sum") - F.col("gone"), F.lit(MODULUS)), side).alias("key"), "kind", "word", "n")


def _row(kind: int):
    return lambda gone: F.struct(F.lit(kind).alias("kind"), gone.alias("gone"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words (word, n; distinct) that differ by exactly one inserted, deleted or replaced letter, each once.

    Words that meet by key are compared letter by letter; a pair that meets on both halves counts on the first."""
    side = lambda rows, x: rows.select("key", "kind", F.col("word").alias(x), F.col("n").alias(f"{x}_n")).alias(x)
    exchange = keyed(words, (X0, X1))
    meet = (F.col("a.key") == F.col("b.key")) & (F.levenshtein("a", "b", 1) == 1)
    exchanged = side(exchange, "a").join(side(exchange, "b"), meet & (F.col("a") < F.col("b")))
    head = F.floor(F.length("a") / 2).cast("int")
    once = (F.col("a.kind") == S0) | (F.substring("a", F.lit(1), head) != F.substring("b", F.lit(1), head))
    added = side(keyed(words, (S0, S1)), "a").join(side(keyed(words, (L0, L1)), "b"), meet & once)
    return exchanged.select("a", "a_n", "b", "b_n").union(added.select("a", "a_n", "b", "b_n"))


def forms_of(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Stored (word, n, n_near, form, form_n): a word's form is its near word of largest n, ties to the smallest in code-point order, if that is
    at least `times` as frequent."""
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    return materialize(out, "spelling-forms")


def roots_of(forms: DataFrame) -> DataFrame:
    """Stored (word, root) of words that have a form: forms are followed to the last by doubling, in as many rounds as the longest chain has binary
    digits; a chain grows `times`-fold at each step and so is short."""
    at = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(further, "root", "left_semi").isEmpty():
            return at
        after = materialize(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        discard(at)
        at = after


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """words (word, n; stored, distinct) with form, root, n_near and form_n."""
    forms = forms_of(words, times)
    out = forms.join(roots_of(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text), as the task damages and counts them.

    Null, empty and letterless texts have no words, a null doc_id is written as nothing where runs are damaged, repeated rows count each time, ties
    go to the smallest word in code-point order, an empty table gives no rows; other columns are ignored. A word of any length is one word.
    """
    prepare(docs.sparkSession)
    found = runs(docs)
    return variants(counted(found.select(damaged(F.col("run"), F.col("doc_id")).alias("word"))))
