"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import WORD, materialize, prepare, text_rows

#: Weights of the sources in code point order, repeating; share of all sizes that the mix takes; times a source is used at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SYMBOLS = "#*$%&|<>"
#: Key ranges of width 1/RANGES, of which the last takes all larger keys.
RANGES, LAST_RANGE = 1024, 16_383


def quality(text: Column) -> Column:
    """A weight in (0, 1]: 1 without symbols, falling with their share."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return 1.0 / (1.0 + 20.0 * symbols / F.greatest(n, F.lit(1)))


def uniform(key: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of the MD5 of seed and key."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source_key, source, source_size), one row a source, with target, epochs and rest.

    Filled like vessels: sources by the level at which they overflow (2 x size / weight); those below the common level get
    their most, the others weight x level. The table has one row for each distinct source, so one task holds it.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("double")
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    most = F.col("source_size") * float(MOST)
    t = sizes.withColumn("rank", F.row_number().over(by_source)).withColumn("weight", weight).withColumn("most", most)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, from_here = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * SHARE
    t = t.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    level = F.first(F.when(F.col("most") > F.col("weight") * F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    t = t.withColumn("target", F.when(F.col("most") <= F.col("weight") * F.col("level"), F.col("most")).otherwise(F.col("weight") * level))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("epochs", epochs)
    return t.select("source_key", "source_size", "target", "epochs", (F.floor("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def drawn(docs: DataFrame, seed: str, *more: str) -> DataFrame:
    """doc_id, source, source_key, size, key and its range, text_hash of each document, with further columns by name."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary")))), seed)) / F.coalesce(quality(text), F.lit(1.0))).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        *more,
    )
    return rows.withColumn("range", F.least(F.lit(LAST_RANGE), F.floor(F.col("key") * RANGES)).cast("int"))


def planned(rows: DataFrame) -> DataFrame:
    """Stored rows of drawn() with source_size, target and taken, a row for each."""
    ranges = rows.groupBy("source_key", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    ranges = materialize(ranges, "mix-ranges")
    sizes = ranges.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    plan = ranges.withColumn("earlier", F.coalesce(F.sum("range_size").over(earlier), zero)).drop("source").join(targets(sizes), "source_key")
    within = Window.partitionBy("source_key", "range").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("earlier") + F.coalesce(F.sum("size").over(within), zero)
    extra = F.greatest(zero, F.least("size", F.col("rest") - before))
    return rows.drop("source").join(plan, ["source_key", "range"]).withColumn("taken", F.col("epochs") * F.col("size") + extra)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document doc_id, size (words), source_size, target (its source's), taken (words the mix takes, repeats counted).

    Each source is taken whole as often as its target allows; the rest comes from documents in the order of their exponential
    keys -ln(u) / quality, u from doc_id, cut where the prefix sum of sizes reaches it, within the last document if need be. Prefix sums
    are made in two levels, over key ranges of a source and inside a range, so no task holds a source. Null and empty texts have size 0;
    a null source is a source of its own, last; a document without doc_id draws u from its text; documents that share a doc_id draw the same u and
    tie by size, then by their text's hash; other columns are ignored. The same rows give the same mix.
    """
    prepare(docs.sparkSession)
    return planned(materialize(drawn(docs, seed), "mix")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: docs (doc_id, text, lang, source, n_chars) with each document as often as it is taken.

    Whole repeats come as rows; a part of a document is its first words, joined by blanks. Texts are stored under a number for each row,
    by which the plan finds them again: rows may share doc_id, size and text, or have no doc_id.
    """
    prepare(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    rows = materialize(drawn(docs, seed, text, "lang").withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    plan = planned(rows.drop("text", "lang")).where("taken > 0").select("row", "taken")
    taken = rows.select("row", "doc_id", "text", "lang", "source", "size").join(plan, "row")
    repeats = F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))))
    taken = taken.withColumn("repeat", repeats)
    part = F.col("taken") - (F.col("repeat") - 1) * F.col("size")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), part.cast("int")), " ")
    taken = taken.withColumn("text", F.when(part < F.col("size"), first).otherwise(F.col("text")))
    return taken.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


#: The same mix in DuckDB.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(text), 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * (length(text) - length(translate(text, '{SYMBOLS}', ''))) / greatest(length(text), 1)), 1.0::DOUBLE) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
), t AS (
  SELECT *, CASE WHEN most <= weight * lv THEN most
      ELSE weight * (SELECT arg_min(lv, (most / weight, r)) FROM l WHERE most > weight * lv) END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size
    - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
