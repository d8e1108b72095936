"""Incremental ingest: file streams into the store, each batch once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlspike.operators.chat import first_of
from marlspike.operators.store import Store, lacking
from marlspike.session import hadoop, shared_dir
from marlspike.sources import corpus

EVERY = "30 seconds"


#: The column of a stream of files that orders its rows: by the time of their file, its name, the place of their block in it and, in a batch, their own.
SEQ = "seq"


def stream(spark: SparkSession, path: str, schema, kind: str = "parquet", ordered: bool = False, **options: str) -> DataFrame:
    """Files below path as they come; ordered: with SEQ."""
    rows = spark.readStream.format(kind).schema(schema).options(**options).load(path)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return rows.select("*", place.alias(SEQ)) if ordered else rows


def start(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Run each on every batch; offsets move only after it returned. every None: what there is, then stop."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def into_store(store: Store, now: Callable[[], str], aside: str = "") -> Callable[[DataFrame, int], None]:
    """Upserts by id: a batch that comes again changes nothing. Of rows with one id the last by SEQ stays, if the stream is ordered.

    aside: a folder, of this stream's checkpoint alone, for rows without text or source (set_aside()); unless it is given, such a row ends the stream.
    """

    def each(batch: DataFrame, n: int) -> None:
        if batch.isEmpty():
            return
        if aside:
            batch.where(lacking()).write.mode("overwrite").parquet(f"{aside}/batch={n}")  # the same rows, if the batch comes again
            batch = batch.where(~lacking())
        if SEQ in batch.columns:
            batch = batch.withColumn(SEQ, F.struct(SEQ, F.monotonically_increasing_id().alias("row")))
        store.add(batch, now(), SEQ if SEQ in batch.columns else "")

    return each


def set_aside(spark: SparkSession, aside: str, schema) -> DataFrame:
    """Rows that into_store() kept out of its store."""
    path, fs = hadoop(spark, aside)
    return spark.read.schema(schema).parquet(aside).select(*schema.fieldNames()) if fs.exists(path) else spark.createDataFrame([], schema)


#: The table of a store that names the files which its corpus leafs come from, and the mark of those leafs.
STATE, HOW = "corpus", "corpus"


def reindex(store: Store, path: str, now: str, repo: str = "") -> dict[str, int]:
    """Bring a store's leafs of the corpus below path up to date, in one version: leafs of changed and removed files go, those of changed and new files
    come. Files are told apart by the SHA-256 of their content, kept in the store beside the leafs; nothing is written where no file changed. Returns how
    many files were added, changed and removed.
    """
    spark = store.spark
    found = corpus.files(spark, path, ".md", ".markdown", ".yaml", ".yml").select("path", F.sha2("content", 256).alias("hash"), F.lit(repo).alias("repo"))
    before = store.table(STATE)
    before = spark.createDataFrame([], found.schema) if before is None else before
    both = found.alias("f").join(before.where(F.col("repo") == repo).alias("b"), "path", "full").select("path", F.col("f.hash").alias("hash"), F.col("b.hash").alias("old"))
    changes = both.where(~F.col("hash").eqNullSafe(F.col("old"))).persist()
    try:
        n = changes.agg(*[F.count_if(c).alias(k) for k, c in {"added": F.isnull("old"), "changed": F.col("hash").isNotNull() & F.col("old").isNotNull(), "removed": F.isnull("hash")}.items()]).first().asDict()
        if not any(n.values()):
            return n
        new = corpus.corpus(spark, path, repo).join(changes.where("hash is not null").select(F.col("path").alias("source")), "source", "left_semi")
        new = new.select("text", "source", "type", F.lit(HOW).alias("how"), F.lit(repo).alias("loc"))
        old = store.read().where((F.col("how") == HOW) & (F.col("loc") == repo))
        gone = old.join(changes.where("old is not null").select(F.col("path").alias("source")), "source", "left_semi").select("id")
        store.apply(new.where(F.trim("text") != ""), gone, now, tables={STATE: before.where(F.col("repo") != repo).unionByName(found)})
        return n
    finally:
        changes.unpersist()


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key: what a stream of upserts leaves."""
    return first_of(df, [key], *order)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts and sums of events by event-time window and type, with a watermark; plain timestamps are taken as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once, remembered as long as rows may be late."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session (a window) and n: events of a user no further apart than gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))


def drain(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what there is, into a table in the shared folder, and return that: appended rows, or the last complete result."""
    out = f"{shared_dir(spark)}/marlspike-stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = q.format("parquet").start(f"{out}/rows")
    else:
        q = q.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    path, fs = hadoop(spark, f"{out}/rows")
    return spark.read.schema(df.schema).parquet(f"{out}/rows") if fs.exists(path) else spark.createDataFrame([], df.schema)


def wave(steps: list[tuple[str, Callable[[], object] | None]], quiesce: Callable[[], None] = lambda: None) -> dict[str, str]:
    """Run steps in order: ok, skipped (no callable) or failed; one failure doesn't stop the rest."""
    out: dict[str, str] = {}
    quiesce()
    for name, step in steps:
        if step is None:
            out[name] = "skipped"
            continue
        try:
            step()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001  the next source must still be read
            out[name] = f"failed: {e}"
    return out


def retried(call: Callable[[], object], attempts: int, base: float, most: float, sleep: Callable[[float], None], transient: Callable[[Exception], bool] = lambda e: True) -> object:
    """call, again after growing delays while it fails for a passing reason."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not transient(e):
                raise
            sleep(min(base * 2 ** min(n - 1, 10), most))
    return None
