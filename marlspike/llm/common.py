"""What the training-data operators share: session set-up, shared scratch tables and words."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: ASCII white space, the only separators of words in these operators.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch; texts may be long, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 3000, "8m"


def prepare(spark: SparkSession) -> SparkSession:
    """Let executors import this package, keep Arrow batches small and stored tables in few files; harmless when repeated."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")  # partitions of the advised size, not many small ones
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder serves a local master (tests), and a
    cluster is refused, as its executors would not see one another's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "marlspike-scratch")
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/marlspike-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df once to the shared folder and read it back; lost executors then cost no recomputation."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, label))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that materialize() stored, once all that was made of them is stored itself. Other tables stay until the folder is cleaned, as
    a query's result is read after the query has returned."""
    for df in stored:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over dicts of column name to Arrow array (in) and to lists or NumPy arrays (out)."""
    fields = [(x.name, x.dataType) for x in df.sparkSession.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (dict(zip(b.schema.names, b.columns, strict=True)) for b in batches if b.num_rows)
        for out in f(named):
            yield pa.RecordBatch.from_arrays([as_arrow(out[x.name], x.type) for x in arrow], schema=arrow)
            del out
            release()
        release()

    return df.mapInArrow(run, schema)


def merged(batches: Iterator[dict], size: int = 12 << 20) -> Iterator[dict]:
    """Batches put together until they hold `size` bytes: the JVM sends small ones, some work is cheaper on larger ones."""
    held: list[dict] = []
    total = 0
    for b in batches:
        held.append(b)
        total += sum(x.nbytes for x in b.values())
        if total >= size:
            yield {k: pa.concat_arrays([x[k] for x in held]) for k in b}
            held, total = [], 0
    if held:
        yield {k: pa.concat_arrays([x[k] for x in held]) for k in held[0]}


def release() -> None:
    """Give freed memory back to the system, as a worker outlives its task and may idle beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text, with further columns by name, under fixed names whatever else docs holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case: bytes.split() and bytes.lower() know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
