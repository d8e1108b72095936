"""Reports of harness runs: tool calls, process memory, request mixes, contrast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.text import xml_leak


def tool_calls(responses: DataFrame) -> DataFrame:
    """prompt, tool, arguments, content of chat completions (prompt, body: JSON); a response that can't be read has nulls."""
    get = lambda p: F.get_json_object("body", f"$.choices[0].message.{p}")
    return responses.select("prompt", get("tool_calls[0].function.name").alias("tool"), get("tool_calls[0].function.arguments").alias("arguments"), get("content").alias("content"))


def tool_report(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: n, n_ok (the wanted tool of (prompt, wanted) was called), n_leaks (a call written out as XML)."""
    c = wanted.join(calls, "prompt", "left")
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("tool") == F.col("wanted")).alias("n_ok"), F.count_if(F.coalesce(xml_leak(F.col("content")), F.lit(False))).alias("n_leaks"))


def process_memory(payload: DataFrame, column: str = "value") -> DataFrame:
    """name and MiB of each model of JSON rows {"models": [{"name", "size"}]}, in order."""
    m = payload.select(F.posexplode(F.from_json(column, "models array<struct<name:string,size:bigint>>")["models"]).alias("pos", "m"))
    return m.select("pos", "m.name", F.floor(F.col("m.size") / 1048576).alias("mib"))


def stretched(df: DataFrame, value: str, *by: str) -> DataFrame:
    """value spread over 0 to 255 between a group's least and largest; a flat group gives 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("stretched", F.when(high > low, F.round((F.col(value) - low) * 255 / (high - low))).otherwise(0.0))


def request_mix(spec: Column) -> Column:
    """map of endpoint to weight of 'a=3,b=1'."""
    return F.transform_values(F.str_to_map(spec, F.lit(","), F.lit("=")), lambda k, v: v.try_cast("int"))


def weighted_pick(requests: DataFrame, mix: dict[str, int], draw: Column) -> DataFrame:
    """requests with endpoint, by where draw (0 to 1) falls among the cumulated weights."""
    total, at, cases = sum(mix.values()), 0, []
    for name, weight in sorted(mix.items()):
        at += weight
        cases.append(F.when(draw * total < at, F.lit(name)))
    return requests.withColumn("endpoint", F.coalesce(*cases, F.lit(max(mix))))


def per_source(messages: DataFrame, offset: int, limit: int, *order) -> DataFrame:
    """messages (source, …) from offset on, limit of each source; limit <= 0: all."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    rows = messages.withColumn("_n", rn).where(F.col("_n") > offset)
    return (rows.where(F.col("_n") <= offset + limit) if limit > 0 else rows).drop("_n")


def statuses(rows: DataFrame) -> DataFrame:
    """How many rows were written, skipped and failed."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))
