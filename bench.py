"""Times the headline queries, warm, at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "leaf_identity", "bm25_topk", "cosine_topk", "rrf_fusion", "hybrid_search", "filter_before_limit", "hybrid_batch", "recall_at_5", "hop3", "hops_collected",
    "stats_by_root", "quantiles_cont", "index_percentiles_stress", "fact_histogram", "dedupe_first_text", "store_upsert", "adjudicate_claims", "audit_fact_rows",
    "crm_action_plan", "md_chunks", "html_strip", "stream_ingest_counts",
)


def store_rates(spark, d: str, n: int) -> dict[str, float]:
    """Leafs a second that a new store takes, and is indexed by; both once, cold."""
    import tempfile

    from pyspark.sql import functions as F

    from marlspike.operators.store import Store

    with tempfile.TemporaryDirectory() as at:
        store, now = Store(spark, f"{at}/store"), "2024-01-01T00:00:00Z"
        began = time.time()
        store.add(spark.read.parquet(f"{d}/documents.parquet").where(F.trim("text") != "").select("text", F.col("doc_id").cast("string").alias("source")), now)
        added = time.time()
        store.index()
        return {"store_leafs_per_second": round(n / (added - began)), "index_leafs_per_second": round(n / (time.time() - added))}


def main() -> None:
    d, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count())), int(os.environ.get("BENCH_RUNS", "3"))
    from marlspike.plans.catalogue import QUERIES
    from marlspike.session import session

    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first warms up
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    leafs = spark.read.parquet(f"{d}/documents.parquet").count()
    extra = {"leafs_per_second": round(leafs / took["leaf_identity"]), "batch_ms_per_query": round(1000 * took["hybrid_batch"] / spark.read.parquet(f"{d}/benchmark.parquet").count(), 1)}
    extra |= store_rates(spark, d, leafs)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(d).name.removeprefix("sf"), **extra}))


if __name__ == "__main__":
    main()
