"""Ordered maps over Spark actions: order, bounds, progress, failures, cancelling."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from marlspike.plans.ordered import Cancelled, ordered_map


def slow(spark, seconds):
    wait = F.udf(lambda x: time.sleep(seconds) or x, "long")
    return spark.range(1, numPartitions=1).select(wait("id")).collect()


def test_results_come_in_order_and_no_more_than_allowed_run(spark):
    lock, running, most, seen = threading.Lock(), [0], [0], []

    def run(k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05 * (k % 3))
        n = spark.range(k).count()
        with lock:
            running[0] -= 1
        return n

    assert [*ordered_map(spark, run, range(10), 3, lambda n, s: seen.append((n, s)))] == [*range(10)]
    assert 1 < most[0] <= 3 and [n for n, _ in seen] == [*range(1, 11)] and [s for _, s in seen] == sorted(s for _, s in seen)
    assert [*ordered_map(spark, run, [])] == []


def test_items_are_taken_as_needed(spark):
    taken = []
    found = ordered_map(spark, lambda k: k, (taken.append(k) or k for k in range(100)), 2)
    assert next(found) == 0 and len(taken) <= 4
    found.close()
    assert len(taken) <= 4


def test_the_first_failure_ends_the_others(spark):
    def run(k):
        if k == 1:
            time.sleep(1)
            raise ValueError("no")
        return slow(spark, 60)

    at, started = time.monotonic(), []
    with pytest.raises(ValueError, match="no"):
        [*ordered_map(spark, lambda k: started.append(k) or run(k), range(9), 2)]
    assert time.monotonic() - at < 30 and len(started) <= 2


def test_cancelled_from_outside(spark):
    cancel = threading.Event()
    threading.Timer(1, cancel.set).start()
    at = time.monotonic()
    with pytest.raises(Cancelled):
        [*ordered_map(spark, lambda k: slow(spark, 60), range(4), 2, cancel=cancel)]
    assert time.monotonic() - at < 30 and spark.range(3).count() == 3
