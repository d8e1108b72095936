"""Several Spark actions at a time: results in the order of their inputs, progress, and an end for the others when one fails or all are cancelled."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

WORKERS = 4


class Cancelled(Exception):
    """The caller asked for the end."""


def ordered_map[A, B](spark: SparkSession, run: Callable[[A], B], items: Iterable[A], workers: int = WORKERS, progress: Callable[[int, float], None] | None = None, cancel: threading.Event | None = None) -> Iterator[B]:
    """run of each item, in the order of items, at most `workers` at a time; each result comes as soon as those before it have come.

    Items are taken as they are needed: no more than twice `workers` are running or wait for those before them. All Spark jobs of a call bear its tag. The
    first failure, `cancel`, or the end of the iteration interrupts the jobs that still run, and later items don't start; the failure (of several, the first to
    be seen) or Cancelled is raised once every worker has ended. progress gets the number of items done and the seconds since the start, in the caller's thread.
    """
    tag, stop, began = f"ordered-{uuid.uuid4().hex}", threading.Event(), time.monotonic()

    def one(item: A) -> B:
        context.addJobTag(tag)
        try:
            if stop.is_set():
                raise Cancelled(tag)
            return run(item)
        except BaseException as e:
            if not stop.is_set():
                failed.append(e)
                stop.set()  # no item starts after a failure
            raise
        finally:
            context.removeJobTag(tag)

    context = spark.sparkContext  # a session's own tags can only be interrupted by the thread that set them
    left, queue, done, seen = iter(items), [], 0, set()
    failed: list[BaseException] = []
    pool = ThreadPoolExecutor(max(1, workers))
    try:
        more = True
        while more or queue:
            while more and len(queue) < 2 * max(1, workers):
                try:
                    queue.append(pool.submit(one, next(left)))
                except StopIteration:
                    more = False
            ended, _ = wait([f for f in queue if f not in seen], 0.05, FIRST_COMPLETED)
            if cancel is not None and cancel.is_set():
                raise Cancelled(tag)
            if failed:
                raise failed[0]
            for f in ended:
                seen.add(f)
                done += 1
                if progress:
                    progress(done, time.monotonic() - began)
            while queue and queue[0] in seen:
                first: Future = queue.pop(0)
                seen.discard(first)
                yield first.result()
    finally:
        stop.set()
        for f in queue:
            f.cancel()
        while not all(f.done() for f in queue):  # a call may start another job after the one that was interrupted
            context.cancelJobsWithTag(tag)
            wait(queue, 0.2)
        pool.shutdown()
