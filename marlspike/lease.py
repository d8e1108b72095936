"""Leases across processes: a numbered log of small files in a shared folder, of which each next one is made by one process alone."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from marlspike.session import hadoop


def create(spark: SparkSession, path: str, body: dict, replace: bool = False) -> bool:
    """Write body as JSON to path in one step; False if the file is there already, unless it may be replaced. Of several processes one succeeds."""
    to, fs = hadoop(spark, path)
    fs.mkdirs(to.getParent())
    own = hadoop(spark, f"{to.getParent()}/.{uuid.uuid4().hex}")[0]
    out = fs.create(own, True)
    out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
    out.close()
    try:
        if fs.getScheme() == "file" and not replace:  # a local rename looks before it moves; a link is one step
            os.link(own.toUri().getPath(), to.toUri().getPath())
            return True
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE if replace else rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(own).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(fs.makeQualified(own), fs.makeQualified(to), how)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if not replace and fs.exists(to):
            return False
        raise
    finally:
        fs.delete(own, False)


def read(spark: SparkSession, path: str) -> dict | None:
    """The JSON at path; None if there is no file."""
    p, fs = hadoop(spark, path)
    try:
        stream = fs.open(p)
    except Py4JJavaError:
        if fs.exists(p):
            raise
        return None
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


class Lost(Exception):
    """Another process holds the lease by now."""


class Lease:
    """The right to do something alone, for `ttl` seconds unless it is renewed, with a fencing number that grows with every holder.

    Taking, renewing and releasing each make the log's next entry, so that of two processes that do so at once one loses. An entry names the fence, the
    end of the lease and a value that holders hand on. A holder that outlived its lease still has to be refused where it writes: by its fence.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = 60.0, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.ttl, self.clock = spark, path, ttl, clock
        self.fence: int | None = None

    def _numbers(self) -> list[int]:
        p, fs = hadoop(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, number: int) -> str:
        return f"{self.path}/{number:012d}.json"

    def last(self) -> tuple[int, dict]:
        """The log's last entry and its number; 0 and an entry that ended for an empty log."""
        while numbers := self._numbers():
            if (found := read(self.spark, self._file(numbers[-1]))) is not None:
                return numbers[-1], found
        return 0, {"fence": 0, "until": 0.0, "value": None}

    def _next(self, number: int, fence: int, until: float, value: object) -> bool:
        if not create(self.spark, self._file(number + 1), {"fence": fence, "until": until, "value": value}):
            return False
        numbers = self._numbers()
        if numbers[-1] != number + 1:  # made where an entry of long ago was tidied away
            hadoop(self.spark, self.path)[1].delete(hadoop(self.spark, self._file(number + 1))[0], False)
            return False
        for old in numbers[:-2]:
            hadoop(self.spark, self.path)[1].delete(hadoop(self.spark, self._file(old))[0], False)
        return True

    def take(self) -> int | None:
        """The fence, or None while another process holds the lease."""
        number, entry = self.last()
        now = self.clock()
        if entry["until"] > now or not self._next(number, number + 1, now + self.ttl, entry["value"]):
            return None
        self.fence = number + 1
        return self.fence

    def _own(self) -> tuple[int, dict]:
        number, entry = self.last()
        if self.fence is None or entry["fence"] != self.fence or not entry["until"]:
            raise Lost(self.path)
        return number, entry

    def renew(self) -> None:
        """Hold it for another ttl, also after its end if nobody took it."""
        number, entry = self._own()
        if not self._next(number, self.fence, self.clock() + self.ttl, entry["value"]):
            raise Lost(self.path)

    def value(self) -> object:
        return self._own()[1]["value"]

    def release(self, value: object = None) -> None:
        """Give it up and hand on value; None: the one that was handed to this holder."""
        number, entry = self._own()
        if not self._next(number, self.fence, 0.0, entry["value"] if value is None else value):
            raise Lost(self.path)
        self.fence = None

    @contextmanager
    def held(self, wait: float = float("inf"), sleep: Callable[[float], None] = time.sleep, step: float = 0.2) -> Iterator[Lease]:
        """Wait for the lease, at most so long (TimeoutError), and release it at the end, unless it was released or lost by then."""
        until = self.clock() + wait
        while self.take() is None:
            if self.clock() >= until:
                raise TimeoutError(self.path)
            sleep(step)
        try:
            yield self
        finally:
            if self.fence is not None and self.last()[1]["fence"] == self.fence:
                self.release()
            self.fence = None


class Answers:
    """A cache of answers in a shared folder, a file for each key: what web.Lookup keeps across processes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, key: str) -> tuple[float, dict] | None:
        found = read(self.spark, f"{self.path}/{key}.json")
        return found and (found["at"], found["answer"])

    def __setitem__(self, key: str, kept: tuple[float, dict]) -> None:
        create(self.spark, f"{self.path}/{key}.json", {"at": kept[0], "answer": kept[1]}, replace=True)


class Turns:
    """Calls of all processes that share a folder, one at a time and `interval` seconds apart; the lease hands on the time of the last one."""

    def __init__(self, lease: Lease, wait: float = 300.0):
        self.lease, self.wait = lease, wait

    @contextmanager
    def __call__(self, interval: float, clock: Callable[[], float], sleep: Callable[[float], None]) -> Iterator[float]:
        with self.lease.held(self.wait, sleep) as held:
            last = held.value()
            if last is not None and (rest := interval - (clock() - last)) > 0:
                sleep(rest)
            now = clock()
            try:
                yield now
            finally:
                if held.last()[1]["fence"] == held.fence:
                    held.release(now)
