"""Folders that are listed page by page: a keyed state for each folder holds its place, and the place moves when a page was taken whole."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A page: its folder, the link that it was asked by ("" for a folder's first), the link of the page after it or, on the last one, of the next run.
PAGES = "folder string, link string, next string, delta string, value array<struct<id:string,removed:boolean>>"
#: What is listed: the numbers of a page and an id in their folder, from 1, the id and its page's link; or, id being null, the link that the place moved to.
LISTED = "folder string, page long, seq long, id string, link string"
#: Files of pages in a batch, and milliseconds for which a page that was taken is remembered under a limit, so that it is known when it comes again.
FILES, REMEMBERED = 64, 30 * 24 * 3600 * 1000
#: Ids and pages that a folder's task holds before it asks the states, and rows that it gives back at once.
HELD, ROWS = 1_000_000, 10_000
COLUMNS = ["folder", "page", "seq", "id", "link"]


class Walk(StatefulProcessor):
    """Takes a folder's pages in the order of their links, at most `limit` ids (0: all) of a folder in a batch.

    State: place (the link of the page to take, its number, how many of its ids were taken, how many of the folder); waiting (pages that came before their turn, or
    weren't taken whole); done (links of pages that were taken). A page that comes again is passed over.
    """

    def __init__(self, limit: int, remembered: int):
        self.limit, self.remembered = limit, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "link string, page long, taken long, seq long")
        self.waiting = handle.getMapState("waiting", "link string", "next string, delta string, ids array<string>")
        self.done = handle.getMapState("done", "link string", "seq long", self.remembered if self.limit else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, taken, held, size = self.stands()[0], set(), {}, 0
        new = not (self.place.exists() or self.waiting.exists() or self.done.exists())
        for pages in rows:
            for p in pages.itertuples(index=False):
                if p.link not in taken:
                    size += len(p.ids) + 1
                    held[p.link] = p.next, p.delta, p.ids
            if size >= HELD:
                yield from self.take(key[0], held, start, taken, new)
                self.keep(held, start, new)
                held, size, new = {}, 0, False
        yield from self.take(key[0], held, start, taken, new)
        self.keep(held, start, new)
        self.again(timerValues)

    def keep(self, held: dict, start: str, new: bool) -> None:
        """Pages wait that weren't taken before; new: a folder without states."""
        for link, (after, delta, ids) in held.items():
            if new or link == start or not self.done.containsKey((link,)):
                self.waiting.updateValue((link,), (after, delta, list(ids)))

    def stands(self) -> tuple:
        return self.place.get() if self.place.exists() else ("", 1, 0, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.take(key[0], {}, "", set(), False)
        self.again(timerValues)

    def again(self, timers) -> None:
        """Another batch goes on with what waits at the folder's place, also where no page comes."""
        if self.limit and self.waiting.containsKey((self.stands()[0],)):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1)

    def take(self, folder: str, held: dict, start: str, taken: set, new: bool) -> Iterator[pd.DataFrame]:
        """Rows of the pages from the folder's place on, out of those held (what is taken whole goes) and those that wait; each question to a state costs far more than a page."""
        (link, page, some, seq), left, out = self.stands(), self.limit or None, []
        while left is None or left > 0:
            found = held.get(link)
            if found is not None and not new and link != start and self.done.containsKey((link,)):
                found = None
            if found is None:
                found = None if new else self.waiting.getValue((link,))
                if found is None:
                    break
            after, delta, ids = found
            now = ids[some:] if left is None else ids[some : some + left]
            left = None if left is None else left - len(now)
            out += [(folder, page, seq + k, x, link) for k, x in enumerate(now, 1)]
            some, seq = some + len(now), seq + len(now)
            if some == len(ids):
                held.pop(link, None)
                taken.add(link)
                if not new:
                    self.waiting.removeKey((link,))
                self.done.updateValue((link,), (seq,))
                link, some = after or delta or link, 0
                out.append((folder, page, seq, None, link))
                page += 1
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        self.place.update((link, page, some, seq))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


@contextmanager
def states(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings with which a query of listed() is started, undone at the end; partitions: of the folders' states, no more than there are folders."""
    given = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    given |= {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pages(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """Page files (PAGES as JSON) below path as they come, so many in a batch."""
    return spark.readStream.schema(PAGES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).json(path)


def listed(found: DataFrame, limit: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """LISTED for a stream of PAGES: the ids of each folder's messages that weren't removed, in the order of its pages, each page once.

    Pages may come in any order and more than once. A page that isn't taken whole keeps its folder's place, so that a limit loses no id: the rest comes in
    later batches, by timers. Spark runs batches for timers without end, so a query with a limit is stopped by its owner; without one, availableNow ends. A null
    folder is the folder ""; pages without a link are a folder's first; messages without an id, and null values, are passed over; a page without messages moves
    the place. Other columns are ignored. Folders' states need RocksDB, so that waiting pages aren't held in memory: start the query inside states().
    """
    live = F.filter("value", lambda m: ~F.coalesce(m["removed"], F.lit(False)) & (F.coalesce(m["id"], F.lit("")) != ""))
    ids = F.coalesce(F.transform(live, lambda m: m["id"]), F.array().cast("array<string>"))
    whole = found.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("folder", "link", "next", "delta")], ids.alias("ids"))
    return whole.groupBy("folder").transformWithStateInPandas(Walk(limit, remembered), LISTED, "Append", "ProcessingTime" if limit else "None")


def places(out: DataFrame) -> DataFrame:
    """folder, taken, link: where each folder of LISTED rows stands; link is null where no page was taken whole."""
    moved = F.when(F.col("id").isNull(), F.col("page"))
    return out.groupBy("folder").agg(F.max("seq").alias("taken"), F.max_by("link", moved).alias("link"))
