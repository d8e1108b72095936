"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.llm.common import discard, map_batches, materialize, prepare, text_rows, words_of
from marlspike.llm.components import components

#: Cells of the frequency sketches of shingles and of words that order shingles (2 bytes each before compression, as broadcast), sent in CHUNKS pieces.
SHINGLE_BITS, WORD_BITS, CHUNKS = 22, 23, 96
#: Partitions by which sets are compared before they are fetched.
BINS = 128
#: Bits of the filter that tells which documents' sets are needed.
FILTER_BITS = 25
#: Members and shingles of a block of a posting list; lists beyond are compared block by block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 19
#: Live prefix shingles that a member carries to tell which list owns a pair.
OWN = 8
#: Sets of more documents than HEAVY_DOCS and a HEAVY_SETS-th of all documents are sent to all tasks, as are lists of so many rows: HEAVY_SETS of them at most.
HEAVY_DOCS, HEAVY_SETS = 500, 500_000
WORDS_KEPT = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Shingler:
    """Sorted sets of 64-bit hashes of word shingles, with a bounded table of word hashes."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        known = self.words
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def shingles(self, at: np.ndarray) -> np.ndarray:
        """A hash for each shingle of a sequence of word hashes, in order."""
        if not len(at):
            return at
        n = min(self.size, len(at))
        h = np.full(len(at) - n + 1, n, np.uint64)  # shorter sequences are hashed unlike the shingles of longer ones
        for k in range(n):
            h = (h ^ at[k : len(at) - n + 1 + k]) * _A
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * _B
        return h ^ (h >> np.uint64(31))

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.shingles(self.word_hashes(text)))

    def rarities(self, text: str | None, frequent: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """The set, and for each member the least of the counts that bound its documents: its own and its words'."""
        at = self.word_hashes(text)
        found, first = np.unique(self.shingles(at), return_index=True)
        if not len(found):
            return found, np.zeros(0, np.uint32)
        bound, words = frequent.shingles[cell(found, SHINGLE_BITS)], frequent.words[cell(at, WORD_BITS)]
        for k in range(min(self.size, len(at))):
            bound = np.minimum(bound, words[first + k])
        return found, bound


class Frequencies(NamedTuple):
    """Occurrences by cell, up to 65,535; a cell's count is no less than that of any shingle or word in it, if that is no more."""

    shingles: np.ndarray
    words: np.ndarray

    def packed(self) -> tuple[bytes, ...]:
        return tuple(zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in self)

    @classmethod
    def of(cls, packed: tuple[bytes, ...]) -> Frequencies:
        return cls(*(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint16) for x in packed))


def cell(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def signature(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def least_share(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def parities(s: np.ndarray) -> np.ndarray:
    """The suffix filter's partition: the parity of the set's members in each of 256 partitions of the hash range, as four words.

    Two sets differ in at least as many members as they differ in parities.
    """
    odd = np.bincount((s >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def spread(s: np.ndarray) -> np.ndarray:
    """Members of the set in each of BINS partitions of the hash range, 127 at most: two sets differ in at least as many members as these
    counts do."""
    return np.minimum(np.bincount((s >> np.uint64(20) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 127).astype(np.int8)


def frequencies(docs: DataFrame, size: int) -> Frequencies:
    """Shingles and words of all documents by cell: tasks count, and the counts are added up as they stream in, in CHUNKS pieces."""
    spark = docs.sparkSession
    n_shingle, n_all = 1 << SHINGLE_BITS, (1 << SHINGLE_BITS) + (1 << WORD_BITS)

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, cells = Shingler(size), np.zeros(n_all, np.uint32)
        for b in batches:
            for x in b["text"].to_pylist():
                at = shingler.word_hashes(x)
                np.add.at(cells, cell(np.unique(shingler.shingles(at)), SHINGLE_BITS), np.uint32(1))
                np.add.at(cells, n_shingle + cell(at, WORD_BITS), np.uint32(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, part in enumerate(np.split(cells, CHUNKS)):
            if part.any():
                yield {"chunk": [k], "cells": [pack(part.tobytes())]}

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        read = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, x in zip(b["chunk"].to_pylist(), b["cells"].to_pylist(), strict=True):
                part = np.frombuffer(read(x), np.uint32).astype(np.uint64)
                total[k] = total[k] + part if k in total else part
        for k, x in total.items():
            yield {"chunk": [k], "cells": [np.minimum(x, 0xFFFF).astype(np.uint16).tobytes()]}

    schema = "chunk int, cells binary"
    counted = map_batches(text_rows(docs).select("text"), count, schema)
    counted = map_batches(counted.repartition(min(CHUNKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk"), add, schema)
    out = np.zeros((CHUNKS, n_all // CHUNKS), np.uint16)
    for r in counted.toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["cells"], np.uint16)
    return Frequencies(out.ravel()[:n_shingle], out.ravel()[n_shingle:])


def indexed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored rows doc_id, n, sig, bins (spread()), prefix (array<struct<pos, token>>): the first n - least_share + 1 shingles, rarest first.

    None is left out by its count: a fixed number of cells is shared by ever more shingles, so such a cut works on small inputs alone. bins and prefix
    are null where the same task has sent the same set before; sig is null for empty sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size).packed())

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, frequent, seen = Shingler(size), Frequencies.of(shared.value), set()
        for b in batches:
            out = {"doc_id": b["doc_id"], "n": [], "sig": [], "bins": [], "pos": [], "token": []}
            for x in b["text"].to_pylist():
                s, bound = shingler.rarities(x, frequent)
                sig = signature(s) if len(s) else None
                bins = pos = token = None
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    bins = spread(s)
                    rarity = (bound.astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
                    first = np.argsort(rarity, kind="stable")[: len(s) - least_share(len(s), percent) + 1]
                    pos, token = np.arange(len(first)), s[first].view(np.int64)
                out["n"].append(len(s))
                out["sig"].append(sig)
                out["bins"].append(bins)
                out["pos"].append(pos)
                out["token"].append(token)
            yield out

    rows = map_batches(text_rows(docs), run, "doc_id long, n long, sig long, bins array<tinyint>, pos array<int>, token array<long>")
    out = materialize(rows.select("doc_id", "n", "sig", "bins", F.arrays_zip("pos", "token").alias("prefix")), "jaccard-index")
    shared.destroy()
    return out


class Filter:
    """2 ** FILTER_BITS bits, one set for each key that is wanted; others pass by chance."""

    def __init__(self, keys: DataFrame, name: str):
        """Bits are gathered in words, which are combined before the shuffle: the driver gets the filter's size at most."""
        bit = Filter.bit(name)
        words = keys.select((bit / 64).cast("int").alias("word"), F.lit(1).cast("long").alias("one"), (bit % 64).cast("int").alias("shift"))
        words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", "one", "shift")).alias("bits")).toArrow()
        bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.packed = zstandard.ZstdCompressor(level=1).compress(bits.tobytes())

    @staticmethod
    def bit(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS)).cast("int")

    def bytes(self) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed), np.uint8)


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def size_range(percent: int) -> Column:
    """Sets whose ranges aren't the same or neighbours differ too much in size to link."""
    return F.floor(F.log("n") / math.log(100 / percent)).cast("int")


def fitting(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (low, high) whose sizes and partition counts leave room for a link.

    Most lists of two sets are chance meetings of large documents, which grow faster than the input; this ends them while they are pairs of
    numbers.
    """
    one = lambda name: index.where("bins is not null").groupBy(F.col("sig").alias(name)).agg(F.first("n").alias(f"{name}_n"), F.first("bins").alias(f"{name}_bins"))
    both = pairs.join(one("low"), "low").join(one("high"), "high")
    differ = F.aggregate(F.zip_with("low_bins", "high_bins", lambda a, b: F.abs(a - b)), F.lit(0), lambda t, x: t + x)
    small, large = F.least("low_n", "high_n"), F.greatest("low_n", "high_n")
    return both.where((100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (small + large))).select("low", "high")


def shared_postings(index: DataFrame) -> DataFrame:
    """sig, n, pos, token of the prefix shingles that different sets have, with df: the rows of the shingle.

    Most shingles are one set's alone, so postings are made and shuffled once: rows sorted by shingle in their partition are told how many there are of
    theirs, and only those that stay are stored. Rows of a very frequent shingle are spilled, not held.
    """
    postings = index.where("prefix is not null").select("sig", "n", F.explode("prefix").alias("x")).select("sig", "n", "x.pos", "x.token")
    of_token = Window.partitionBy("token")
    counted = postings.select("*", F.min("sig").over(of_token).alias("low"), F.max("sig").over(of_token).alias("high"), F.count("*").over(of_token).alias("df"))
    return counted.where("low <> high").drop("low", "high")


def members(docs: DataFrame, index: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored rows of the sets that share a prefix shingle with another of fitting size: sig, n, live (array<struct<pos, token>> in order),
    home, keys, parity, shingles.

    home is the longest of the posting lists that a set is in, keys the blocks of it that the set belongs to. Texts are read again for
    the sets; those of other documents are left out by a filter of bounded size before anything is made of them.
    """
    # length filter: sets link only within a size range or between neighbouring ones, so a posting must meet another there
    keyed = shared_postings(index).withColumn("range", F.explode(F.array(size_range(percent), size_range(percent) + 1)))
    keyed = materialize(keyed, "jaccard-postings")
    met = keyed.groupBy("token", "range").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.count("*").alias("rows")).where("low <> high")
    met = materialize(met, "jaccard-lists")
    fit = fitting(met.where("rows = 2").select("low", "high").distinct(), index, percent)
    lists = met.where("rows > 2").select("token", "range", "rows").union(met.where("rows = 2").join(fit, ["low", "high"]).select("token", "range", "rows"))
    lists = materialize(lists, "jaccard-open-lists")
    live = met_by(keyed, lists, ["token", "range"], "rows").groupBy("sig", "n").agg(
        F.array_sort(F.collect_set(F.struct("pos", "token"))).alias("live"), F.max_by("token", F.struct("df", "token")).alias("home")
    )
    live = materialize(live, "jaccard-live")
    discard(keyed, met, lists)
    wanted = Filter(live.join(nodes, "sig").where("rep is not null").select(F.col("rep").alias("doc_id")), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = text_rows(docs).select("text", Filter.bit("doc_id").alias("bit"), F.isnull("doc_id").alias("unnamed"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, bits, seen = Shingler(size), shared.value.bytes(), set()
        for b in batches:
            rows = np.flatnonzero(b["unnamed"].to_numpy(zero_copy_only=False) | passes(bits, b["bit"].to_numpy()))
            sets = [s for x in b["text"].take(rows).to_pylist() if len(s := shingler(x))]
            sets = [(g, s) for s in sets if (g := signature(s)) not in seen and not seen.add(g)]
            if sets:
                yield {"sig": [g for g, _ in sets], "parity": [parities(s) for _, s in sets], "shingles": [s.tobytes() for _, s in sets]}

    sets = map_batches(rows, run, "sig long, parity array<long>, shingles binary")
    dealt, sizes = blocks(live, percent)
    out = materialize(dealt.join(sets, "sig").dropDuplicates(["sig"]), "jaccard-members")
    shared.destroy()
    discard(live, sizes)
    return out


class Members:
    """Members of one list or of two of its blocks, and the links among them."""

    def __init__(self, sig: np.ndarray, side: np.ndarray, parity: np.ndarray, sets: list[np.ndarray], percent: int, labels: tuple):
        """labels: of what is joined already, those of one component are equal."""
        self.sig, self.side, self.parity, self.sets, self.percent = sig, side, parity, sets, percent
        self.n = np.array([*map(len, sets)], np.int64)
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def links(self, two: bool, every: bool = False) -> Iterator[tuple[int, int]]:
        """Every link, or those that join what isn't joined yet. two: only between side 0 and side 1, each of which is compared in itself
        elsewhere."""
        m = len(self.sets)
        for i in range(m - 1):
            j = np.arange(i + 1, m)
            if two:
                j = j[self.side[j] != self.side[i]]
            j = j[(100 * np.minimum(self.n[i], self.n[j]) >= self.percent * np.maximum(self.n[i], self.n[j])) & (self.sig[i] != self.sig[j])]
            differ = np.bitwise_count(self.parity[j] ^ self.parity[i]).sum(1, dtype=np.int64)
            for k in j[differ * (100 + self.percent) <= (100 - self.percent) * (self.n[j] + self.n[i])].tolist():
                a, b = (i, k) if every else (self.root(i), self.root(k))
                if a != b and linked(self.sets[i], self.sets[k], self.percent):
                    if not every:
                        self.up[a] = b
                    yield int(self.sig[i]), int(self.sig[k])

    def joins(self, two: bool) -> list[tuple[int, int]]:
        """What links() joins, as edges to the least of those that are joined: a member of each component that there was, not every member."""
        apart = [i for i in range(len(self.sets)) if self.up[i] == i]
        if not sum(1 for _ in self.links(two)):
            return []
        least: dict[int, int] = {}
        for i in apart:
            r = self.root(i)
            least[r] = min(least.get(r, int(self.sig[i])), int(self.sig[i]))
        return [(int(self.sig[i]), least[self.root(i)]) for i in apart if least[self.root(i)] != int(self.sig[i])]


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def blocks(live: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """live (sig, n, home, …) with keys, and the stored sizes of the ranges. Keys are the pairs of blocks of its home list that a set belongs to; none where it would be alone.

    Members are dealt by size range, as sets whose sizes are further apart can't link, and beyond a block's bounds by hash. A key
    names its two blocks (two: of neighbouring ranges, low: the lower range, i and j) and the side that the set is on.
    """
    rows = live.withColumn("range", size_range(percent))
    sizes = rows.groupBy("home", "range").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    stored = sizes = materialize(sizes.select("home", "range", parts.alias("parts"), "members"), "jaccard-ranges")
    near = lambda k, name: stored.select("home", (F.col("range") + k).alias("range"), F.col("parts").alias(name))
    sizes = sizes.join(near(-1, "after"), ["home", "range"], "left").join(near(1, "before"), ["home", "range"], "left")
    sizes = sizes.select("home", "range", "parts", "after", "before", F.when(F.col("members") > 1, F.col("parts")).alias("inside"))
    rows = rows.join(sizes, ["home", "range"]).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))

    def key(two: int, low: Column, a: Column, b: Column, side: Column) -> Column:
        return F.struct(F.lit(two).alias("two"), low.alias("low"), a.alias("i"), b.alias("j"), side.cast("int").alias("side"))

    def each(n: str, f: Callable[[Column], Column]) -> Column:
        count = F.coalesce(n, F.lit(0))
        none = F.array().cast("array<struct<two:int,low:int,i:int,j:int,side:int>>")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), f)).otherwise(none)

    own, r = F.col("part"), F.col("range")
    keys = F.concat(
        each("inside", lambda k: key(0, r, F.least(own, k), F.greatest(own, k), own > k)),
        each("after", lambda k: key(1, r, own, k, F.lit(0))),
        each("before", lambda k: key(1, r - 1, k, own, F.lit(1))),
    )
    return rows.withColumn("keys", keys).select(*live.columns, "keys"), stored


#: The keys of the first round of home_links: each block in itself and with the next one of its range.
FIRST = "k.two = 0 and k.j - k.i <= 1"


def joined_links(found: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join the linked members of each home list, in two rounds.

    The first compares each block of a list in itself and with the next one, which joins nearly all of a group of copies with work in proportion to
    the list. The second compares the other pairs of blocks that still hold two components or more, without the pairs that are joined.
    """
    first = home_links(found, percent, FIRST)
    labels = materialize(components(first), "jaccard-home-labels")
    rest = found.select("home", "sig", F.explode("keys").alias("k")).where(f"not ({FIRST})").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    by = ("home", "two", "low", "i", "j")
    rest = rest.select("home", "k.*", F.coalesce("label", "sig").alias("label")).groupBy(*by).agg(F.min("label").alias("least"), F.max("label").alias("most"))
    open_ = materialize(rest.where("least <> most").select(*by), "jaccard-open-blocks")
    second = home_links(found, percent, f"not ({FIRST})", labels, open_)
    discard(first, open_)
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second)


def home_links(found: DataFrame, percent: int, keys: str = "true", labels: DataFrame | None = None, only: DataFrame | None = None, every: bool = False) -> DataFrame:
    """Stored edges (a, b) that join the linked members of each home list, every pair of which is compared unless it is joined already; every: all
    links of the list themselves. keys: a condition on the pairs of blocks to compare (k); only: those pairs themselves; labels (node, label): what is
    joined so far."""
    by = ("home", "two", "low", "i", "j")
    dealt = found.select("home", "sig", "parity", "shingles", F.explode("keys").alias("k")).where(keys).select("home", "k.*", "sig", "parity", "shingles")
    if only is not None:
        dealt = dealt.join(only, [*by], "left_semi")
    dealt = dealt.withColumn("label", F.col("sig")) if labels is None else dealt.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        group: list[tuple] = []
        now = None

        def links() -> list[tuple[int, int]]:
            sig, side, parity, sets, label = zip(*group, strict=True)
            m = Members(np.array(sig), np.array(side), np.array(parity, np.int64).view(np.uint64), [np.frombuffer(s, np.uint64) for s in sets], percent, label)
            two = now[1] == 1 or now[3] != now[4]
            return [*m.links(two, every)] if every else m.joins(two)

        for b in batches:
            out: list[tuple[int, int]] = []
            cols = {k: v.to_pylist() for k, v in b.items()}
            for row in zip(*(cols[k] for k in by), cols["sig"], cols["side"], cols["parity"], cols["shingles"], cols["label"], strict=True):
                if row[:5] != now:
                    out += links() if len(group) > 1 else []
                    group, now = [], row[:5]
                group.append(row[5:])
            if out:
                yield {"a": [x for x, _ in out], "b": [y for _, y in out]}
        if len(group) > 1 and (out := links()):
            yield {"a": [x for x, _ in out], "b": [y for _, y in out]}

    return materialize(map_batches(dealt, run, "a long, b long"), "jaccard-home-links")


def other_links(found: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between members of different home lists and, so far, different components; labels None: of any components.

    Pairs meet on a live prefix shingle; the list of their first common one owns them. Length, positional and suffix filters
    come before a pair is made, and each pair is verified once, on whole sets.
    """
    own = F.transform(F.slice("live", 1, OWN), lambda x: x["token"])
    known = found.withColumn("label", F.lit(None).cast("long")) if labels is None else found.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    rows = known.select(  # without labels each set is a component of its own
        "sig", "n", "home", "parity", own.alias("own"), F.coalesce("label", "sig").alias("label"), F.explode("live").alias("x")
    ).select("sig", "n", "home", "parity", "own", "label", "x.token", "x.pos")
    mixed = rows.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("rows"))
    mixed = materialize(mixed.where("low <> high and l <> h").select("token", "rows"), "jaccard-mixed-lists")
    rows = materialize(met_by(rows, mixed, ["token"], "rows").drop("rows"), "jaccard-mixed")
    discard(mixed)
    a, b = rows.where("home <> token").alias("a"), rows.alias("b")
    total = F.col("a.n") + F.col("b.n")
    differ = sum((F.bit_count(F.col("a.parity")[k].bitwiseXOR(F.col("b.parity")[k])) for k in range(4)), F.lit(0))
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    owner = F.coalesce(F.get(F.array_intersect("a.own", "b.own"), F.lit(0)), F.col("a.token"))
    meet = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.home") != F.col("b.home"))
        & (F.col("a.label") != F.col("b.label"))
        & ((F.col("b.home") == F.col("b.token")) | (F.col("a.sig") < F.col("b.sig")))
        & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))  # length
        & ((100 + percent) * rest >= percent * total)  # positional: what is left of the shorter rest must suffice
        & ((100 + percent) * differ <= (100 - percent) * total)  # suffix: partitions that differ in parity
        & (owner == F.col("a.token"))
    )
    pairs = a.join(b, meet).select(F.least("a.sig", "b.sig").alias("a"), F.greatest("a.sig", "b.sig").alias("b")).distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    shared = found.sparkSession.sparkContext.broadcast(Filter(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), "sig"))

    def wanted(batches: Iterator[dict]) -> Iterator[dict]:
        bits = shared.value.bytes()
        for c in batches:
            rows = np.flatnonzero(passes(bits, c["bit"].to_numpy()))
            yield {k: c[k].take(rows) for k in ("sig", "shingles")}

    kept = map_batches(found.select("sig", "shingles", Filter.bit("sig").alias("bit")), wanted, "sig long, shingles binary")
    sets = lambda name: kept.select(F.col("sig").alias(name), F.col("shingles").alias(f"{name}_set"))
    checked = pairs.join(sets("a"), "a").join(sets("b"), "b")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for c in batches:
            read = lambda v: [np.frombuffer(x, np.uint64) for x in v.to_pylist()]
            ok = [linked(x, y, percent) for x, y in zip(read(c["a_set"]), read(c["b_set"]), strict=True)]
            yield {k: [v for v, x in zip(c[k].to_pylist(), ok, strict=True) if x] for k in ("a", "b")}

    out = materialize(map_batches(checked, run, "a long, b long"), "jaccard-other-links")
    shared.destroy()
    discard(rows, pairs)
    return out


def met_by(rows: DataFrame, lists: DataFrame, key: list[str], size: str) -> DataFrame:
    """rows joined with lists (stored; key, size: how many of rows each has), each key once. Very long lists are sent to all tasks, so that none is
    gathered by the join; their number is bounded as their sizes add up to that of rows."""
    total = lists.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) > max(HEAVY_DOCS, total // HEAVY_SETS)
    both = rows.join(F.broadcast(lists.where(heavy).withColumn("sent", F.lit(True))), key, "left")
    rest = both.where("sent is null").select(*rows.columns).join(lists.where(~heavy), key)
    return both.where("sent").drop("sent").unionByName(rest)


def of_sets(index: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """The rows of index with columns of sets (stored; sig, docs, …), null where the document's set is empty or isn't among them.

    Sets of very many documents are sent to all tasks, so that copies of one text are never gathered; sets of fewer meet their documents by a join,
    from which documents without a word are kept apart.
    """
    total = sets.agg(F.sum("docs")).first()[0] or 0
    heavy = F.col("docs") > max(HEAVY_DOCS, total // HEAVY_SETS)
    sent = sets.where(heavy).select("sig", F.lit(True).alias("sent"), *columns)
    rows = index.select("doc_id", "n", "sig").join(F.broadcast(sent), "sig", "left")
    apart = F.col("sig").isNull() | F.col("sent").isNotNull()
    rest = rows.where(~apart).drop("sent", *columns).join(sets.where(~heavy).select("sig", *columns), "sig", "left")
    return rows.where(apart).select("doc_id", "n", *columns).union(rest.select("doc_id", "n", *columns))


def compared(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored: the documents' index, the distinct sets (sig, rep: smallest doc_id, docs: how many), and the members that may link."""
    prepare(docs.sparkSession)
    index = indexed(docs, size, percent)
    nodes = materialize(index.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "jaccard-nodes")
    return index, nodes, members(docs, index, nodes, size, percent)


def every_link(found: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between distinct sets; each candidate pair is verified once, in the home list of both or else where they meet."""
    return home_links(found, percent, every=True).union(other_links(found, None, percent))


def jaccard_links(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The join itself: a row for each link between distinct sets of shingles, a_set < b_set (their hashes), a_doc, b_doc (the smallest doc_id
    that has the set, null if none), a_docs, b_docs (documents that have it: a_docs * b_docs pairs of documents link).

    Links, and what makes a document's set, are as in jaccard_join, which skips pairs that are joined already and so finds components with
    fewer comparisons. A group of m different near copies has up to m * (m - 1) / 2 rows here.
    """
    _, nodes, found = compared(docs, size, percent)
    links = every_link(found, percent).select(F.least("a", "b").alias("a_set"), F.greatest("a", "b").alias("b_set"))
    one = lambda k: nodes.select(F.col("sig").alias(f"{k}_set"), F.col("rep").alias(f"{k}_doc"), F.col("docs").alias(f"{k}_docs"))
    return links.join(one("a"), "a_set").join(one("b"), "b_set").select("a_set", "b_set", "a_doc", "b_doc", "a_docs", "b_docs")


def link_counts(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document doc_id, n_shingles, n_links: the other documents it links with, those of an equal set among them; 0 for empty sets."""
    index, nodes, found = compared(docs, size, percent)
    links = every_link(found, percent)
    ends = links.union(links.select("b", "a")).toDF("sig", "other")
    others = ends.join(nodes.select(F.col("sig").alias("other"), "docs"), "other").groupBy("sig").agg(F.sum("docs").alias("linked"))
    counts = materialize(nodes.join(others, "sig", "left").select("sig", "docs", (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "jaccard-counts")
    return of_sets(index, counts, "n_links").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per document doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z lower-cased; a
    shorter text is one shingle; null, empty and blank texts have none and link with nothing, so component_id is doc_id). Equal sets
    are one node, known by a 64-bit hash of the set, and are never compared. Prefixes hold each set's rarest shingles: a
    shingle's documents are bounded by the counts, over all documents, of its cell and of its words' cells. A bound that is
    too high changes the order alone, which is the same for every set, and so no link is lost. Sets that share a prefix shingle are compared in the longest list that each is in, block by block; the other
    pairs follow if they aren't joined by then. A null doc_id takes part and gets its component's smallest doc_id, if any; repeated
    rows are equal sets; other columns are ignored; an empty table gives no rows.
    """
    index, nodes, found = compared(docs, size, percent)
    near = materialize(components(joined_links(found, percent)), "jaccard-near")
    other = other_links(found, near, percent)
    labels = materialize(components(near.toDF("a", "b").union(other)), "jaccard-labels")
    discard(found, near, other)
    whole = labels.join(nodes, labels["node"] == nodes["sig"]).select("sig", "label", "rep")
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    grouped = whole.join(least, "label").select("sig", "component_id")
    named = materialize(nodes.join(grouped, "sig", "left").select("sig", "docs", F.coalesce("component_id", "rep").alias("component_id")), "jaccard-named")
    return of_sets(index, named, "component_id").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with the smallest doc_id of each component, and each of its distinct texts once.

    Documents without doc_id can't be named by a component: each of their distinct texts stays once.
    """
    joined = jaccard_join(docs, size, percent)
    kept = joined.where("doc_id = component_id").select("doc_id").distinct()
    rows = text_rows(docs, "lang", "source", "n_chars")
    stay = rows.join(kept, "doc_id", "left_semi").unionByName(rows.where("doc_id is null")).withColumn("text_hash", F.xxhash64("text"))
    again = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("source", "lang"))
    return stay.withColumn("again", again).where("again = 1").drop("again", "text_hash")
