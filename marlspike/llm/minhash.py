"""MinHash near-duplicates: banded candidates, verified by the parity bitmaps of odd sketches and then on whole sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import discard, map_batches, materialize, prepare, text_rows
from marlspike.llm.components import components
from marlspike.llm.jaccard_join import Filter, Shingler, linked, met_by, of_sets, passes, signature

#: Bands of a sketch and samples of a band: two sets at a similarity of 0.8 share no band with a probability of 7e-10.
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch of the samples and of one of the whole set; standard deviations from the first one's expected difference that are allowed.
SKETCH_BITS, WHOLE_BITS, SIGMAS = 512, 1024, 6
#: Words of the first sketch, before those of the second.
SAMPLED = SKETCH_BITS // 64
#: Sets and shingles of a part of a list that one task compares.
PART_SETS, PART_SHINGLES = 128, 1 << 20
#: Shingles that are sampled at a time.
AT_ONCE = 2048

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Sampler:
    """MinHash samples of a set of 64-bit shingle hashes, their bands and their odd sketch."""

    def __init__(self):
        drawn = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 32, (2, SAMPLES, 1), dtype=np.uint32)
        self.masks, self.factors = drawn[0], drawn[1] | np.uint32(1)

    def samples(self, s: np.ndarray) -> np.ndarray:
        """The least of the set's hashes under each of SAMPLES hash functions."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        parts = [((x[i : i + AT_ONCE] ^ self.masks) * self.factors).min(1) for i in range(0, len(x), AT_ONCE)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)

    @staticmethod
    def bands(v: np.ndarray) -> np.ndarray:
        """A hash of each band's samples and its number."""
        rows, h = v.reshape(BANDS, ROWS).astype(np.uint64), np.arange(1, BANDS + 1, dtype=np.uint64) * _C
        for k in range(ROWS):
            h = (h ^ rows[:, k]) * _A
            h ^= h >> np.uint64(29)
        return (h * _B).view(np.int64)

    @staticmethod
    def odd(v: np.ndarray) -> np.ndarray:
        """SKETCH_BITS bits: each sample flips one that its value and number choose, so that equal samples of two sketches leave no trace in their
        XOR."""
        h = (v.astype(np.uint64) ^ (np.arange(1, SAMPLES + 1, dtype=np.uint64) * _C)) * _A
        h = (h ^ (h >> np.uint64(32))) * _B
        return parity((h >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), SKETCH_BITS)

    def sketch(self, s: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The odd sketch of the samples and that of the whole set, which differs in no more bits than two sets do in members."""
        return np.concatenate([self.odd(v), parity((s >> np.uint64(8) & np.uint64(WHOLE_BITS - 1)).astype(np.int64), WHOLE_BITS)])


def parity(at: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of so many bits is flipped an odd number of times, as 64-bit words."""
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def similarity(differ: float) -> float:
    """The estimated Jaccard similarity of two sets whose odd sketches differ in so many bits."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differ / SKETCH_BITS, 1e-9))


def most_differing(percent: int) -> int:
    """Bits in which the odd sketches of two sets at the threshold differ at most, but for chances beyond SIGMAS standard deviations: those of the samples
    that differ and those of the bits that they flip."""
    j = percent / 100
    apart = SAMPLES * (1 - j)
    rest = math.exp(-4 * apart / SKETCH_BITS)
    spread = (2 * rest) ** 2 * SAMPLES * j * (1 - j) + SKETCH_BITS / 4 * (1 - rest**2)
    return math.ceil(SKETCH_BITS / 2 * (1 - rest) + SIGMAS * math.sqrt(spread))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """Stored doc_id, n, sig, bands, sketch; bands and sketch are null where the same task has sent the same set before, sig for empty sets."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, sampler, seen = Shingler(size), Sampler(), set()
        for b in batches:
            out: dict = {"doc_id": b["doc_id"], "n": [], "sig": [], "bands": [], "sketch": []}
            for text in b["text"].to_pylist():
                s = shingler(text)
                sig = signature(s) if len(s) else None
                bands = sketch = None
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    v = sampler.samples(s)
                    bands, sketch = sampler.bands(v), sampler.sketch(s, v)
                for k, x in (("n", len(s)), ("sig", sig), ("bands", bands), ("sketch", sketch)):
                    out[k].append(x)
            yield out

    return materialize(map_batches(text_rows(docs), run, "doc_id long, n long, sig long, bands array<long>, sketch array<long>"), "minhash-index")


def candidates(docs: DataFrame, index: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Stored sets that share a band with another: sig, n, tokens (such bands), sketch, home (the one of them that most sets share), part of home,
    shingles."""
    postings = index.where("bands is not null").select("sig", F.explode("bands").alias("token"))
    lists = postings.groupBy("token").agg(F.min("sig").alias("low"), F.max("sig").alias("high"), F.count("*").alias("sets")).where("low <> high")
    lists = materialize(lists.select("token", "sets"), "minhash-lists")
    met = met_by(postings, lists, ["token"], "sets").groupBy("sig").agg(F.collect_set("token").alias("tokens"), F.max_by("token", F.struct("sets", "token")).alias("home"))
    sketches = index.where("bands is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    live = materialize(met.join(sketches, "sig").join(nodes.select("sig", "rep"), "sig"), "minhash-live")
    discard(lists)
    sizes = live.groupBy("home").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("members") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("home", "members", parts.alias("parts")), "minhash-sizes")
    dealt = met_by(live, sizes, ["home"], "members").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    wanted = Filter(live.where("rep is not null").select(F.col("rep").alias("doc_id")), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, bits, seen = Shingler(size), shared.value.bytes(), set()
        for b in batches:
            rows = np.flatnonzero(b["unnamed"].to_numpy(zero_copy_only=False) | passes(bits, b["bit"].to_numpy()))
            sets = [s for x in b["text"].take(rows).to_pylist() if len(s := shingler(x))]
            sets = [(g, s) for s in sets if (g := signature(s)) not in seen and not seen.add(g)]
            if sets:
                yield {"sig": [g for g, _ in sets], "shingles": [s.tobytes() for _, s in sets]}

    rows = text_rows(docs).select("text", Filter.bit("doc_id").alias("bit"), F.isnull("doc_id").alias("unnamed"))
    sets = map_batches(rows, run, "sig long, shingles binary")
    out = materialize(dealt.drop("rep", "parts").join(sets, "sig").dropDuplicates(["sig"]), "minhash-sets")
    shared.destroy()
    discard(live, sizes)
    return out


def joins(sig: list[int], sketches: np.ndarray, sets: list[np.ndarray], percent: int, most: int) -> Iterator[tuple[int, int]]:
    """Links that join the sets of one part: each pair is compared by sketch, and on whole sets unless it is joined by then."""
    up, n = [*range(len(sets))], np.array([*map(len, sets)], np.int64)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
        differ = np.bitwise_count(sketches[j] ^ sketches[i])
        near = (differ[:, :SAMPLED].sum(1, dtype=np.int64) <= most) & ((100 + percent) * differ[:, SAMPLED:].sum(1, dtype=np.int64) <= (100 - percent) * (n[i] + n[j]))
        for k in j[near].tolist():
            if (a := root(i)) != (b := root(k)) and linked(sets[i], sets[k], percent):
                up[a] = b
                yield sig[i], sig[k]


def home_links(found: DataFrame, percent: int) -> DataFrame:
    """Stored edges (a, b) that join the linked sets of each part of a home list."""
    by, most = ("home", "part"), most_differing(percent)
    dealt = found.where("members > 1").select(*by, "sig", "sketch", "shingles").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        group: list[tuple] = []
        now = None

        def links() -> list[tuple[int, int]]:
            sig, sketch, sets = zip(*group, strict=True)
            return [*joins(sig, np.array(sketch, np.int64).view(np.uint64), [np.frombuffer(s, np.uint64) for s in sets], percent, most)]

        for b in batches:
            out: list[tuple[int, int]] = []
            for home, part, *row in zip(*(b[k].to_pylist() for k in (*by, "sig", "sketch", "shingles")), strict=True):
                if (home, part) != now:
                    out += links() if len(group) > 1 else []
                    group, now = [], (home, part)
                group.append(row)
            if out:
                yield {"a": [x for x, _ in out], "b": [y for _, y in out]}
        if len(group) > 1 and (out := links()):
            yield {"a": [x for x, _ in out], "b": [y for _, y in out]}

    return materialize(map_batches(dealt, run, "a long, b long"), "minhash-home-links")


def may_link(percent: int) -> Column:
    """Whether sets a and b may link by their sizes and odd sketches, and weren't compared in their home list."""
    differ = lambda words: sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in words), F.lit(0))
    sampled, whole = differ(range(SAMPLED)), differ(range(SAMPLED, SAMPLED + WHOLE_BITS // 64))
    sizes = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    apart = (F.col("a.home") != F.col("b.home")) | (F.col("a.part") != F.col("b.part"))
    return (F.col("a.label") != F.col("b.label")) & apart & sizes & (sampled <= most_differing(percent)) & ((100 + percent) * whole <= (100 - percent) * (F.col("a.n") + F.col("b.n")))


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Stored: those of pairs (a, b; stored) whose whole sets link."""
    shared = found.sparkSession.sparkContext.broadcast(Filter(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), "sig"))

    def wanted(batches: Iterator[dict]) -> Iterator[dict]:
        bits = shared.value.bytes()
        for b in batches:
            rows = np.flatnonzero(passes(bits, b["bit"].to_numpy()))
            yield {k: b[k].take(rows) for k in ("sig", "shingles")}

    kept = map_batches(found.select("sig", "shingles", Filter.bit("sig").alias("bit")), wanted, "sig long, shingles binary")
    sets = lambda name: kept.select(F.col("sig").alias(name), F.col("shingles").alias(f"{name}_set"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            read = lambda v: [np.frombuffer(x, np.uint64) for x in v.to_pylist()]
            ok = [linked(x, y, percent) for x, y in zip(read(b["a_set"]), read(b["b_set"]), strict=True)]
            yield {k: [v for v, x in zip(b[k].to_pylist(), ok, strict=True) if x] for k in ("a", "b")}

    out = materialize(map_batches(pairs.join(sets("a"), "a").join(sets("b"), "b"), run, "a long, b long"), "minhash-links")
    shared.destroy()
    return out


def unjoined(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored rows (token, sig, n, home, part, sketch, label) of the bands whose sets are of several components so far, with top, the component of most of
    the band's sets."""
    rows = found.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", "home", "part", "sketch", F.coalesce("label", "sig").alias("label"), F.explode("tokens").alias("token"))
    each = rows.groupBy("token", "label").agg(F.count("*").alias("sets"))
    mixed = each.groupBy("token").agg(F.sum("sets").alias("sets"), F.max_by("label", F.struct("sets", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed = materialize(mixed.select("token", "sets", "top"), "minhash-mixed-bands")
    out = materialize(met_by(rows, mixed, ["token"], "sets").drop("sets"), "minhash-mixed")
    discard(mixed)
    return out


def paired(a: DataFrame, b: DataFrame, percent: int, more: Column) -> DataFrame:
    """Pairs of sets of a and b that share a band and may link, each once."""
    met = a.alias("a").join(b.alias("b"), (F.col("a.token") == F.col("b.token")) & may_link(percent) & more)
    return met.select(F.least("a.sig", "b.sig").alias("a"), F.greatest("a.sig", "b.sig").alias("b")).distinct()


def band_links(found: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Stored: edges (a, b; stored) and what else joins sets that share a band, in two rounds.

    In the first, a set of each component of a band is compared with one of the band's largest component. The second compares all the pairs that are of
    different components still; those within a band's largest component never meet, so a group of copies gives no pairs.
    """
    labels = materialize(components(edges), "minhash-labels")
    rows = unjoined(found, labels)
    whole = F.struct("sig", "n", "home", "part", "sketch")
    one = rows.groupBy("token", "label", "top").agg(F.min(whole).alias("x")).select("token", "label", "top", "x.*")
    tried = materialize(paired(one.where("label <> top"), one.where("label = top"), percent, F.lit(True)), "minhash-first-pairs")
    links = verified(tried, found, percent)
    after = materialize(components(labels.toDF("a", "b").union(links)), "minhash-labels")
    discard(rows)
    rows = unjoined(found, after)
    once = (F.col("b.label") == F.col("b.top")) | (F.col("a.sig") < F.col("b.sig"))
    rest = paired(rows.where("label <> top"), rows, percent, once).join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest, "minhash-pairs")
    more = verified(rest, found, percent)
    out = materialize(after.toDF("a", "b").union(more), "minhash-edges")
    discard(labels, rows, tried, links, after, rest, more)
    return out


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Per document doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id).

    Two documents link when 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z lower-cased; a shorter text is one shingle; null,
    empty and blank texts have none and link with nothing). Equal sets are one node, known by a 64-bit hash of the set. Sets that share one of BANDS bands
    of MinHash samples are candidates; odd sketches of the samples and of the sets end those below the threshold, and the others are confirmed on whole sets.
    Sets are compared in parts of the longest band list that each is in; then, band by band, those that aren't joined. A null doc_id takes part, gets its
    component's smallest doc_id, if any, and is kept where there is none; repeated rows are equal sets; other columns are ignored; an empty table gives
    no rows.
    """
    prepare(docs.sparkSession)
    index = sketched(docs, size)
    nodes = materialize(index.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "minhash-nodes")
    found = candidates(docs, index, nodes, size)
    first = home_links(found, percent)
    edges = band_links(found, first, percent)
    labels = materialize(components(edges), "minhash-components")
    discard(found, first, edges)
    whole = labels.join(nodes, labels["node"] == nodes["sig"]).select("sig", "label", "rep")
    least = whole.groupBy("label").agg(F.min("rep").alias("component_id"))
    grouped = whole.join(least, "label").select("sig", "component_id")
    named = materialize(nodes.join(grouped, "sig", "left").select("sig", "docs", F.coalesce("component_id", "rep").alias("component_id")), "minhash-named")
    out = of_sets(index, named, "component_id").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
