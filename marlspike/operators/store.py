"""The leaf store: segments of leafs in Parquet folders that never change, and numbered versions that name the folders."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.functions.text import file_id, leaf_id, normal_day, or_else, text, text_hash
from marlspike.lease import Lost, create
from marlspike.operators.blocks import small
from marlspike.operators.retrieval import sums_of, tokens
from marlspike.operators.segments import SHARE, SegmentWords, near_vectors, write_blocks, write_lists
from marlspike.schema import EDGES, LEAFS
from marlspike.session import hadoop


def complete(new: DataFrame, now: str, *more: str) -> DataFrame:
    """Rows of any of the store's columns as whole leafs: UTF-8 repaired, defaults set, days normalised, id and hash made; more: columns to keep."""
    for c in LEAFS.fieldNames():
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(LEAFS[c].dataType))
    body, source = F.make_valid_utf8(text("text")), F.trim(text("source"))
    default = {"root": "info", "confidence": "", "source_rev": "", "how": "unknown", "loc": "", "type": "reference"}
    out = new.select(
        leaf_id(source, body).alias("id"), body.alias("text"), source.alias("source"), text_hash(body).alias("sha256"),
        *[or_else(text(c), d).alias(c) for c, d in default.items()], or_else(text("observed_at"), now).alias("observed_at"),
        normal_day(F.col("valid_from")).alias("valid_from"), normal_day(F.col("valid_to")).alias("valid_to"), F.col("embedding").cast("array<float>").alias("embedding"), *more,
    )
    return out.select(*LEAFS.fieldNames(), *more)


def lacking() -> Column:
    """Rows that can't be leafs, as they have no text or no source."""
    return (F.trim(text("text")) == "") | (F.trim(text("source")) == "")


def invalid(new: DataFrame) -> DataFrame:
    return new.where(lacking())


def last_of(new: DataFrame, seq: str = "") -> DataFrame:
    """Of each id the last row, with the last embedding that is given; seq: as upsert() has it."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    new = new.withColumn("_seq", order).drop(*([seq] if seq else []))
    return new.groupBy("id").agg(*[F.max_by(c, "_seq").alias(c) for c in new.columns if c not in ("id", "embedding", "_seq")], F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("_seq"))).alias("embedding"))


def upsert(old: DataFrame, new: DataFrame, seq: str = "") -> DataFrame:
    """old with the rows of new, by id: the last of new wins, and an embedding stays unless a new one is given.

    seq: a column of new that tells which row is last; without it rows are taken in the order of their partitions, as read from files.
    """
    newest = last_of(new, seq)
    n = newest.select("id", *[F.col(c).alias(f"_{c}") for c in newest.columns if c != "id"], F.lit(True).alias("_new"))
    joined = old.join(n, "id", "full")
    pick = lambda c: F.coalesce(f"_{c}", c) if c == "embedding" else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select("id", *[pick(c).alias(c) for c in old.columns if c != "id"])


def missing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows whose id the store lacks: what a resumed run still has to embed and write."""
    return new.join(old.select("id"), "id", "left_anti")


def link_files(leafs: DataFrame, path: str = "path", repo: str = "repo") -> tuple[DataFrame, DataFrame]:
    """File nodes (id, path, repo) and edges (src, dst) of leafs, each once."""
    f = leafs.withColumn("_file", file_id(F.col(repo), F.col(path)))
    return f.select(F.col("_file").alias("id"), path, repo).dropDuplicates(["id"]), f.select(F.col("id").alias("src"), F.col("_file").alias("dst")).dropDuplicates()


def link_commits(commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges file to commit and commit to person, and persons, of commits (id, repo, author, email, files)."""
    files = commits.select(F.explode("files").alias("path"), "repo", F.col("id").alias("dst"))
    has_version = files.select(file_id(F.col("repo"), F.col("path")).alias("src"), "dst").distinct()
    person = or_else(F.lower(text("email")), F.lower(text("author")))
    persons = commits.select(person.alias("id"), F.col("author").alias("name"), "email").dropDuplicates(["id"])
    return has_version, commits.select(F.col("id").alias("src"), person.alias("dst")).distinct(), persons


def merge_edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of which both ends exist, without repeats."""
    there = new.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return old.unionByName(there.select(*EDGES.fieldNames())).dropDuplicates()


#: Rows of a batch unless another size is asked for.
BATCH = 64
DEAD = "segment string, id string, len int, terms array<string>"


class Conflict(Exception):
    """Another writer made the next version first."""


#: Rows of a file of leafs, and seconds that a folder which no version names is spared, as a run that is still at work may be about to name it.
FILE_ROWS, SPARE = 1_000_000, 24 * 3600
EMPTY = {"segments": [], "dead": [], "indexed": False, "tables": {}}


def without(names: dict, keys: set[str]) -> dict:
    """What a version names, less the segments of these keys and their tombstones."""
    dead = [d | {"by": {k: v for k, v in d["by"].items() if k not in keys}} for d in names["dead"]]
    return names | {"segments": [x for x in names["segments"] if x["key"] not in keys], "dead": [d for d in dead if d["by"]]}


class Snapshot:
    """What one version of a store holds; later versions don't change it."""

    def __init__(self, store: Store, names: dict):
        self.store, self.spark, self.names = store, store.spark, names

    def _at(self, path: str) -> str:
        return f"{self.store.path}/{path}"

    def dead(self) -> DataFrame | None:
        """(segment, id, len, terms) of leafs that a later segment replaced or that were removed."""
        paths = [self._at(x["path"]) for x in self.names["dead"]]
        return self.spark.read.schema(DEAD).parquet(*paths) if paths else None

    def dead_rows(self) -> int:
        return sum(n for x in self.names["dead"] for n, _ in x["by"].values())

    def placed(self, segments: list[dict] | None = None, every: bool = False) -> DataFrame:
        """Leafs with the segment that each is in: one scan of all segments, less the dead unless every is asked for."""
        paths = [self._at(x["path"]) for x in (self.names["segments"] if segments is None else segments)]
        if not paths:
            return self.spark.createDataFrame([], LEAFS).withColumn("segment", F.lit(""))
        rows = self.spark.read.schema(LEAFS).parquet(*paths).withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"/leafs/([0-9a-f]{32})/[^/]*$", 1))
        dead = None if every else self.dead()
        return rows if dead is None else rows.join(small(dead.select("segment", "id"), self.dead_rows()), ["segment", "id"], "left_anti")

    def read(self) -> DataFrame:
        return self.placed().select(*LEAFS.fieldNames())

    def gone(self) -> dict[str, tuple[int, int]]:
        """Dead leafs of each segment that has some, and their tokens."""
        out: dict[str, tuple[int, int]] = {}
        for d in self.names["dead"]:
            for k, (n, size) in d["by"].items():
                out[k] = (out.get(k, (0, 0))[0] + n, out.get(k, (0, 0))[1] + size)
        return out

    def words(self) -> SegmentWords:
        """Word search over the segments' postings; texts of segments that aren't indexed are counted as they are."""
        there = [x for x in self.names["segments"] if x.get("words")]
        lack = [x for x in self.names["segments"] if not x.get("words")]
        gone = self.gone()
        n, total, loose = sum(x["rows"] - gone.get(x["key"], (0, 0))[0] for x in there), sum(x["tokens"] - gone.get(x["key"], (0, 0))[1] for x in there), None
        if lack:
            loose = self.placed(lack).select("id", "text")
            more = sums_of(loose).first()
            n, total = n + more["n"], total + more["tokens"]
        keys = {x["key"] for x in there}
        dead = self.dead()
        dead = None if dead is None else dead.where(F.col("segment").isin(sorted(keys)))
        return SegmentWords(self.spark, [(x["key"], self._at(x["words"])) for x in there], dead, self.dead_rows(), n, total, loose)

    def near(self, query: list[float], share: float = SHARE) -> DataFrame:
        """(id, embedding) of leafs that may be nearest to the query: of each segment the lists beside it, and all of segments that have no lists."""
        parts = [near_vectors(self.spark, self._at(x["vectors"]), query, share).withColumn("segment", F.lit(x["key"])) for x in self.names["segments"] if x.get("vectors")]
        lack = [x for x in self.names["segments"] if not x.get("vectors")]
        dead = self.dead()
        if dead is not None:
            parts = [p.join(small(dead.select("segment", "id"), self.dead_rows()), ["segment", "id"], "left_anti") for p in parts]
        if lack:
            parts.append(self.placed(lack).where("embedding is not null"))
        parts = [p.select("id", "embedding") for p in parts]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "id string, embedding array<float>")

    def table(self, name: str) -> DataFrame | None:
        folder = self.names["tables"].get(name)
        return self.spark.read.parquet(self._at(folder)) if folder else None


class Store:
    """A log of segments of leafs: a folder with versions/<number>.json and the folders of leafs, postings, vectors, tombstones and tables that they name.

    fence: the number of the writer's lease, if it holds one (lease.Lease); once a later holder has written, it is refused (Lost).

    The version of the highest number is the current one. It is written aside and renamed to its name, which fails if the name is taken: a reader
    finds the old version or the new one, whole, and of two writers one starts again from the other's. A batch writes a segment of its own rows and the
    tombstones of those that it replaces, and nothing else; a segment of which no leaf is left isn't named any more, and compact() merges segments. A
    segment's rows are dealt by id, so its files follow their bytes. Folders that no version names go with clean().
    """

    def __init__(self, spark: SparkSession, path: str, fence: int | None = None):
        self.spark, self.path, self.fence = spark, path.rstrip("/"), fence

    def version(self) -> tuple[int, dict]:
        """The current version's number and what it names; 0 and nothing for a new store."""
        at, fs = hadoop(self.spark, f"{self.path}/versions")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()]
        if not numbers:
            return 0, json.loads(json.dumps(EMPTY))
        return max(numbers), json.loads(self.spark.read.text(f"{self.path}/versions/{max(numbers):012d}.json", wholetext=True).first()[0])

    def current(self) -> int:
        return self.version()[0]

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.version()[1])

    def read(self) -> DataFrame:
        return self.snapshot().read()

    def words(self) -> SegmentWords:
        return self.snapshot().words()

    def table(self, name: str) -> DataFrame | None:
        return self.snapshot().table(name)

    def _commit(self, number: int, names: dict) -> int:
        if not create(self.spark, f"{self.path}/versions/{number:012d}.json", names):
            raise Conflict(f"version {number} was made by another writer")
        return number

    def _change(self, change, attempts: int = 5) -> int:
        """Make the next version of what change makes of the current one, again if another writer came first."""
        for n in range(attempts):
            number, names = self.version()
            if self.fence is not None and names.get("fence", 0) > self.fence:
                raise Lost(f"a later holder of the lease has written version {number}")
            after = change(json.loads(json.dumps(names)))
            if after == names:
                return number
            after |= {} if self.fence is None else {"fence": self.fence}
            try:
                return self._commit(number + 1, after)
            except Conflict:
                if n + 1 == attempts:
                    raise
        return 0

    def _leafs(self, part: dict) -> DataFrame:
        """All rows of a segment."""
        return self.spark.read.schema(LEAFS).parquet(f"{self.path}/{part['path']}")

    def _drop(self, part: dict) -> None:
        """Delete the leafs of a segment that no version names."""
        at, fs = hadoop(self.spark, f"{self.path}/{part['path']}")
        fs.delete(at, True)

    def _segment(self, leafs: DataFrame, indexed: bool) -> dict | None:
        """Write leafs as a segment, with its postings and vectors if the store is indexed; None for no rows."""
        key = uuid.uuid4().hex
        part = {"key": key, "path": f"leafs/{key}"}
        rows = leafs.select(*LEAFS.fieldNames()).repartition("id").sortWithinPartitions("id")  # no second shuffle of what is dealt and sorted by id
        rows.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{self.path}/{part['path']}")
        stored = self._leafs(part)
        part |= {"rows": stored.count()}
        if not part["rows"]:
            return None
        return self._indexed(part, stored) if indexed else part

    def _indexed(self, part: dict, stored: DataFrame) -> dict:
        """part with postings and vectors of its rows; dead ones among them stay dead."""
        if not part.get("words"):
            path = f"words/{uuid.uuid4().hex}"
            part = part | {"words": path, "tokens": write_blocks(stored.select("id", "text"), f"{self.path}/{path}")}
        if not part.get("vectors"):
            path, vectors = f"vectors/{uuid.uuid4().hex}", stored.where("embedding is not null").select("id", "embedding")
            write_lists(vectors, f"{self.path}/{path}", vectors.count())
            part = part | {"vectors": path}
        return part

    def _tombstones(self, rows: DataFrame) -> dict | None:
        """Write tombstones of rows (segment, id, text); None for none."""
        path, words = f"dead/{uuid.uuid4().hex}", tokens(F.col("text"))
        rows.select("segment", "id", F.size(words).alias("len"), F.array_distinct(words).alias("terms")).write.parquet(f"{self.path}/{path}")
        stored = self.spark.read.schema(DEAD).parquet(f"{self.path}/{path}")
        by = {r["segment"]: [r["n"], r["len"]] for r in stored.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("len")).collect()}  # a row for each segment
        return {"path": path, "by": by} if by else None

    def replace(self, leafs: DataFrame) -> int:
        """All leafs anew; a run that fails makes no version and so leaves the store as it was."""

        def change(names: dict) -> dict:
            part = self._segment(leafs, names["indexed"])
            return names | {"segments": [part] if part else [], "dead": []}

        return self._change(change)

    def add(self, new: DataFrame, now: str, seq: str = "") -> int:
        """Upsert a batch, of which the last row of an id wins by seq; a row without text or source rejects all of it. Returns the version."""
        return self.apply(new, None, now, seq)

    def apply(self, new: DataFrame, gone: DataFrame | None, now: str, seq: str = "", tables: dict[str, DataFrame] | None = None) -> int:
        """Remove the leafs of gone (id), upsert new and store tables, in one version; a leaf that is both stays as new has it."""
        staged = self._segment(last_of(complete(new, now, *([seq] if seq else [])), seq), False)  # read again for its ids
        if staged and not invalid(self._leafs(staged)).isEmpty():
            self._drop(staged)
            raise ValueError("a leaf needs text and source")
        ids = self._leafs(staged).select("id") if staged else self.spark.createDataFrame([], "id string")
        ids = ids if gone is None else ids.union(gone.select("id")).distinct()
        many = ids.count() if gone is not None else staged["rows"] if staged else 0
        folders = {name: self._table(name, t) for name, t in (tables or {}).items()}

        def change(names: dict) -> dict:
            now, part, dead = Snapshot(self, names), staged, None
            met = now.placed().select("segment", "id").join(small(ids, many), "id", "left_semi").persist()  # ids alone: most batches replace little
            try:
                by = {r["segment"]: r["count"] for r in met.groupBy("segment").count().collect()} if many and names["segments"] else {}  # a row for each segment
                were = now.gone()
                empty = {x["key"] for x in names["segments"] if x["key"] in by and by[x["key"]] + were.get(x["key"], (0, 0))[0] == x["rows"]}

                def replaced(keys: set[str]) -> DataFrame:
                    there = [x for x in names["segments"] if x["key"] in keys]
                    return now.placed(there, every=True).join(small(met, sum(by.values())), ["segment", "id"], "left_semi")

                if by.keys() - empty:  # nothing is left of the other ones, so that no text of theirs is read
                    dead = self._tombstones(replaced(by.keys() - empty).select("segment", "id", "text"))
                if by and staged:
                    stored, known = self._leafs(staged), replaced({*by}).where("embedding is not null").select("id", F.col("embedding").alias("known"))
                    if not stored.where("embedding is null").select("id").join(known, "id", "left_semi").isEmpty():
                        part = self._segment(stored.join(known, "id", "left").withColumn("embedding", F.coalesce("embedding", "known")).drop("known"), False)
            finally:
                met.unpersist()
            if part and names["indexed"]:
                part = self._indexed(part, self._leafs(part))
            names = without(names, empty)
            return names | {"segments": names["segments"] + ([part] if part else []), "dead": names["dead"] + ([dead] if dead else []), "tables": names["tables"] | folders}

        done = self._change(change)
        if staged and all(x["key"] != staged["key"] for x in self.version()[1]["segments"]):
            self._drop(staged)  # it was written again with the embeddings of the leafs before
        return done

    def index(self) -> int:
        """Postings and vector lists for segments that have none; from then on each batch brings its own. Returns the version."""

        def change(names: dict) -> dict:
            return names | {"indexed": True, "segments": [self._indexed(x, self._leafs(x)) for x in names["segments"]]}

        names = self.version()[1]
        done = names["indexed"] and all(x.get("words") and x.get("vectors") for x in names["segments"])
        return self.current() if done else self._change(change)

    def compact(self, largest: int | None = None) -> int:
        """Merge the segments of at most `largest` rows (None: all) into one and drop their tombstones; what is live stays the same."""

        def change(names: dict) -> dict:
            merged = [x for x in names["segments"] if largest is None or x["rows"] <= largest]
            if len(merged) < 2 and not any(x["key"] in d["by"] for x in merged for d in names["dead"]):
                return names
            part, keys = self._segment(Snapshot(self, names).placed(merged), names["indexed"]), {x["key"] for x in merged}
            rest = without(names, keys)
            return rest | {"segments": rest["segments"] + ([part] if part else [])}

        return self._change(change)

    def put_table(self, name: str, rows: DataFrame) -> int:
        """Store a table beside the leafs: files, commits, persons and their edges."""
        folder = self._table(name, rows)
        return self._change(lambda names: names | {"tables": names["tables"] | {name: folder}})

    def _table(self, name: str, rows: DataFrame) -> str:
        folder = f"tables/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def clean(self, keep: int = 2, spare: float = SPARE) -> int:
        """Delete versions but the last `keep`, and the folders that none of them names and in which nothing was written for `spare` seconds: a run that has not
        yet named its folders keeps them. Readers of older versions must be done. Returns how many folders went."""
        at, fs = hadoop(self.spark, f"{self.path}/versions")
        files = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().endswith(".json"))
        named = set()
        for f in files[-keep:]:
            names = json.loads(self.spark.read.text(f"{self.path}/versions/{f}", wholetext=True).first()[0])
            named |= {x[k] for x in names["segments"] for k in ("path", "words", "vectors") if x.get(k)} | {x["path"] for x in names["dead"]} | {*names["tables"].values()}
        for f in files[:-keep]:
            fs.delete(hadoop(self.spark, f"{self.path}/versions/{f}")[0], False)
        gone, before = 0, (time.time() - spare) * 1000

        def touched(status) -> int:
            below = [x for x in fs.listStatus(status.getPath()) if x.isDirectory()] if status.isDirectory() else []
            return max([status.getModificationTime(), *(touched(x) for x in below)])

        for kind in ("leafs", "words", "vectors", "dead", "tables"):
            top = hadoop(self.spark, f"{self.path}/{kind}")[0]
            for run in fs.listStatus(top) if fs.exists(top) else []:
                if f"{kind}/{run.getPath().getName()}" not in named and touched(run) <= before:
                    fs.delete(run.getPath(), True)
                    gone += 1
        return gone


def batch_bounds(total: int, size: int) -> list[tuple[int, int]]:
    """Start and end of each batch of size rows; a size below 1 means BATCH."""
    return [(a, min(total, a + size)) for size in [size if size > 0 else BATCH] for a in range(0, total, size)]
