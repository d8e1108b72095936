"""Token shards as wavelet matrices: one compressed file for each shard, with access, rank, select and counting."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspike.llm.common import map_batches, materialize, merged, prepare, scratch, text_rows
from marlspike.llm.encode import ended, encoder

MAGIC = b"WVLTMTX1"
#: Bits of a compressed block of a plane; a rank is stored for each block.
BLOCK_BITS = 1 << 16
#: Tokens of a shard file at least, when its partition has as many.
SHARD_TOKENS = 1 << 20
#: Chunks whose ids a worker keeps while it encodes, about 160 MB.
KEPT_CHUNKS = 800_000


def build(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A shard file.

    Layout: magic, header size, header (JSON: n, width, zeros of each plane, section sizes), then zstd sections for the doc_ids, the
    validity of doc_ids and the starts, then for each plane the ranks before its blocks, the places of its blocks and the blocks.
    Plane k holds bit width-1-k of the ids, ordered stably by the bits above; zeros precede ones from plane to plane.
    """
    n, width = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    packer = zstandard.ZstdCompressor(level=1)
    seq = ids.astype(np.uint16 if width <= 16 else np.uint32)
    zeros, sections = [], []
    for k in range(width - 1, -1, -1):
        bits = ((seq >> k) & 1).view(np.uint8)[:: seq.itemsize].view(bool)  # the low byte of little-endian numbers
        packed = np.packbits(bits)
        blocks = [packer.compress(packed[a : a + BLOCK_BITS // 8]) for a in range(0, len(packed), BLOCK_BITS // 8)]
        full = np.zeros(len(blocks) * BLOCK_BITS // 8, np.uint8)
        full[: len(packed)] = packed
        ones = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1, dtype=np.int64)
        sections += [np.concatenate([[0], np.cumsum(ones)]).astype("<i8").tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes(), b"".join(blocks)]
        zeros.append(n - int(ones.sum()))
        if k:
            seq = np.concatenate([np.compress(~bits, seq), np.compress(bits, seq)])
    head = [
        packer.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes()),
        packer.compress(np.array([x is not None for x in doc_ids], np.uint8).tobytes()),
        packer.compress(starts.astype("<i8").tobytes()),
    ]
    header = json.dumps({"n": n, "docs": len(doc_ids), "width": width, "zeros": zeros, "sizes": [*map(len, [*head, *sections])]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *head, *sections])


class Shard:
    """A shard read from the bytes of its file; blocks are unpacked when they are asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", data, 8)[0]
        header = json.loads(data[12 : 12 + size])
        self.n, self.width, self.zeros, n_docs = header["n"], header["width"], header["zeros"], header["docs"]
        cuts = np.cumsum([12 + size, *header["sizes"]]).tolist()
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        read = zstandard.ZstdDecompressor().decompress
        ids, valid, starts = (read(x) if n_docs else b"" for x in parts[:3])
        self.doc_ids = [x if ok else None for x, ok in zip(np.frombuffer(ids, "<i8").tolist(), valid, strict=True)]
        self.starts = np.append(np.frombuffer(starts, "<i8"), self.n)
        self.planes = [(np.frombuffer(parts[i], "<i8"), np.frombuffer(parts[i + 1], "<i8"), parts[i + 2]) for i in range(3, len(parts), 3)]
        self._read = read

    def bits(self, plane: int, block: int) -> np.ndarray:
        _, places, blocks = self.planes[plane]
        n = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(self._read(blocks[places[block] : places[block + 1]]), np.uint8), count=n)

    def ones(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, BLOCK_BITS)
        return int(self.planes[plane][0][block]) + (int(self.bits(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            block, rest = divmod(i, BLOCK_BITS)
            bits = self.bits(k, block)
            one, before = int(bits[rest]), int(self.planes[k][0][block]) + int(bits[:rest].sum())
            value = value * 2 + one
            i = self.zeros[k] + before if one else i - before
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        a, b = self._range(token, 0, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in a stretch of positions."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token < 0 or token >> self.width:
            return 0, 0
        for k in range(self.width):
            x, y = self.ones(k, a), self.ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (self.width - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def select(self, token: int, nth: int) -> int:
        """The position of the nth (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        i = a + nth
        for k in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - k) & 1
            i = self._select(k, one, i - self.zeros[k] if one else i)
        return i

    def _select(self, plane: int, one: int, nth: int) -> int:
        ranks = self.planes[plane][0]
        if not one:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK_BITS, self.n) - ranks
        block = int(np.searchsorted(ranks, nth, side="right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self.bits(plane, block) == one)[nth - int(ranks[block])])

    def positions(self, token: int) -> list[int]:
        """Every occurrence of token."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens: planes are taken from the last to the first, undoing the stable partition of each."""
        seq = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for k in range(self.width - 1, -1, -1):
            bits = np.concatenate([self.bits(k, b) for b in range(len(self.planes[k][1]) - 1)] or [np.zeros(0, np.uint8)]).view(bool)
            above = bits.astype(seq.dtype)
            if k + 1 < self.width:
                above <<= self.width - 1 - k
                one, zero = np.flatnonzero(bits), np.flatnonzero(~bits)
                above[zero] = seq[: len(zero)]
                above[one] |= seq[len(zero) :]
            seq = above
        return seq


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_shards(docs: DataFrame, vocabulary: str, out: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts in ascending doc_id order into shard files under out; the stored manifest has part, shard, file, n_tokens.

    Rows are dealt into ranges of (doc_id, text hash, place in the input), so that neither equal keys nor repeated rows can fill one range, and
    sorted within them; nulls come first. A file is written under a name of its own and then moved to its final name, which depends on the range alone: a task that
    is repeated leaves the same file, and the manifest names only files of tasks that ended.
    """
    spark = prepare(docs.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "tie", "place")
    rows = text_rows(docs).withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie", "place")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encode, part = encoder(vocabulary, KEPT_CHUNKS), TaskContext.get().partitionId()
        fs, folder = filesystem(out)
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = shard = 0

        def store() -> dict:
            name = f"part-{part:06d}-{shard:06d}.wvlt"
            sizes = np.array([*map(len, held)], np.int64)
            data = build(np.concatenate(held), np.cumsum(sizes) - sizes, keys)
            with fs.open_output_stream(own := f"{folder}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(data)
            fs.move(own, f"{folder}/{name}")
            return {"part": [part], "shard": [shard], "file": [name], "n_tokens": [size]}

        fs.create_dir(folder, recursive=True)
        for b in merged(batches):
            for key, ids in zip(b["doc_id"].to_pylist(), ended(*encode.batch(b["text"])), strict=True):
                keys.append(key)
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield store()
                    keys, held, size, shard = [], [], 0, shard + 1
        if held:
            yield store()

    return materialize(map_batches(rows, run, "part int, shard int, file string, n_tokens long"), "manifest")


def read_shards(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """Per document doc_id, start, n_tokens, ids_crc32, decoded from the shard files; start counts the ids of all documents before."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = parts.withColumn("part_start", F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    files = manifest.withColumn("within", within).join(before, "part").select("file", (F.coalesce("part_start", zero) + F.coalesce("within", zero)).alias("first"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        fs, folder = filesystem(out)
        for b in batches:
            for name, first in zip(b["file"].to_pylist(), b["first"].to_pylist(), strict=True):
                with fs.open_input_stream(f"{folder}/{name}") as f:
                    shard = Shard(f.read())
                ids, at = shard.decode().astype("<u4"), shard.starts
                yield {
                    "doc_id": shard.doc_ids,
                    "start": first + at[:-1],
                    "n_tokens": np.diff(at),
                    "ids_crc32": [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at[:-1], at[1:], strict=True)],
                }

    return map_batches(files.repartition(n, "file"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents as shards in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are documents of the end token alone; a null doc_id comes first; rows that share a doc_id are ordered by a
    hash of the text; other columns are ignored; an empty table writes no file.
    """
    spark = docs.sparkSession
    out = scratch(spark, "wavelet")
    return read_shards(spark, out, write_shards(docs, vocabulary, out))
