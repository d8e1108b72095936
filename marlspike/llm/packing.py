"""Order-preserving packing: dynamic programming over document and sentence boundaries with a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marlspike.llm.common import map_batches, merged, prepare, text_rows
from marlspike.llm.encode import END, ended, encoder

#: Padding tokens that a cut is worth: at a document's end, at a sentence's end, anywhere else; and a sequence more.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE, SEQUENCE = 0, 4, 48, 1
#: Tokens that are planned together, and tokens between two cuts at most: sentences that are longer may be cut inside.
BLOCK, FAR = 1 << 18, 128
#: Tokens of the smallest sequence that is planned as unpadded for its power of two; smaller ones would save little padding for a whole sequence.
LEAST_POWER = 64
SENTENCE_ENDS = (".", "!", "?", "...", "。", "!!", "??", ".\"")


def candidates(sizes: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a block may be cut and what each costs; position 0 and the block's end are among them.

    sizes: tokens of each document of the block; sentence: whether each token ends a sentence.
    """
    total = int(sizes.sum())
    cost = np.full(total + 1, -1, np.int32)
    cost[np.flatnonzero(sentence) + 1] = AT_SENTENCE
    cost[np.cumsum(sizes)] = AT_DOCUMENT
    cost[0] = AT_DOCUMENT
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > FAR)
    if len(wide):
        cost[np.concatenate([np.arange(at[i] + FAR, at[i + 1], FAR) for i in wide])] = ELSEWHERE
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Cut positions, from 0 to the block's end, with the least padding and penalties.

    best[j] = cost[j] + min over the window at[j] - at[i] <= length of best[i] + length - (at[j] - at[i]): the queue keeps
    best[i] + at[i] increasing, so that its head is the minimum and each position enters and leaves once. A sequence whose size is a
    power of two isn't padded; those few transitions are looked up beforehand.
    """
    exact: dict[int, list[int]] = {}
    power = LEAST_POWER
    while power <= length:
        i = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[i] == at - power)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        power *= 2
    where, fee = at.tolist(), cost.tolist()
    n = len(where)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best[i] + at[i], i)
    for j in range(1, n):
        p = where[j]
        while where[queue[0][1]] < p - length:
            queue.popleft()
        v, i = queue[0]
        v += length - p
        if j in exact:
            for k in exact[j]:
                if best[k] < v:
                    v, i = best[k], k
        v += fee[j] + SEQUENCE
        best[j], back[j] = v, i
        v += p
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j))
    cuts, j = [where[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(where[j])
    return cuts[::-1]


class Packer:
    """Packs a stream of documents in order; what a block leaves in its last sequence is planned again with the next block."""

    def __init__(self, length: int, first_sequence: int, sentence_ids: np.ndarray):
        self.length, self.sequence, self.sentence_ids = length, first_sequence, sentence_ids
        self.waiting: list[list] = []  # [key, ids, start]: what isn't packed yet of each document
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.waiting.append([key, ids, 0])
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces: key, start, ids, document's tokens, sequence, offset."""
        if not self.waiting:
            return
        sizes = np.array([len(ids) - start for _, ids, start in self.waiting], np.int64)
        ids = np.concatenate([ids[start:] for _, ids, start in self.waiting])
        sentence = self.sentence_ids[ids]
        cuts = plan(*candidates(sizes, sentence), self.length)
        if not last and len(cuts) > 2:
            cuts.pop()
        done, k = 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            p = a
            while p < b:
                key, doc, start = self.waiting[k]
                n = min(len(doc) - start, b - p)
                yield key, start, doc[start : start + n], len(doc), self.sequence, p - a
                p += n
                if start + n == len(doc):
                    k += 1
                else:
                    self.waiting[k][2] = start + n
            self.sequence += 1
            done = b
        self.waiting = self.waiting[k:]
        self.held = int(sizes.sum()) - done


def sentence_ends(vocabulary: str) -> np.ndarray:
    """For each token id, whether it ends a sentence; the end token isn't one, as the document's end is a better cut."""
    size = encoder(vocabulary).library.get_vocab_size()
    flags = np.zeros(max(size, END + 1), bool)
    for mark in SENTENCE_ENDS:
        ids, _ = encoder(vocabulary).whole([mark])
        if len(ids) == 1:
            flags[ids[0]] = True
    return flags


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of sequences of at most `length` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on request.

    Every input partition is packed by itself in its row order, in blocks of BLOCK tokens and with one block in memory, so nothing is
    shuffled and a lost task is repeated alone; each partition ends with one sequence that may be short. sequence_id holds the
    partition in its upper bits. Null and empty texts are documents of the end token alone; a null doc_id stays; repeated rows are
    packed each; other columns are ignored; an empty table gives no pieces.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encode, ends = encoder(vocabulary), sentence_ends(vocabulary)
        packer = Packer(length, TaskContext.get().partitionId() << 40, ends)

        def table(pieces: list[tuple]) -> dict:
            key, start, ids, total, sequence, offset = map(list, zip(*pieces, strict=True))
            crc = [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids]
            out = {"doc_id": key, "start": start, "length": [*map(len, ids)], "ids_crc32": crc, "doc_tokens": total, "sequence_id": sequence, "offset": offset}
            return out | ({"ids": [x.tolist() for x in ids]} if with_ids else {})

        for b in merged(batches, 6 << 20):
            pieces = []
            for key, ids in zip(b["doc_id"].to_pylist(), ended(*encode.batch(b["text"])), strict=True):
                pieces += packer.add(key, ids)
            if pieces:
                yield table(pieces)
        if pieces := [*packer.flush(last=True)]:
            yield table(pieces)

    return map_batches(text_rows(docs), run, PIECES + ", ids array<long>" * with_ids)
