"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from marlspike.llm.common import map_batches, prepare, text_rows

#: Any other character sends a text through the library's own normaliser: in this range case, composition and classes are settled.
PLAIN = regex.compile(r"[\x00-\x1b\x20-įı-ɏ‐-‧€]*")
#: Fixed: the vocabulary's split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks whose counts a worker keeps; it starts afresh beyond that.
KEPT_CHUNKS = 400_000
LONGEST_KEPT = 48


def byte_letters() -> dict[int, str]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeCounter:
    """Counts byte-pair symbols of a tokenizer file without making identifiers.

    A word's symbols form a doubly linked list; a heap holds the ranks of adjacent pairs. The lowest rank is popped, the pair is
    merged in place, and the two new neighbours are pushed. Entries whose pair has changed meanwhile are stale and skipped.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a in vocab and b in vocab:
                self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.suffix] for b in range(256)]
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.library = Tokenizer.from_file(path)
        self.counts: dict[str, int] = {}

    def word(self, piece: bytes) -> int:
        """Symbols that remain of one pre-token."""
        symbol = [self.inner[b] for b in piece]
        symbol[-1] = self.last[piece[-1]]
        n = left = len(symbol)
        if n == 1:
            return 1
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            now = merges.get((symbol[i], symbol[j]))
            if now is None or now[1] != new:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if m := merges.get((new, symbol[k])):
                    heapq.heappush(heap, (*m, i))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], new))):
                heapq.heappush(heap, (*m, h))
        return left

    def chunk(self, chunk: str) -> int:
        """Tokens of a plain lower-case chunk without white space."""
        if len(chunk) > 1 and chunk[-1] in ".,;:!?" and chunk[-2].isalpha():  # the split pattern parts them here
            return self.known(chunk[:-1]) + self.known(chunk[-1])
        return sum(self.word(p.encode()) for p in PIECES.findall(chunk))

    def known(self, chunk: str) -> int:
        n = self.counts.get(chunk)
        if n is None:
            n = self.chunk(chunk)
            if len(chunk) <= LONGEST_KEPT:
                self.counts[chunk] = n
        return n

    def segment(self, text: str) -> int:
        """Tokens of text without special strings."""
        if PLAIN.fullmatch(text):
            counts, total, new = self.counts, 0, []
            for c in text.lower().split():
                n = counts.get(c)
                if n is None:
                    new.append(c)
                else:
                    total += n
            return total + sum(map(self.known, new))
        shown = self.library.normalizer.normalize_str(text)
        letters = {v: k for k, v in byte_letters().items()}
        return sum(self.word(bytes(letters[c] for c in p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(shown))

    def text(self, text: str) -> int:
        if len(self.counts) > KEPT_CHUNKS:
            self.counts.clear()
        if self.special is None or "<|" not in text:
            return self.segment(text)
        found = self.special.findall(text)
        return len(found) + sum(self.segment(x) for x in self.special.split(text) if x)


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each worker and file."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Per document doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE tokenizer file that every executor can open. A null or empty text counts 0 bytes and 0
    tokens; a null doc_id stays; repeated rows give repeated rows; other columns are ignored. One narrow pass: no shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        count = counter(vocabulary)
        for b in batches:
            texts = [x or "" for x in b["text"].to_pylist()]
            n = [count.text(x) for x in texts]
            yield {"doc_id": b["doc_id"], "n_bytes": [len(x.encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_batches(text_rows(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

