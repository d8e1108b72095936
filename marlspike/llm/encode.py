"""Token identifiers of whole texts by a tokenizers file, encoding each distinct chunk once."""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Case, composition and classes of other characters are left to the library.
UNUSUAL = r"[^\x00-\x1b\x20-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]"
LETTERED = r"^[a-z\x{e0}-\x{f6}\x{f8}-\x{24f}]+$"
MARKED = r"^([a-z\x{e0}-\x{f6}\x{f8}-\x{24f}]+)[.,;:!?]$"
#: Chunks that a worker keeps, about 50 MB, unless told otherwise; it starts afresh beyond that.
KEPT_CHUNKS = 250_000
#: Words that are encoded as one text.
TOGETHER = 4000
#: Token that ends each document.
END = 1


class ChunkEncoder:
    """The library's ids for batches of texts.

    White space never joins two tokens of the vocabulary, so a plain text's ids are those of its chunks in order. A batch is split and its
    chunks are numbered by Arrow; distinct ones are looked up, and those not known yet are encoded. A mark after letters is a token of its own, so such chunks
    share the ids of the rest. Words of letters alone are one pre-token each; they are encoded many at a time and parted after the
    tokens that end a word. Texts with special strings or unusual characters go to the library whole.
    """

    def __init__(self, path: str, kept: int):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or ""
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.parted = bool(suffix)
        self.forget()

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        ids = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), of words of letters."""
        if not self.parted or not words:
            return self.whole(words)
        ids, _ = self.whole([" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)])
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.n_flat = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def learn(self, names: list[str], lettered: np.ndarray) -> np.ndarray:
        """Encode and keep chunks, and return where; lettered: those of letters alone."""
        order = np.argsort(~lettered, kind="stable")
        names, n = [names[i] for i in order.tolist()], int(lettered.sum())
        (a, a_sizes), (b, b_sizes) = self.words(names[:n]), self.whole(names[n:])
        flat, sizes, first = np.concatenate([a, b]), np.concatenate([a_sizes, b_sizes]), len(self.place)
        while len(self.starts) < first + len(names):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while len(self.flat) < self.n_flat + len(flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.sizes[first : first + len(names)] = sizes
        self.starts[first : first + len(names)] = self.n_flat + np.cumsum(sizes) - sizes
        self.n_flat += len(flat)
        self.place.update(zip(names, range(first, first + len(names)), strict=True))
        at = np.empty(len(names), np.int32)
        at[order] = np.arange(first, first + len(names))
        return at

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), of distinct plain lower-case chunks."""
        rest = pc.replace_substring_regex(chunks, MARKED, r"\1").dictionary_encode()
        names = rest.dictionary.to_pylist()
        if len(self.place) > self.kept:
            self.forget()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int32, len(names))
        if len(missing := np.flatnonzero(at < 0)):
            new = rest.dictionary.take(missing)
            at[missing] = self.learn([names[i] for i in missing.tolist()], pc.match_substring_regex(new, LETTERED).to_numpy(zero_copy_only=False))
        at = at[rest.indices.to_numpy()]
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(chunks), pc.binary_length(rest.dictionary.take(rest.indices))).to_numpy(zero_copy_only=False))
        out, n_out = gathered(self.flat, self.starts, self.sizes, at, marked)
        if len(marked):
            marks = pc.utf8_slice_codeunits(chunks.take(marked), -1).dictionary_encode()
            mark_ids, _ = self.whole(marks.dictionary.to_pylist())
            out[np.cumsum(n_out)[marked] - 1] = mark_ids[marks.indices.to_numpy()]
        return out, n_out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in a row, and how many each has; a null text has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring_regex(texts, UNUSUAL), pc.match_substring(texts, "<|"))
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        words = chunks.flatten().dictionary_encode()
        flat, sizes = self.chunks(words.dictionary)
        at = words.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes[at])])[chunks.offsets.to_numpy()]
        flat, sizes = gathered(flat, np.cumsum(sizes) - sizes, sizes, at)[0], np.diff(bounds)
        if len(rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False))):
            more, n = self.whole(texts.take(rows).to_pylist())
            flat = np.insert(flat, np.repeat(bounds[rows], n), more)
            sizes[rows] = n
        return flat, sizes


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, wider: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat numbered by at, in a row, and their sizes; those at wider end in one more place."""
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n, starts = sizes[at], starts[at]
    if wider is not None:
        n = n.copy()
        n[wider] += 1
    ends = np.cumsum(n)
    kind = np.int32 if ends[-1] < 1 << 30 and len(flat) < 1 << 30 else np.int64
    places = np.repeat((starts - (ends - n)).astype(kind), n)
    places += np.arange(int(ends[-1]), dtype=kind)
    return flat.take(places, mode="clip"), n


def ended(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of each document of a batch, with the end token."""
    ends = np.cumsum(sizes + 1)
    out = np.full(len(flat) + len(sizes), END, np.uint32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = flat
    return np.split(out, ends[:-1]) if len(ends) else []


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, kept: int = KEPT_CHUNKS) -> ChunkEncoder:
    """One encoder for each worker, file and bound of kept chunks."""
    if (path, kept) not in _encoders:
        _encoders[path, kept] = ChunkEncoder(path, kept)
    return _encoders[path, kept]
