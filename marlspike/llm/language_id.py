"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.llm.common import map_batches, prepare, text_rows

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bounds of the labelled sample that the model is fitted on: labels, windows for each label, code points of a window.
MAX_LABELS, WINDOWS, WINDOW = 200, 500, 400
#: Words whose emissions a worker keeps, code points of them, and words that one forward-backward pass holds.
KEPT_WORDS, KEPT_POINTS, PASS_WORDS = 250_000, 8_000_000, 300_000


#: Marks that continue a word, as vowel signs do, by their Unicode category.
MARK_CHARS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")


def combining() -> re.Pattern[str]:
    """A pattern for one of MARK_CHARS, as ranges."""
    marks = sorted(map(ord, MARK_CHARS))
    ends = [k for k in range(len(marks)) if k + 1 == len(marks) or marks[k + 1] != marks[k] + 1]
    starts = [0, *(k + 1 for k in ends[:-1])]
    return re.compile("[" + "".join(f"{re.escape(chr(marks[a]))}-{re.escape(chr(marks[b]))}" for a, b in zip(starts, ends, strict=True)) + "]")


MARKS = combining()
MARKED = re.compile(rf"[^\W\d_](?:[^\W\d_]|{MARKS.pattern})*")


def word_pattern(text: str) -> re.Pattern[str]:
    """The pattern of a text's words; that with marks is several times slower, and few texts have one."""
    return LETTERS if text.isascii() or MARK_CHARS.isdisjoint(text) else MARKED


def words_at(text: str) -> Iterator[re.Match[str]]:
    """The words of a text, in lower case already: runs of letters and of the marks that follow one."""
    return word_pattern(text).finditer(text)


def words_in(text: str) -> list[str]:
    return word_pattern(text).findall(text)


def shape_features(word: str) -> list[str]:
    """Affixes up to three letters, and letter pairs and triples within word boundaries."""
    n = len(word)
    out = [f"p{word[:k]}" for k in range(1, min(3, n) + 1)] + [f"s{word[n - k :]}" for k in range(1, min(3, n) + 1)]
    b = f"^{word}$"
    return out + [f"2{b[i : i + 2]}" for i in range(n + 1)] + [f"3{b[i : i + 3]}" for i in range(n)]


class Field:
    """A linear-chain CRF: emissions are summed feature weights of a word, transitions a learned label matrix."""

    def __init__(self, labels: list[str], lexicon: dict[str, list[str]], features: dict[str, int]):
        self.labels, self.lexicon, self.features = labels, lexicon, features
        k = len(labels)
        self.weights, self.trans = np.zeros((len(features), k)), np.zeros((k, k))

    def ids(self, word: str) -> list[int]:
        found = map(self.features.get, [*shape_features(word), *self.lexicon.get(word, ())])
        return [i for i in found if i is not None]

    def emission(self, word: str) -> np.ndarray:
        return self.weights[self.ids(word)].sum(0) if self.labels else np.zeros(0)

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = 4, batch: int = 32, rate: float = 0.25, decay: float = 1e-6) -> None:
        """AdaGrad on the conditional log-likelihood; gradients are observed less expected counts from forward-backward."""
        k, order = len(self.labels), np.random.default_rng(7)
        known = {w: np.array(self.ids(w), np.int64) for words, _ in sequences for w in words}
        squares, t_squares = np.full_like(self.weights, 1e-8), np.full_like(self.trans, 1e-8)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(sequences)), max(1, len(sequences) // batch)):
                grad, t_grad, total = np.zeros_like(self.weights), np.zeros_like(self.trans), 0
                for s in part:
                    words, gold = sequences[s]
                    e = np.array([self.weights[known[w]].sum(0) for w in words])
                    single, pair = expected(e, self.trans)
                    diff = -single
                    diff[np.arange(len(gold)), gold] += 1
                    at = [known[w] for w in words]
                    rows = np.concatenate(at)
                    np.add.at(grad, rows, np.repeat(diff, [len(x) for x in at], axis=0))
                    t_grad -= pair
                    np.add.at(t_grad, (gold[:-1], gold[1:]), 1)
                    total += len(words)
                grad, t_grad = grad / max(1, total) - decay * self.weights, t_grad / max(1, total)
                squares += grad**2
                t_squares += t_grad**2
                self.weights += rate * grad / np.sqrt(squares)
                self.trans += rate * t_grad / np.sqrt(t_squares)

    def posteriors(self, texts: list[np.ndarray], table: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Mean label posterior of each text by forward-backward, how often the best label changes from word to word, and, if each is asked for, the
        best label of each word; texts hold row numbers of table (emissions)."""
        out, switches = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        single = [np.zeros(0, np.int64)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
        while order:
            n = held = 0
            while n < len(order) and (n == 0 or held + len(texts[order[n]]) <= PASS_WORDS):
                held += len(texts[order[n]])
                n += 1
            part, order = order[:n], order[n:]
            out[part], words, live = marginals([texts[i] for i in part], table, self.trans)
            best = words.argmax(1)
            # word t of text d is row starts[t] + d, and its text's word before it live[t - 1] rows earlier
            starts = np.concatenate([[0], np.cumsum(live)])
            rows = np.arange(live[0], len(best))
            change = best[rows] != best[rows - np.repeat(live[:-1], live[1:])]
            switches[part] = np.bincount((rows - np.repeat(starts[1:-1], live[1:]))[change], minlength=n)
            if each:
                for d, i in enumerate(part):
                    single[i] = best[starts[: len(texts[i])] + d]
        return out, switches, single


def expected(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals of each word and summed pair marginals of one sequence with emissions e."""
    n, k = e.shape
    x, a = np.exp(e - e.max(1, keepdims=True)), np.exp(trans - trans.max())
    f, b = np.empty((n, k)), np.ones((n, k))
    f[0] = x[0] / x[0].sum()
    for t in range(1, n):
        v = (f[t - 1] @ a) * x[t]
        f[t] = v / v.sum()
    for t in range(n - 2, -1, -1):
        v = a @ (x[t + 1] * b[t + 1])
        b[t] = v / v.sum()
    single = f * b
    single /= single.sum(1, keepdims=True)
    if n == 1:
        return single, np.zeros((k, k))
    pair = f[:-1, :, None] * a * (x[1:] * b[1:])[:, None, :]
    return single, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def forward_backward(texts: list[np.ndarray], table: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean marginals of texts, longest first, and the marginals of their words."""
    mean, single, live = marginals(texts, table, trans)
    starts = np.concatenate([[0], np.cumsum(live)])
    return mean, [single[starts[: len(x)] + d] for d, x in enumerate(texts)]


def marginals(texts: list[np.ndarray], table: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean marginals of texts, longest first; the marginals of each word, by steps; the texts that each step has. Step t handles word t of every
    text that has one, so that rows stay dense."""
    sizes = np.array([len(x) for x in texts])
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts longer than t
    starts = np.concatenate([[0], np.cumsum(live)])
    at = np.empty(int(sizes.sum()), np.int64)
    for d, x in enumerate(texts):
        at[starts[: len(x)] + d] = x
    e = table[at]
    x, a = np.exp(e - e.max(1, keepdims=True)), np.exp(trans - trans.max())
    f, k = np.empty_like(x), x.shape[1]
    prior = np.full((live[0], k), 1 / k)
    for t in range(steps):
        s, n = starts[t], live[t]
        v = (prior[:n] @ a if t else prior) * x[s : s + n]
        v /= v.sum(1, keepdims=True)
        f[s : s + n] = prior = v
    total, back = np.zeros((len(texts), k)), np.ones((len(texts), k))
    for t in range(steps - 1, -1, -1):
        s, n = starts[t], live[t]
        v = f[s : s + n] * back[:n]
        f[s : s + n] = v = v / v.sum(1, keepdims=True)  # the forward mass of a step isn't needed again
        total[:n] += v
        if t:
            v = (x[s : s + n] * back[:n]) @ a.T
            back[:n] = v / v.sum(1, keepdims=True)
    return total / sizes[:, None], f, live


def mixed(windows: dict[int, list[list[str]]], rng: np.random.Generator, longest: int = 48) -> Iterator[tuple[list[str], list[int]]]:
    """Training sequences: each window once, every second one followed by runs of other labels, as in code-switched text."""
    labels = sorted(windows)
    for label in labels:
        for i, words in enumerate(windows[label]):
            out, gold = words[:longest], [label] * min(longest, len(words))
            if i % 2 and len(labels) > 1:
                out, gold = out[: longest // 3], gold[: longest // 3]
                for _ in range(2):
                    other = labels[rng.integers(len(labels))]
                    run = windows[other][rng.integers(len(windows[other]))]
                    first = int(rng.integers(max(1, len(run) - 16)))
                    run = run[first : first + 16]
                    out, gold = out + run, gold + [other] * len(run)
            if out:
                yield out, gold


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, windows: int = WINDOWS, max_labels: int = MAX_LABELS) -> Field:
    """Fit a field on a bounded sample of labelled rows that aren't held out.

    At most max_labels labels (the most frequent) and about `windows` windows of WINDOW code points for each, drawn by a hash of
    doc_id over the whole table; the driver receives no more than twice that. No labelled row: a field without labels.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels).collect()}
    if not counts:
        return Field([], {}, {})
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, windows / n))])
    h = F.xxhash64("doc_id", F.lit("window"))
    u = F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))
    first = F.pmod(F.shiftright(h, 31), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    drawn = rows.where(u < F.try_element_at(shares, F.col("lang"))).select("lang", u.alias("u"), F.substring(F.col("text"), first.cast("int"), F.lit(WINDOW)).alias("text"))
    labels = sorted(counts)
    by: dict[int, list[list[str]]] = defaultdict(list)
    for r in drawn.orderBy("u", "lang", "text").limit(2 * windows * len(labels)).collect():
        if words := words_in(r["text"].lower()):
            by[labels.index(r["lang"])].append(words)
    counted = {k: Counter(w for x in v for w in x) for k, v in by.items()}
    lexicon: dict[str, list[str]] = {}
    total = Counter(w for c in counted.values() for w in c.elements())
    for w, n in total.items():
        if n >= 3:
            p, k = max((c[w] / n, -k) for k, c in counted.items())
            lexicon[w] = [f"L{-k}"] + [f"S{-k}"] * (p >= 0.9)
    seen = Counter(x for w in total for x in (*shape_features(w), *lexicon.get(w, ())))
    field = Field(labels, lexicon, {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= 2))})
    field.fit(list(mixed(by, np.random.default_rng(11))))
    return field


class Read(NamedTuple):
    """What a text reads as: its language and score, the label numbers of its words (if asked for), and how often the label changes from word to word."""

    lang: str
    score: float
    words: np.ndarray
    switches: int


class Reader:
    """A worker's table of emissions by word, with a bounded number of words and of their code points."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table, self.n, self.points = np.zeros((1 << 12, len(self.field.labels)), np.float32), 0, 0

    def numbers(self, text: str | None) -> np.ndarray:
        """Rows of the table for the words of a text."""
        words = words_in(text.lower()) if text else []
        for w in {*words}.difference(self.place):
            letters = any(map(str.isalpha, w))  # else digits of other kinds
            if letters:
                if self.n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[self.n] = self.field.emission(w)
                self.n += 1
            self.place[w] = self.n - 1 if letters else -1
            self.points += len(w)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return at[at >= 0]

    def __call__(self, texts: list[str | None], each: bool = False) -> list[Read]:
        if len(self.place) > KEPT_WORDS or self.points > KEPT_POINTS:
            self.forget()
        ids, none = [self.numbers(x) for x in texts], np.zeros(0, np.int64)
        if not self.field.labels:
            return [Read(UNKNOWN, 0.0, none, 0)] * len(texts)
        mean, switches, single = self.field.posteriors(ids, self.table[: self.n], each)
        best = mean.argmax(1)
        read = zip(ids, best.tolist(), np.minimum(1.0, mean[np.arange(len(best)), best]).tolist(), single, switches.tolist(), strict=True)
        return [Read(self.field.labels[k], score, words, n) if len(own) else Read(UNKNOWN, 0.0, none, 0) for own, k, score, words, n in read]


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score: the label with the largest mean posterior over all words of the text; n_switches: how often
    the best label changes from one word to the next.

    field: a fitted model, else one is trained on docs (doc_id, text, lang). lang is read for training alone. Null texts and texts
    without a letter get `und` and 0; so does every text when no row is labelled. Ties go to the smaller label; a null doc_id counts
    as not held out and isn't trained on; repeated rows are predicted each; other columns are ignored. Words are taken whole, however
    long. One narrow pass.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field or train(docs))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        read = Reader(shared.value)
        for b in batches:
            found = read(b["text"].to_pylist())
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [r.lang for r in found], "score": [r.score for r in found], "n_switches": [r.switches for r in found]}

    return map_batches(text_rows(docs, held_out().alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double, n_switches long")


def label_words(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Code-switched text taken apart: a row for each run of words of one label, doc_id, run (from 0), start, end (code points of the text, end exclusive),
    lang, n_words.

    Labels are each word's best posterior by forward-backward over the whole text. Null texts, texts without a letter and, where no row is
    labelled, all texts have no rows; repeated rows are labelled each. Offsets are those of the text itself where lower-casing keeps its length, as
    it does but for few letters (a capital I with a dot is two): such texts are read letter by letter in the case that they have.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field or train(docs))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        read = Reader(shared.value)
        for b in batches:
            texts = [x and (low if len(low := x.lower()) == len(x) else "".join(c if len(c.lower()) > 1 else c.lower() for c in x)) for x in b["text"].to_pylist()]
            out: list[tuple] = []
            for key, text, found in zip(b["doc_id"].to_pylist(), texts, read(texts, each=True), strict=True):
                if not len(found.words):
                    continue
                at = [m.span() for m in words_at(text) if any(map(str.isalpha, m[0]))]
                firsts = np.flatnonzero(np.append(True, found.words[1:] != found.words[:-1])).tolist()
                for k, (i, j) in enumerate(zip(firsts, [*firsts[1:], len(at)], strict=True)):
                    out.append((key, k, at[i][0], at[j - 1][1], read.field.labels[found.words[i]], j - i))
            if out:
                yield dict(zip(("doc_id", "run", "start", "end", "lang", "n_words"), map(list, zip(*out, strict=True)), strict=True))

    return map_batches(text_rows(docs), run, "doc_id long, run long, start long, end long, lang string, n_words long")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without texts that have no language: no letter, or a best mean posterior under least.

    Where no row is labelled nothing can be told of a text with a letter, and it stays. Null and empty texts go; rows without doc_id and
    repeated rows are read each; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import pyarrow.compute as pc
        import pyarrow as pa

        read = Reader(shared.value)
        for b in batches:
            texts = b["text"].to_pylist()
            if read.field.labels:
                kept = [r.lang != UNKNOWN and r.score >= least for r in read(texts)]
            else:
                kept = [any(map(str.isalpha, x or "")) for x in texts]
            mask = pa.array(kept, pa.bool_())
            yield {k: pc.filter(v, mask) for k, v in b.items()}

    return map_batches(text_rows(docs, "lang", "source", "n_chars"), run, "doc_id long, text string, lang string, source string, n_chars long")
