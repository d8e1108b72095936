"""Conversation structure repair: cheapest edits by dynamic programming over a trie of sorted signatures of roles and faults."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlspike.llm.common import map_batches, materialize, prepare

#: Costs of edits and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row. NEXT: where an inserted or reroled row leads; ENDS: inserts that
#: a state still needs to end well; KEPT: where a row of a role leads from the states that allow it.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (0, 2, 1, 0)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols of a signature: a row that must go; else its role's initial (x: none of them), in upper case if the row is truncated.
GOES = "-"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: One in DAMAGE rows suffers each fault of the task.
DAMAGE = 20

#: cost, rank of the edits so far among those of the layer's states, state before, edits of this row: of each state, None if it can't be reached.
Cell = tuple[int, int, int, str]
Layer = tuple["Cell | None", ...]
FIRST: Layer = ((0, 0, 0, ""), None, None, None)


def step(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row: the cheapest edits to each state, of equal ones the least in ASCII.

    A layer's edits all end with their row's own letter, so none is the beginning of another, and of two that continue different states the
    order of those decides. Three inserts in a row lead where one does.
    """
    best: list[tuple[int, int, str, int] | None] = [None] * 4
    role, whole = symbol.lower(), symbol.islower()
    for p, cell in enumerate(layer):
        if cell is None:
            continue
        cost, at = cell[0], p
        for inserts in range(3):
            options = [("D", at, DELETE)]
            if symbol != GOES:
                more = 0 if whole else TRUNCATED
                options.append(("R", NEXT[at], REROLE + more))
                if at in KEPT.get(role, {}):
                    options.append(("K", KEPT[role][at], more))
            for letter, to, price in options:
                found = (cost + price, cell[1], "I" * inserts + letter, p)
                if best[to] is None or found < best[to]:
                    best[to] = found
            cost, at = cost + INSERT, NEXT[at]
    order = sorted((x[1], x[2], q) for q, x in enumerate(best) if x)
    rank = {q: k for k, (_, _, q) in enumerate(order)}
    return tuple(None if x is None else (x[0], rank[q], x[3], x[2]) for q, x in enumerate(best))


def answer(layers: list[Layer]) -> tuple[int, str]:
    """Cost and edits of the rows whose layers these are, the first of which is FIRST."""
    cost, _, ending, q = min((c[0] + INSERT * ENDS[q], c[1], "I" * ENDS[q], q) for q, c in enumerate(layers[-1]) if c)
    edits = [ending]
    for layer in reversed(layers[1:]):
        edits.append(layer[q][3])
        q = layer[q][2]
    return cost, "".join(reversed(edits))


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of distinct signatures.

    Each task walks a range of sorted signatures, which is the trie in depth-first order: it holds the layers of one path, goes back to the prefix that
    the next signature shares, and answers where a signature ends. A prefix's layer is computed once in each range that has it.
    """

    def walk(batches: Iterator[dict]) -> Iterator[dict]:
        path, layers = "", [FIRST]
        for b in batches:
            out: dict[str, list] = {"signature": b["signature"].to_pylist(), "cost": [], "audit": []}
            for s in out["signature"]:
                shared = next((i for i, (x, y) in enumerate(zip(path, s)) if x != y), min(len(path), len(s)))  # noqa: B905
                del layers[shared + 1 :]
                for symbol in s[shared:]:
                    layers.append(step(layers[-1], symbol))
                path = s
                cost, audit = answer(layers)
                out["cost"].append(cost)
                out["audit"].append(audit)
            yield out

    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(signatures.repartitionByRange(n, "signature").sortWithinPartitions("signature"), walk, "signature string, cost long, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows as the task damages them; nulls of role and text are one space, dropped rows have no copies."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % DAMAGE
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def cells(rows: DataFrame) -> DataFrame:
    """Stored conv_id, turn, role, text, text_key, copies, symbols of rows (conv_id, turn, role, text, copies): equal rows of a turn are one, with the symbols of
    each of its copies.

    Equal rows are added up before the shuffle, and so are the first turns of equal rows of a conversation, which tell what was seen earlier.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("text_key", F.sha2("text", 256))
    one = materialize(one, "conversation-rows")
    blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    turn = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    seen = one.where((F.col("copies") > 0) & ~blank).select("conv_id", "role", "text_key", turn.alias("at")).groupBy("conv_id", "role", "text_key").agg(F.min("at").alias("earliest"))
    same = F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("o.role") == F.col("s.role")) & (F.col("o.text_key") == F.col("s.text_key"))
    joined = one.alias("o").join(seen.alias("s"), same, "left").select("o.*", "s.earliest")
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin(*KEPT), initial).otherwise("x")
    head = F.when(blank | (turn > F.col("earliest")), F.lit(GOES)).when(ended, symbol).otherwise(F.upper(symbol))
    kind = F.when(blank, "b").when(turn > F.col("earliest"), "d").when(ended, "k").otherwise("t")
    rest = F.greatest(F.col("copies") - 1, F.lit(0)).cast("int")
    symbols = F.when(F.col("copies") == 0, F.lit("")).otherwise(F.concat(head, F.repeat(F.lit(GOES), rest)))
    return joined.select("conv_id", "turn", "role", "text", "text_key", "copies", kind.alias("kind"), initial.alias("initial"), symbols.alias("symbols"))


ORDER = ("turn", "role", "text_key")


def signed(found: DataFrame) -> DataFrame:
    """A row for each conv_id: signature, gaps, blank, duplicate, truncated, illegal of cells. A conversation's rows stream through one task in order, which keeps a
    letter of each row."""
    key = found.schema["conv_id"].dataType.simpleString()
    rows = found.select("conv_id", "turn", "role", "text_key", "copies", "kind", "initial", "symbols")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now = None

        def closed() -> dict:
            conv, parts, n, low, high, turns = now["conv"], now["parts"], now["n"], now["low"], now["high"], now["turns"]
            gaps = min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0
            return {"conv_id": conv, "signature": "".join(parts), "gaps": gaps, "blank": n["b"], "duplicate": n["d"], "truncated": n["t"], "illegal": n["illegal"]}

        for b in batches:
            out = []
            cols = (b[k].to_pylist() for k in ("conv_id", "turn", "copies", "kind", "initial", "symbols"))
            for conv, turn, copies, kind, initial, symbols in zip(*cols, strict=True):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        out.append(closed())
                    now = {"conv": conv, "parts": [], "n": dict.fromkeys(("b", "d", "k", "t", "illegal"), 0), "low": None, "high": None, "turns": 0, "before": None}
                if not copies:
                    continue
                now["parts"].append(symbols)
                n = now["n"]
                n[kind] += 1
                n["b" if kind == "b" else "d"] += copies - 1
                n["illegal"] += (now["before"] is not None and (now["before"], initial) not in LEGAL) + copies - 1
                now["before"] = initial
                if turn is not None:
                    now["turns"] += now["turns"] == 0 or now["high"] != turn
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            if out:
                yield {k: [x[k] for x in out] for k in out[0]}
        if now is not None:
            yield {k: [v] for k, v in closed().items()}

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return map_batches(dealt, run, f"conv_id {key}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def edits_of(audit: str) -> Iterator[str]:
    """The edits of each row in turn, inserts before a row with it; last the inserts at the end."""
    start = 0
    for k, letter in enumerate(audit):
        if letter != "I":
            yield audit[start : k + 1]
            start = k + 1
    yield audit[start:]


class Repaired:
    """The rows of a repaired conversation, one after the other."""

    def __init__(self, audit: str):
        self.edits, self.state = edits_of(audit), START

    def _made(self) -> str:
        self.state = NEXT[self.state]
        return ROLES[self.state]

    def rows(self, role: str | None = None, text: str | None = None, copies: int = 1) -> Iterator[tuple[str, str]]:
        """What comes of an original row and its copies; without one, what follows the last."""
        for _ in range(copies):
            for letter in next(self.edits):
                if letter == "I":
                    yield self._made(), ""
                elif letter == "R":
                    yield self._made(), text
                elif letter == "K":
                    self.state = KEPT[role[0]][self.state]
                    yield role, text


def rebuilt(found: DataFrame, answers: DataFrame, each, schema: str) -> DataFrame:
    """Conversations' rows in order beside their answers (conv_id, audit, …): each(answer as a dict, iterator of (role, text)) gives a row of the schema.

    The answer comes first and the rows stream after it, so that no task holds a conversation's texts."""
    names = [c for c in answers.columns if c != "conv_id"]
    rows = found.where("copies > 0").select("conv_id", F.lit(1).alias("later"), *ORDER, "text", "copies", *[F.lit(None).cast(answers.schema[c].dataType).alias(f"of_{c}") for c in names])
    heads = answers.select("conv_id", F.lit(0).alias("later"), F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text_key", "text")], F.lit(0).cast("long").alias("copies"), *[F.col(c).alias(f"of_{c}") for c in names])
    dealt = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "later", *ORDER)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b[k].to_pylist() for k in ("conv_id", "later", "role", "text", "copies", *[f"of_{c}" for c in names])), strict=True)

        feed = stream()
        head = next(feed, None)
        out: list[dict] = []
        while head is not None:
            of, after = {"conv_id": head[0]} | dict(zip(names, head[5:], strict=True)), None
            repaired = Repaired(of["audit"])

            def made() -> Iterator[tuple[str, str]]:
                nonlocal after
                for row in feed:
                    if not row[1]:
                        after = row
                        break
                    yield from repaired.rows(row[2], row[3], row[4])  # noqa: B023
                yield from repaired.rows()  # noqa: B023

            out.append(each(of, made()))
            head = after
            if len(out) >= 1000:
                yield {k: [x[k] for x in out] for k in out[0]}
                out = []
        if out:
            yield {k: [x[k] for x in out] for k in out[0]}

    return map_batches(dealt, run, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def digest(of: dict, rows: Iterator[tuple[str, str]]) -> dict:
    h = hashlib.sha256()
    for k, (role, text) in enumerate(rows):
        h.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
    return of | {"repaired_sha256": h.hexdigest()}


def repaired_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored cells of rows (conv_id, turn, role, text, copies), and answers: conv_id, the counts, cost and audit of every conversation."""
    found = materialize(cells(rows), "conversation-cells")
    convs = materialize(signed(found), "conversation-signatures")
    fixed = materialize(repairs(convs.select("signature").distinct()), "conversation-repairs")
    return found, convs.join(fixed, "signature").select("conv_id", *COUNTS, "audit")


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations after repair, turns anew from 0; conversations of which nothing stays have no row."""
    prepare(conversations.sparkSession)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    found, answers = repaired_of(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), F.lit(1).cast("long").alias("copies")))
    key = T.StructType([found.schema["conv_id"]])["conv_id"].dataType.simpleString()
    each = lambda of, rows: {"conv_id": of["conv_id"], "rows": [{"role": r, "text": t} for r, t in rows]}
    whole = rebuilt(found, answers.select("conv_id", "audit"), each, f"conv_id {key}, rows array<struct<role:string,text:string>>")
    return whole.select("conv_id", F.posexplode("rows").alias("turn", "row")).select("conv_id", F.col("turn").cast("long").alias("turn"), "row.role", "row.text")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id, after the task's damage.

    Nulls: conv_id null is one conversation, null turns come first, role and text are one space, which is blank text and a role that can't stay. Empty
    texts are blank; texts of any length are read whole. Rows of one turn go by role, then by the SHA-256 of their text; equal rows are
    duplicates of the first. An empty table gives no rows; other columns are ignored. One conversation is read in order by one task, as its audit is one
    value; only a letter for each row is kept. Equal signatures of any number are repaired once.
    """
    prepare(conversations.sparkSession)
    found, answers = repaired_of(damaged(conversations))
    key = found.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COUNTS)
    return rebuilt(found, answers, digest, f"conv_id {key}, {longs}, audit string, repaired_sha256 string")
