"""Repair of the turns of conversations by the cheapest edits, with Four-Russians block tables.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``.  From
the last row to the first, four costs are carried along: the cheapest way to
finish from each state of that pattern.  Costs less their minimum take few
values, so what a block of ``BLOCK`` rows does to them is computed once for each
block of symbols and each vector of costs, and rows are then processed a block
at a time by lookup.  The edits are read off from the first row on, by expanding
one block after the other backward from the vector kept at its end; of equally
cheap edits the least letter is taken, which gives the least sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from furlong.llm.store import stored

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
"""Costs of edits, and of a truncated row that stays; keeping costs nothing."""
# States: nothing yet, after system, after user, after assistant.
ALTERNATE = (2, 2, 3, 2)
"""State after a user or assistant turn that fits, whichever it is."""
GONE = 8
"""Symbol of a row that must go; the others are 2 * class of the role's initial (s, u, a, another) + truncated."""
SYMBOLS = 9
BLOCK = 4
HELD = 32 << 20
"""Bytes of text of one conversation that a task holds; more are written out and read once its edits are known."""
SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")


def kept(state: int, symbol: int) -> int | None:
    """State after a row that stays as it is; none if it doesn't fit."""
    role = symbol >> 1
    if symbol == GONE:
        return None
    return (1 if state == 0 else None, 2 if state != 2 else None, 3 if state == 2 else None, None)[role]


def ways(costs: tuple[int, ...], symbol: int, state: int) -> list[tuple[int, str, int]]:
    """Cost, letter and next state of each edit of a row, given the costs of what follows."""
    extra = UNFINISHED * (symbol & 1) if symbol != GONE else 0
    out = [(DELETE + costs[state], "D", state)]
    to = kept(state, symbol)
    if to is not None:
        out.append((extra + costs[to], "K", to))
    if symbol != GONE:
        out.append((REROLE + extra + costs[ALTERNATE[state]], "R", ALTERNATE[state]))
    return out


def before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from each state before a row; turns may be inserted first."""
    base = [min(ways(costs, symbol, q))[0] for q in range(4)]
    once = [min(base[q], INSERT + base[ALTERNATE[q]]) for q in range(4)]
    return tuple(min(once[q], INSERT + once[ALTERNATE[q]]) for q in range(4))


END = (0, 2 * INSERT, INSERT, 0)
"""Costs after the last row: what the pattern still asks for is inserted."""


class Tables:
    """Transitions of cost vectors, for single symbols and for blocks.

    ``vectors`` are all normalised vectors that rows can lead to from ``END``.
    For a block (its symbols as digits, the first one the highest) and the
    vector after it, ``to`` has the vector before it and ``cost`` what was taken off.
    """

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [END]
        index = {END: 0}
        step: list[list[tuple[int, int]]] = []
        for vector in self.vectors:
            row = []
            for symbol in range(SYMBOLS):
                costs = before(vector, symbol)
                low = min(costs)
                plain = tuple(c - low for c in costs)
                if plain not in index:
                    index[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((index[plain], low))
            step.append(row)
        self.to = [np.array([[v for v, _ in row] for row in step], np.int32).T.copy()]
        self.cost = [np.array([[c for _, c in row] for row in step], np.int32).T.copy()]
        while len(self.to) < block:
            one, paid, rest, rest_paid = self.to[0], self.cost[0], self.to[-1], self.cost[-1]
            self.to.append(one[:, rest].reshape(-1, len(self.vectors)))
            self.cost.append((paid[:, rest] + rest_paid[None]).reshape(-1, len(self.vectors)))

    def backward(self, symbols: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
        """Blocks in order, each as its length, its code and the vector after it; and the cost of all."""
        first = len(symbols) % self.block
        digits = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        codes = (symbols[first:].reshape(-1, self.block) @ digits).tolist()
        to, cost = self.to[-1], self.cost[-1]
        vector = total = 0
        out = []
        for code in reversed(codes):
            out.append((self.block, code, vector))
            total += int(cost[code, vector])
            vector = int(to[code, vector])
        if first:
            code = int(symbols[:first] @ digits[-first:])
            out.append((first, code, vector))
            total += int(self.cost[first - 1][code, vector])
            vector = int(self.to[first - 1][code, vector])
        return out[::-1], total + self.vectors[vector][0]

    @lru_cache(maxsize=200_000)  # noqa: B019
    def expand(self, length: int, code: int, vector: int, state: int) -> tuple[str, int]:
        """Letters of a block's cheapest edits from a state, the least of equals, and the state after it."""
        digits = []
        for _ in range(length):
            code, digit = divmod(code, SYMBOLS)
            digits.append(digit)
        after = [vector]
        for digit in digits[:-1]:
            after.append(int(self.to[0][digit, after[-1]]))
        letters = ""
        for digit, index in zip(reversed(digits), reversed(after), strict=True):
            costs = self.vectors[index]
            while True:
                found = ways(costs, digit, state)
                # Inserting leads to the costs of the other state before the same row.
                here = before(costs, digit)
                found.append((INSERT + here[ALTERNATE[state]], "I", state))
                letter, to = min((x, q) for c, x, q in found if c == here[state])
                letters += letter
                if letter != "I":
                    state = to
                    break
                state = ALTERNATE[state]
        return letters, state

    def edits(self, symbols: np.ndarray) -> tuple[str, int]:
        """Letters of the cheapest edits of all rows, and their cost."""
        blocks, cost = self.backward(symbols)
        out, state = [], 0
        for length, code, vector in blocks:
            letters, state = self.expand(length, code, vector, state)
            out.append(letters)
        out.append("I" * (END[state] // INSERT))
        return "".join(out), cost


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class Writer:
    """Applies the letters of edits to rows in order; state is kept from row to row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _alternate(self) -> str:
        self.state = ALTERNATE[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """Turns inserted at the place reached."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._alternate(), "", "I"

    def row(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """What becomes of a row and its copies."""
        for _ in range(copies):
            yield from self.inserted()
            letter = self.audit[self.at]
            self.at += 1
            if letter == "K":
                self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
                yield role, text, letter
            elif letter == "R":
                yield self._alternate(), text, letter


@dataclass
class Run:
    """Rows of one conversation that follow each other in a partition."""

    key: object
    symbols: bytearray = field(default_factory=bytearray)
    rows: list[tuple[str, str, int]] = field(default_factory=list)
    held: int = 0
    written: int = 0
    faults: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None
    same: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, kind: int, copies: int) -> None:
        """A row and its copies; kind: 0, or 1 + its place in FAULTS."""
        if self.same == (turn, role, text) and kind != 1:
            kind = 2
        self.same = (turn, role, text)
        initial = role[:1]
        self.illegal += (self.last is not None and not sound(self.last, initial)) + (copies - 1) * (not sound(initial, initial))
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        code = GONE if kind in (1, 2) else 2 * {"s": 0, "u": 1, "a": 2}.get(initial, 3) + (kind == 3)
        self.symbols.append(code)
        self.symbols += bytes([GONE]) * (copies - 1)
        if kind:
            self.faults[kind - 1] += 1
        self.faults[0 if kind == 1 else 1] += copies - 1
        self.rows.append((role, text, copies))
        self.held += len(role) + len(text) + 100

    def join(self, facts: dict) -> None:
        """Add the next run of the same conversation, of which only its facts are known."""
        if facts["first"] is None:
            return
        self.illegal += facts["illegal"] + (self.last is not None and not sound(self.last, facts["first"]))
        self.first = facts["first"] if self.first is None else self.first
        self.last = facts["last"]
        self.symbols += facts["symbols"]
        self.faults = [a + b for a, b in zip(self.faults, (facts[f] for f in FAULTS), strict=True)]
        if facts["low"] is not None:
            self.turns += facts["turns"] - (self.high == facts["low"])
            self.low = facts["low"] if self.low is None else self.low
            self.high = facts["high"]

    def facts(self) -> dict:
        return {"symbols": bytes(self.symbols), "illegal": self.illegal, "first": self.first, "last": self.last, "turns": self.turns, "low": self.low, "high": self.high, **dict(zip(FAULTS, self.faults, strict=True))}

    def result(self, audit: str, cost: int, digest: str) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return {"conv_id": self.key, "gaps": gaps, **dict(zip(FAULTS, self.faults, strict=True)), "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def sound(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for role, text, _ in turns:
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "place long, edit string, role string, text string"
RUN = "symbols binary, first string, last string, turns long, low long, high long"


def _prepared(conversations: DataFrame, damage: Column | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct rows with the number of their copies and their fault: conv_id, turn, role, text, copies (0: dropped), kind."""
    blank = F.lit(" ")
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), blank).alias("role"), F.coalesce(F.col(text_col).cast("string"), blank).alias("text"))
    # Copies of a row are counted before anything is shuffled.
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    if damage is not None:
        rows = rows.withColumn("rule", damage)
        rows = rows.select(
            "conv_id", "turn", F.when(F.col("rule") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("rule").isin(0, 1), "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("rule") == 0, 0).when(F.col("rule") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"),
        )
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    # What is said at two turns or more, and when first (a turn of null comes first).
    first = rows.where("copies > 0").groupBy("conv_id", "said").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    first = first.where("unnumbered and low is not null or low < high").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), F.when(~F.col("unnumbered"), F.col("low")).alias("low"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.when(end == "", 1).when(F.col("s").isNotNull() & ~F.col("turn").eqNullSafe(F.col("low")), 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "copies", kind.alias("kind"))


def damage_rule(conv_id: Column, turn: Column) -> Column:
    """crc32 of ``conv_id:turn`` modulo 20; a null is one space."""
    return F.crc32(F.concat(F.coalesce(conv_id.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20


def repair(conversations: DataFrame, damaged: bool = False, turns: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD) -> DataFrame:
    """Faults of each conversation and its cheapest repair.

    One row for each conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256; or, with ``turns``, the repaired turns
    as rows: conv_id, place (from 0), edit (K, R or I), role, text.  ``damaged``
    spoils the rows first, by ``damage_rule``.

    Rows are taken by turn (nulls first), then role, then text; copies of a row
    stand side by side.  Null roles and texts are one space; a null conv_id is a
    conversation of its own.  A conversation without rows after damage has zeros,
    an empty audit and the digest of nothing; an empty table gives no rows; other
    columns are not read.

    Rows are range-partitioned by conversation and place, so a conversation of
    any length is sorted and classified by many tasks.  One that lies inside a
    partition is finished there, the first and last of a partition and those
    above ``held`` bytes in a second pass: it holds a byte for each row (as the
    audit, which is one value) and streams the texts in order through the hash,
    which no two tasks can share.
    """
    rule = damage_rule(F.col("conv_id"), F.col("turn")) if damaged else None
    rows = _prepared(conversations, rule, conv_col, turn_col, role_col, text_col)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    placed = rows.repartitionByRange(*order, F.substring("text", 1, 64).asc()).sortWithinPartitions(*order, "text")
    key = StructField("conv_id", rows.schema["conv_id"].dataType)
    whole = _parse_datatype_string(TURN if turns else RESULT)
    extra = _parse_datatype_string(f"part int, stage int, no long, copies long, illegal long, {', '.join(f'{f} long' for f in FAULTS)}, " + RUN + ("" if turns else ", role string, text string"))
    fields = {f.name: f for f in [key, *extra, *whole]}
    first = StructType(list(fields.values()))
    last = StructType([key, *whole])
    found = stored(placed.mapInArrow(_classify(first, turns, held), first), "conversations")
    done = found.where("stage = 0").select(*last.names)
    open_rows = found.where("stage > 0").drop(*(c for c in last.names if c not in ("conv_id", "role", "text", *FAULTS, "illegal")))
    sort = [F.col("conv_id").asc_nulls_first(), "stage", "part", "no"]
    return done.unionByName(open_rows.repartition("conv_id").sortWithinPartitions(*sort).mapInArrow(_finish(last, turns), last))


def _batches(rows: Iterator[dict], schema: StructType, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of some megabytes."""
    target = to_arrow_schema(schema)
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 200 + len(row.get("text") or "") + len(row.get("symbols") or b"") + len(row.get("audit") or "")
        if weight > size:
            yield pa.RecordBatch.from_pylist(held, target)
            held, weight = [], 0
    yield pa.RecordBatch.from_pylist(held, target)


def _completed(run: Run, turns: bool) -> Iterator[dict]:
    """Results of a conversation whose rows are all held."""
    audit, cost = tables().edits(np.frombuffer(bytes(run.symbols), np.uint8).astype(np.int64))
    writer = Writer(audit)
    repaired = [x for row in run.rows for x in writer.row(*row)] + list(writer.inserted())
    if turns:
        yield from ({"conv_id": run.key, "place": i, "edit": letter, "role": role, "text": text} for i, (role, text, letter) in enumerate(repaired))
        return
    digest = Digest()
    digest.add(iter(repaired))
    yield run.result(audit, cost, digest.hash.hexdigest())


def _classify(schema: StructType, turns: bool, held: int):
    """From sorted rows to finished conversations (stage 0), runs of rows (1) and texts (2)."""

    def texts(run: Run, part: int) -> Iterator[dict]:
        for role, text, copies in run.rows:
            yield {"conv_id": run.key, "part": part, "stage": 2, "no": run.written, "role": role, "text": text, "copies": copies}
            run.written += 1
        run.rows, run.held = [], 0

    def end(run: Run, part: int, inner: bool) -> Iterator[dict]:
        if inner and not run.written:
            yield from ({"stage": 0, **x} for x in _completed(run, turns))
            return
        yield from texts(run, part)
        yield {"conv_id": run.key, "part": part, "stage": 1, "no": 0, **run.facts()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        run, inner = None, False
        for batch in batches:
            for key, turn, role, text, copies, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "kind")), strict=True):
                if run is None or key != run.key:
                    if run is not None:
                        yield from end(run, part, inner)
                        inner = True
                    run = Run(key)
                if copies:
                    run.add(turn, role, text, kind, copies)
                    if run.held > held:
                        yield from texts(run, part)
        if run is not None:
            yield from end(run, part, False)

    return lambda batches: _batches(rows(batches), schema)


def _finish(schema: StructType, turns: bool):
    """Runs of a conversation, then its texts, to its results."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        run = writer = None
        digest, place, audit, cost = Digest(), 0, "", 0

        def close() -> Iterator[dict]:
            if writer is None:
                start()
            for x in pass_on(writer.inserted()):
                yield x
            if not turns:
                yield run.result(audit, cost, digest.hash.hexdigest())

        def start() -> None:
            nonlocal writer, audit, cost
            audit, cost = tables().edits(np.frombuffer(bytes(run.symbols), np.uint8).astype(np.int64))
            writer = Writer(audit)

        def pass_on(repaired: Iterator[tuple[str, str, str]]) -> Iterator[dict]:
            nonlocal place
            for x in repaired:
                if turns:
                    yield {"conv_id": run.key, "place": place, "edit": x[2], "role": x[0], "text": x[1]}
                    place += 1
                else:
                    digest.add(iter([x]))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if run is None or row["conv_id"] != run.key:
                    if run is not None:
                        yield from close()
                    run, writer, digest, place = Run(row["conv_id"]), None, Digest(), 0
                if row["stage"] == 1:
                    run.join(row)
                    continue
                if writer is None:
                    start()
                yield from pass_on(writer.row(row["role"], row["text"], row["copies"]))
        if run is not None:
            yield from close()

    return lambda batches: _batches(rows(batches), schema)
