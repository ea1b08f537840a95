"""Repair of the structure of conversations: the cheapest edits that make the roles read s?(ua)+, or nothing.

Rows of a conversation are taken in the order of their turns (nulls first; rows of one turn by role, then text). A row's
first fault is blank (no character but ASCII white space), duplicate (its role and text stand earlier) or truncated (its
last such character is none of .!?). Edits: Keep is free, Rerole to user or assistant costs 3, Delete 4 (the only edit for
blank and duplicate rows), Insert of an empty user or assistant row 3; a truncated row that stays costs 3 more. Of the
cheapest lists of edits, the one whose initials are least in ASCII order is taken.

Each search is A* on the lattice of (rows read, state of the role pattern). The heuristic is the suffix sum of what rows
cost at least: 4 for a row that must go, 3 for a truncated one. It depends on the row only and no step costs less than
what it takes off, so with keys (cost plus heuristic, edits so far) the first way to a node is the cheapest and, among
those, the least.

One shuffle by conversation; the rows then pass a task as a sorted stream. A conversation longer than BLOCK rows is
searched block by block: each block gives the best edits from each state to each state, which are joined at the seams
(edits of equal cost between the same nodes are never one the start of the other, so least parts make least wholes).
A way that costs over _SLACK more than another is dropped, as the other can do what it does for that much; edits on which
all ways agree are final and leave the task at once. So texts are held for a block, or as long as ways differ.

Defined results: null roles and texts count as one space, a null conversation or turn is a value like any other. An empty
role can't be kept. Repeated rows are duplicates. A conversation none of whose rows is live still gives one row, without
an edit. An empty table gives no rows. Texts of any length are read whole. Other columns are not carried over, so their
names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows searched at once.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"

#: States of the pattern: nothing yet, after s, after u, after a. The state after a role's initial:
_STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that Rerole and Insert give in a state, by its initial.
_NEXT = ("u", "u", "a", "u")
_ENDS = (0, 3)
_FULL = {"u": "user", "a": "assistant"}
#: From any state, what is legal after another costs at most an Insert and a Delete more.
_SLACK = INSERT + DELETE

#: Letters of a row's kind: its role's initial (x: none that can be kept), then its fault: must go, truncated or fine.
_GO, _CUT, _FINE = "g", "t", "f"


def _search(kinds: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """The least (cost, edits) from entry to each state behind the rows; last: only that of the best end."""
    n = len(kinds) // 2
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + {_GO: DELETE, _CUT: TRUNCATED, _FINE: 0}[kinds[2 * i + 1]]
    heap, done, out = [(least[0], "", 0, entry)], set(), {}
    while heap:
        key, edits, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        cost = key - least[at]
        if at == n:
            out[state] = (cost, edits)
            if last and state in _ENDS:
                return {state: (cost, edits)}
        given = _STEP[state][_NEXT[state]]
        heappush(heap, (key + INSERT, edits + "I", at, given))
        if at < n:
            base, role, fault = cost + least[at + 1], kinds[2 * at], kinds[2 * at + 1]
            heappush(heap, (base + DELETE, edits + "D", at + 1, state))
            if fault != _GO:
                base += TRUNCATED if fault == _CUT else 0
                heappush(heap, (base + REROLE, edits + "R", at + 1, given))
                if role in _STEP[state]:
                    heappush(heap, (base + KEEP, edits + "K", at + 1, _STEP[state][role]))
    return out


_short = lru_cache(1 << 15)(_search)


def cheapest(kinds: str, entry: int = 0, last: bool = True) -> dict[int, tuple[int, str]]:
    return (_short if len(kinds) <= 32 else _search)(kinds, entry, last)


class _Conversation:
    """Decides the rows of one conversation as they come."""

    def __init__(self, conv, block: int):
        self.conv, self.block = conv, block
        self.held: list[tuple] = []  # rows without a final edit
        self.new = 0  # of these, rows that no search has read
        self.ways = {0: (0, "")}  # by state: cost and edits since the last final one
        self.state = 0  # of the final edits
        self.any = False

    def add(self, row: tuple) -> Iterator[tuple]:
        self.held.append(row)
        self.new += 1
        if self.new >= self.block:
            yield from self._read(False)

    def end(self) -> Iterator[tuple]:
        yield from self._read(True)
        if not self.any:
            yield (self.conv, None, None, None, None, None, None, 0)

    def _read(self, last: bool) -> Iterator[tuple]:
        kinds = "".join(r[4] for r in self.held[len(self.held) - self.new :])
        best: dict[int, tuple[int, str]] = {}
        for entry, (cost, edits) in self.ways.items():
            for state, (more, then) in cheapest(kinds, entry, last).items():
                if state not in best or (cost + more, edits + then) < best[state]:
                    best[state] = (cost + more, edits + then)
        if last:
            best = dict([min(best.items(), key=lambda x: x[1])])
        low = min(c for c, _ in best.values())
        best = {s: w for s, w in best.items() if w[0] <= low + _SLACK}
        agreed = len(commonprefix([e for _, e in best.values()]))
        yield from self._apply(next(iter(best.values()))[1][:agreed])
        self.ways, self.new = {s: (c, e[agreed:]) for s, (c, e) in best.items()}, 0

    def _apply(self, edits: str) -> Iterator[tuple]:
        rows = iter(self.held)
        for edit in edits:
            self.any = True
            if edit == "I":
                to = _NEXT[self.state]
                self.state = _STEP[self.state][to]
                yield (self.conv, None, edit, None, _FULL[to], "", None, INSERT)
                continue
            turn, role, text, fault, kind = next(rows)
            charge = TRUNCATED if kind[1] == _CUT else 0
            if edit == "D":
                yield (self.conv, turn, edit, role, None, text, fault, DELETE)
            elif edit == "K":
                self.state = _STEP[self.state][kind[0]]
                yield (self.conv, turn, edit, role, role, text, fault, charge)
            else:
                to = _NEXT[self.state]
                self.state = _STEP[self.state][to]
                yield (self.conv, turn, edit, role, _FULL[to], text, fault, REROLE + charge)
        self.held = list(rows)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def edits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live: Column | None = None, *, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, edit, was, role, text, fault, cost): one row an edit, in the order of each conversation's edits.

    edit: K, R, D or I; was and role: the row's role before and after (null for a deleted row); rows where live is not
    true are not there. A conversation's edits are neighbours in one partition.
    """
    live = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    space = F.lit(" ")
    one = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("was"), F.coalesce(F.col(text_col), space).alias("text"), live.alias("live"),
    )
    one = one.withColumn("text", F.when(F.col("live"), F.col("text")))
    # partitions by conversation serve the window as well: one shuffle
    one = one.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "was", "text").orderBy(F.col("turn").asc_nulls_first()))
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(trimmed == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.left(F.col("was"), F.lit(1))
    kind = F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
        F.when(F.col("fault").isin("blank", "duplicate"), _GO).when(F.col("fault") == "truncated", _CUT).otherwise(_FINE),
    )
    one = one.withColumn("seen", seen).withColumn("fault", fault).withColumn("kind", kind)
    one = one.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "was", "text", "seen")
    one = one.select("conv_id", "turn", "was", "text", "fault", "kind", "live")
    types = {f.name: f.dataType.simpleString() for f in one.schema.fields}
    schema = f"conv_id {types['conv_id']}, turn {types['turn']}, edit string, was string, role string, text string, fault string, cost bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        s = pa.string()
        names = ("conv_id", "turn", "edit", "was", "role", "text", "fault", "cost")
        arrow = pa.schema(list(zip(names, (first.schema.field(0).type, first.schema.field(1).type, s, s, s, s, s, pa.int64()))))

        def decided() -> Iterator[tuple]:
            now = None
            for batch in _chain(first, batches):
                for conv, turn, was, text, fault, kind, alive in _rows(iter([batch])):
                    if now is None or now.conv != conv:
                        if now is not None:
                            yield from now.end()
                        now = _Conversation(conv, block)
                    if alive:
                        yield from now.add((turn, was, text, fault, kind))
            if now is not None:
                yield from now.end()

        yield from _batches(decided(), arrow)

    return one.mapInArrow(run, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def repaired(found: DataFrame) -> DataFrame:
    """The conversations after their repair, from edits(): (conv_id, role, text), in order within each."""
    return found.filter(F.col("role").isNotNull()).select("conv_id", "role", "text")


class _Report:
    """Counts of a conversation and the digest of its repaired form, from its edits in order."""

    def __init__(self, conv):
        self.conv, self.low, self.high, self.distinct, self.prior = conv, None, None, 0, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.cost, self.audit, self.digest, self.some = 0, 0, [], hashlib.sha256(), False

    def add(self, turn, edit, was, role, text, fault, cost) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.distinct = turn, self.distinct + 1
            if fault is not None:
                self.faults[fault] += 1
            self.illegal += self.prior is not None and self.prior + was[:1] not in ("su", "ua", "au")
            self.prior = was[:1]
        if role is not None:
            self.digest.update((("\n" if self.some else "") + role + ":").encode())
            self.digest.update(text.encode())
            self.some = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(found: DataFrame) -> DataFrame:
    """One row a conversation, from edits(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Reads edits() in the order in which it gives them, so nothing that moves rows may stand between.
    """
    conv = found.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        arrow = pa.schema([("conv_id", first.schema.field(0).type), *((n, pa.int64()) for n in _REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def reports() -> Iterator[tuple]:
            now = None
            for conv_id, *edit in _rows(_chain(first, batches)):
                if now is None or now.conv != conv_id:
                    if now is not None:
                        yield now.row()
                    now = _Report(conv_id)
                now.add(*edit)
            if now is not None:
                yield now.row()

        yield from _batches(reports(), arrow)

    return found.mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{n} bigint" for n in _REPORT) + ", audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(conv_id:turn) mod 20: rows with live false are dropped ones."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hurt = rows.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    return hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(copies).alias("copy"))
