"""Conversation structure repair: the cheapest edits that make roles alternate, by Viterbi with survivor coalescence.

A conversation's turns, in the order of turn (nulls first), role and text, pass once through a task that holds no
more than what is undecided. Per state of the grammar `(s?(ua)+)?` the cheapest edits so far survive, as leaves of
one tree of back pointers with reference counts; whenever all survivors share an ancestor, the edits up to it are
given out and forgotten. Survivors of equal cost are compared by all their undecided letters: as no survivor's edits
are a prefix of another's (they end with the edit of the same turn), their order, once known, is carried along as a
rank. A survivor that costs so much more than another that no end can make it up is dropped.

Edits: K keeps a turn, R gives it the role user or assistant (2), D deletes it (3), I inserts a turn without text
(2). Blank and repeated turns must go; an undeleted turn that doesn't end with . ! or ? costs 1 more.
Whether role and text stood earlier in the conversation is found by an aggregation before, not in the task. The digest
of a conversation is sequential by its definition, so a conversation is read by one task, as a stream.

Defined results: null role or text count as one space; conversations and turns may be null, null ids are one
conversation; equal rows are repeated turns; a conversation without turns has zeros, no edits and the digest of the
empty text; gaps beyond a long are the largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: State after a role's initial, and after an inserted or re-roled turn.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that reach another state, without repeating one.
INSERTS = {START: ((START, ""), (USER, "I"), (ASSISTANT, "II")), SYSTEM: ((SYSTEM, ""), (USER, "I"), (ASSISTANT, "II")), USER: ((USER, ""), (ASSISTANT, "I")), ASSISTANT: ((ASSISTANT, ""), (USER, "I"))}
#: Inserts that end a conversation.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: DEARER[x][y]: what any end from x costs more, at most, if it is taken from y.
DEARER = {
    START: {SYSTEM: 4, USER: 5, ASSISTANT: 3},
    SYSTEM: {START: 0, USER: 2, ASSISTANT: 0},
    USER: {START: 2, SYSTEM: 2, ASSISTANT: 2},
    ASSISTANT: {START: 0, SYSTEM: 4, USER: 2},
}


def _steps(state: int, initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, str]]:
    """(state reached, cost, letters) of the ways over one turn, the best for each state reached."""
    best: dict[int, tuple[int, str]] = {}
    for at, letters in INSERTS[state]:
        cost = INSERT * len(letters)
        ways = [(at, cost + DELETE, letters + "D")]
        if not must_go:
            if (kept := AFTER.get((at, initial))) is not None:
                ways.append((kept, cost + CUT * cut, letters + "K"))
            ways.append((NEXT[at], cost + REROLE + CUT * cut, letters + "R"))
        for to, c, s in ways:
            if to not in best or (c, s) < best[to]:
                best[to] = (c, s)
    return [(to, c, s) for to, (c, s) in best.items()]


STEPS = {(x, i, m, c): _steps(x, i, m, c) for x in range(4) for i in ("s", "u", "a", "") for m in (False, True) for c in (False, True)}


class Survivors:
    """The survivors of one conversation. A node is one turn's letters; node `root` is what has been given out."""

    def __init__(self):
        self.parent, self.label, self.refs, self.children, self.free = [-1], [""], [1], [0], []
        self.root = 0
        #: (state, cost, node), in the order of the survivors' letters.
        self.alive = [(START, 0, 0)]

    def turn(self, initial: str, must_go: bool, cut: bool) -> Iterator[str]:
        """Takes the next turn; gives the letters of the turns that are decided now."""
        best: dict[int, tuple[int, int, str, int]] = {}
        for rank, (state, cost, node) in enumerate(self.alive):
            for to, more, letters in STEPS[state, initial, must_go, cut]:
                way = (cost + more, rank, letters, node)
                if to not in best or way < best[to]:
                    best[to] = way
        ways = [(rank, letters, to, cost, node) for to, (cost, rank, letters, node) in best.items() if not any(cost > best[y][0] + d for y, d in DEARER[to].items() if y in best)]
        ways.sort()
        before, self.alive = self.alive, [(to, cost, self._add(node, letters)) for _, letters, to, cost, node in ways]
        for _, _, node in before:
            self._drop(node)
        return self._decided()

    def end(self) -> tuple[int, list[str]]:
        """Cost of the whole conversation and the letters that were undecided; the last ones follow the last turn."""
        cost, _, last, node = min((cost + INSERT * len(ENDS[state]), rank, ENDS[state], node) for rank, (state, cost, node) in enumerate(self.alive))
        out = [last]
        while node != self.root:
            out.append(self.label[node])
            node = self.parent[node]
        return cost, out[::-1]

    def _add(self, parent: int, label: str) -> int:
        if self.free:
            n = self.free.pop()
            self.parent[n], self.label[n], self.refs[n], self.children[n] = parent, label, 1, 0
        else:
            n = len(self.parent)
            self.parent.append(parent)
            self.label.append(label)
            self.refs.append(1)
            self.children.append(0)
        self.refs[parent] += 1
        self.children[parent] += n  # their sum: the number itself where there is one child
        return n

    def _drop(self, n: int) -> None:
        self.refs[n] -= 1
        while not self.refs[n]:
            self.free.append(n)
            up = self.parent[n]
            self.children[up] -= n
            self.refs[up] -= 1
            n = up

    def _decided(self) -> Iterator[str]:
        leaves = {node for _, _, node in self.alive}
        while self.refs[self.root] == 1 and self.root not in leaves:
            n = self.children[self.root]
            self.free.append(self.root)
            self.root, self.parent[n] = n, -1
            yield self.label[n]


_SIGN = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\v\f\r"


class Conversation:
    """One conversation's turns as they come: counts of faults, and the edits as they are decided."""

    def __init__(self):
        self.survivors, self.waiting, self.state = Survivors(), deque(), START
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.n = 0
        self.low = self.high = self.before = None

    def turn(self, turn: int | None, role: str, text: str, first: bool) -> Iterator[tuple[str, int | None, str, str]]:
        """first: role and text stood in no earlier turn. Gives (edit, turn, role, text) of what is decided."""
        if turn is not None:
            if turn != self.high:
                self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.n and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        blank = _SIGN.search(text) is None
        duplicate = not blank and (not first or self.before == (turn, role, text))
        cut = not blank and not duplicate and text.rstrip(_SPACE)[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        self.n, self.before = self.n + 1, (turn, role, text)
        must_go = blank or duplicate
        self.waiting.append((turn, None, None) if must_go else (turn, role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        for letters in self.survivors.turn(initial, must_go, cut):
            yield from self._given(letters)

    def end(self) -> tuple[int, Iterator[tuple[str, int | None, str, str]]]:
        cost, rest = self.survivors.end()
        return cost, (x for letters in rest for x in self._given(letters))

    def _given(self, letters: str) -> Iterator[tuple[str, int | None, str, str]]:
        for edit in letters:
            turn, role, text = (None, "", "") if edit == "I" else self.waiting.popleft()
            if edit == "K":
                self.state = AFTER[self.state, role[:1]]
            elif edit != "D":
                self.state = NEXT[self.state]
                role = ROLE[self.state]
            yield edit, turn, role, text

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)


def _ordered(df: DataFrame, live: Column | None) -> DataFrame:
    """conv_id, turn, role, text, live, first: each conversation in one partition and in order."""
    live = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
    or_space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), live.alias("live"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    known = rows.where("live").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.max(F.col("turn").isNull()).alias("at_null"), F.min("turn").alias("at"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    first = F.when(F.col("at_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("at"))
    rows = rows.join(known, same, "left").select("conv_id", "turn", "role", "text", "live", F.coalesce(first, F.lit(False)).alias("first"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its live turns); a conversation's turns must be taken before the next is."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6))))
    r = next(rows, None)
    while r is not None:
        conv = r[0]

        def turns():
            nonlocal r
            while r is not None and r[0] == conv:
                if r[4]:
                    yield r[1], r[2], r[3], r[5]
                r = next(rows, None)

        yield conv, turns()


#: Rows that a task gives out at once.
_ROWS = 2_000


def _tables(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    buffer, size = [], 0
    for r in rows:
        buffer.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(buffer) >= _ROWS or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), schema.types)], schema=schema)
            buffer, size = [], 0
    if buffer:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*buffer), schema.types)], schema=schema)


def repaired(df: DataFrame, live: Column | None = None) -> DataFrame:
    """conv_id, step (from 1), edit (K, R, D, I), turn (null if inserted), role, text (both null if deleted).

    Rows where `live` isn't true are no turns."""
    rows = _ordered(df, live)

    def run(batches):
        def steps():
            for conv, turns in _conversations(batches):
                c, n = Conversation(), 0
                for t in turns:
                    for edit, turn, role, text in c.turn(*t):
                        yield conv, (n := n + 1), edit, turn, *((None, None) if edit == "D" else (role, text))
                for edit, turn, role, text in c.end()[1]:
                    yield conv, (n := n + 1), edit, turn, *((None, None) if edit == "D" else (role, text))

        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        batches = _again(first, batches)
        yield from _tables(steps(), pa.schema([("conv_id", kind), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, step long, edit string, turn long, role string, text string")


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def audited(df: DataFrame, live: Column | None = None) -> DataFrame:
    """A row for each conv_id, live turns or not: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = _ordered(df, live)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches):
        def audits():
            for conv, turns in _conversations(batches):
                c, audit, digest, lines = Conversation(), [], hashlib.sha256(), 0

                def take(edits):
                    nonlocal lines
                    for edit, _, role, text in edits:
                        audit.append(edit)
                        if edit != "D":
                            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                            lines += 1

                for t in turns:
                    take(c.turn(*t))
                cost, rest = c.end()
                take(rest)
                yield conv, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(audit), digest.hexdigest()

        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        batches = _again(first, batches)
        yield from _tables(audits(), pa.schema([("conv_id", kind), *((n, pa.int64()) for n in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in counts)}, audit string, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: the damage of the contract. A dropped turn stays, not live."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(kind == 4, "user").otherwise(or_space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("live"), copies.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(load(spark, sf_dir, "conversations"))
    return audited(rows, F.col("live"))
