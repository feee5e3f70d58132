"""Repair of conversations by cheapest edits, found by A* on the edit lattice.

The rows of a conversation stand by turn (nulls first), then role, then text. A row is
blank, a duplicate of an earlier row's role and text, or truncated (its last character
that is no white space ends no sentence). Edits make the roles' initials match
``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1), Delete (2, the only edit of blank
rows and duplicates), Insert an empty text of user or assistant (5); a truncated row that
stays costs 5 more.

Lattice: a node is (rows read, state), the states being nothing written, after ``s``, after
``u``, after ``a``. A* takes nodes by (cost plus heuristic, audit): the heuristic is the
suffix sum of what rows ahead cost at least (a required deletion 2, a truncated row 2, as
to delete it is its cheapest edit). It never falls by more than an edit costs, so a node is
final when it is first taken, by the cheapest edits and of these by the least audit: of
two audits of equal cost into one node neither begins with the other, so what follows does
not change their order.

Rows are dealt by conversation and sorted, and each task streams them: a conversation is
cut into segments of bounded rows and bytes, A* gives for each pair of states the best way
through a segment, and only the best way into each state is carried on, with its running
digest. So memory is bounded, but for the audit itself, however long a conversation. Its
digest is a chain over its texts: one conversation is one task's work. Duplicates of other
turns are marked before by counts of digests, and no task keeps what it has seen.

Defined results: a null role or text is one space; a null conversation id is one
conversation; a null turn comes first; rows of one turn stand by role, then text, rows that
are equal follow each other and are duplicates. Roles other than those three must be
changed or deleted. A conversation without rows has zeros, an empty audit and the digest
of nothing; an empty table gives an empty table. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, claim, sized_broadcast, trim, written

#: Rows and bytes of text of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 256, 4 << 20
#: Rows broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 19
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial is written.
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
OK, TORN, MUST = range(3)


def _written_next(state: int) -> int:
    """The state after a rerole or an insert, which have no choice of role."""
    return ASSISTANT if state == USER else USER


def ways(initials: Sequence[str], faults: Sequence[int], start: int, goals: frozenset[int]) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) from ``start`` through all rows into each of ``goals``."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] != OK else 0)
    found: dict[int, tuple[int, str]] = {}
    closed = set()
    heap = [(ahead[0], "", 0, start)]
    while heap:
        f, audit, k, state = heapq.heappop(heap)
        if (k, state) in closed:
            continue
        closed.add((k, state))
        cost = f - ahead[k]
        if k == n:
            if state in goals:
                found[state] = (cost, audit)
                if len(found) == len(goals):
                    break
        else:
            rest = ahead[k + 1]
            heapq.heappush(heap, (cost + DELETE + rest, audit + "D", k + 1, state))
            if faults[k] != MUST:
                more = cost + rest + (TRUNCATED if faults[k] == TORN else 0)
                kept = NEXT.get((state, initials[k]))
                if kept is not None:
                    heapq.heappush(heap, (more + KEEP, audit + "K", k + 1, kept))
                heapq.heappush(heap, (more + REROLE, audit + "R", k + 1, _written_next(state)))
        heapq.heappush(heap, (f + INSERT, audit + "I", k, _written_next(state)))
    return found


class _Conversation:
    """What is known of a conversation while its rows stream past."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.bytes = 0
        self.best: dict[int, tuple[int, str, object]] = {NOTHING: (0, "", hashlib.sha256())}
        self.counts = [0, 0, 0]  # blank, duplicate, truncated
        self.illegal, self.turns, self.first, self.last = 0, 0, None, None
        self.before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        row = (turn, role, text)
        body = text.rstrip(SPACES)
        if not body:
            kind = 0
        elif seen or row == self.before:
            kind = 1
        else:
            kind = None if body[-1] in ".!?" else 2
        if kind is not None:
            self.counts[kind] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and (self.before is None or turn != self.before[0]):
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.before = row
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(OK if kind is None else TORN if kind == 2 else MUST)
        self.bytes += len(text)
        if len(self.roles) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES:
            self.advance(frozenset(range(4)))

    def advance(self, goals: frozenset[int]) -> None:
        """The best ways into each state after the rows that are held."""
        initials = [r[:1] for r in self.roles]
        best: dict[int, tuple] = {}
        for state, (cost, audit, digest) in self.best.items():
            for goal, (more, letters) in ways(initials, self.faults, state, goals).items():
                way = (cost + more, audit + letters, letters, state, digest)
                if goal not in best or way[:2] < best[goal][:2]:
                    best[goal] = way
        self.best = {goal: (cost, audit, self.digested(digest.copy(), letters, state)) for goal, (cost, audit, letters, state, digest) in best.items()}
        self.roles, self.texts, self.faults, self.bytes = [], [], [], 0

    def digested(self, digest, letters: str, state: int):
        k = 0
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                role, text = self.roles[k], self.texts[k]
                k += 1
            if letter == "D":
                continue
            after = NEXT[state, role[:1]] if letter == "K" else _written_next(state)
            digest.update(f"{'' if state == NOTHING else chr(10)}{role if letter == 'K' else ROLES[after]}:{text}".encode("utf-8", "surrogatepass"))
            state = after
        return digest

    def result(self) -> tuple:
        self.advance(frozenset((NOTHING, ASSISTANT)))
        cost, audit, digest = min(self.best.values(), key=lambda way: way[:2])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.counts, self.illegal, cost, audit, digest.hexdigest())


def _rows(df: DataFrame, present: Column | None) -> DataFrame:
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *cells, there.alias("present"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seen``: whether role and text stand in an earlier turn. What repeats
    is counted by digest, first where it lies, so a text that repeats a million times is a
    row of each task."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("digest", F.md5("text"))
    firsts = keyed.where("present").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    firsts = written(firsts.where("first <> last").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"), "repeated")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    joined = keyed.join(sized_broadcast(firsts, BROADCAST_ROWS), same, "left")
    return joined.select("conv_id", "turn", "role", "text", "present", F.coalesce(order > F.col("first"), F.lit(False)).alias("seen"))


def repair(df: DataFrame, present: Column | None = None) -> DataFrame:
    """One row (``RESULT``) for each conversation of ``df(conv_id, turn, role, text)``. Rows
    for which ``present`` is not true only name their conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("conversations", lambda: None)
        fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]

        def told(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=fields)

        now: _Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, there, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if there:
                    now.add(turn, role, text, seen)
            if done:
                yield told(done)
        if now is not None:
            yield told([now.result()])
        trim()

    rows = _marked(_rows(df, present))
    return arrow_map(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), run, RESULT)


def repaired_turns(df: DataFrame, found: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired rows ``(conv_id, position, role, text)``: what the audits of ``found`` make
    of the rows that ``repair`` read. Positions count from 1."""
    conversation = Window.partitionBy("conv_id")
    rows = _rows(df, present).where("present").withColumn("k", F.row_number().over(conversation.orderBy("turn", "role", "text")))
    letters = found.select(F.col("conv_id").alias("c"), F.length(F.translate("audit", "D", "")).alias("all"), "audit", F.posexplode(F.split("audit", "")).alias("at", "letter")).where("letter <> '' and letter <> 'D'")
    upto = F.substring(F.col("audit"), F.lit(1), F.col("at") + 1)
    edits = letters.select("c", "all", "letter", F.length(F.translate(upto, "I", "")).alias("row"), F.length(F.translate(upto, "D", "")).alias("position"))
    # an odd number of rows begins with the system's
    role = F.when((F.col("position") - F.col("all") % 2) % 2 == 1, "user").otherwise("assistant")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("row")) & (F.col("letter") != "I")
    joined = edits.join(rows, same, "left")
    return joined.select(F.col("c").alias("conv_id"), "position", F.when(F.col("letter") == "K", F.col("role")).otherwise(role).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(df: DataFrame) -> DataFrame:
    """``df`` with faults dealt by the check sum of ``conv_id:turn``, and ``present``: false for
    rows that are dropped."""
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(cells["conv_id"], F.lit(":"), cells["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(cells["text"], ".!?", "")).otherwise(cells["text"])
    role = F.when(kind == 4, "user").otherwise(cells["role"])
    copies = F.explode(F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("present"))
