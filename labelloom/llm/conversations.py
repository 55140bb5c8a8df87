"""Cheapest repair of conversations by Viterbi, emitted where survivors coalesce.

A repaired conversation is empty, or an optional system turn followed by pairs of
a user's and an assistant's turn. What has been kept so far puts it into one of
four states: empty, after a system turn, after a user's, after an assistant's. For
each state the cheapest edits that lead there survive, of equal costs those whose
initials are first in ASCII order.

Survivors share most of their edits, so they are leaves of a tree whose edges hold
initials. A node counts its children: a survivor that none goes on from is taken
away, and with it every node that no other survivor needs; a node left with one
child is joined with it. Edits that all survivors share are emitted at once and
forgotten. What stays in memory is a byte for each edit that is still open, beside
at most seven nodes and a running hash for each survivor, whatever the length of the
conversation. Survivors with equal costs are compared by all their open initials,
from where they part on: two of them that have used the same rows are never the
beginning of each other, as insertions come before the row they belong to.

A state is given up as soon as another one can take over whatever it may still do
for less; without that, the empty state would keep everything open.

Rows come to a task in order, a conversation after the other, so a conversation of
any length streams through. It cannot be divided, as its hash is one chain.

Defined results: NULL roles and texts are one space. Rows are taken by turn (NULLs
first), then role and text, so repeated and tied rows are next to each other. A
NULL id is a conversation like others. A role counts by its initial, case minding;
any other one must be changed or deleted. Conversations without rows have zeros,
no edits and the hash of no bytes; an empty table gives no rows. Only the four
columns named are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import id_fold

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


class Step(NamedTuple):
    """One way to treat a row: from which state to which, with what edits and lines."""

    start: int
    end: int
    edits: bytes
    cost: int
    inserted: tuple[str, ...]
    role: str | None  # of the row's line; "" keeps its own, None leaves the row out


def _towards(end: int, edit: bytes, cost: int, role: str) -> list[Step]:
    """Ways to make a row the next user's or assistant's turn, with an insertion where one must come before."""
    other = ASSISTANT if end == USER else USER
    steps = []
    for start in range(4):
        fits = start == USER if end == ASSISTANT else start != USER
        inserted = () if fits else (_NAMES[other],)
        steps.append(Step(start, end, b"I" * len(inserted) + edit, cost + INSERT_COST * len(inserted), inserted, role))
    return steps


# An insertion before a deleted row could as well come after it, which is first in order.
_DELETE = [Step(state, state, b"D", DELETE_COST, (), None) for state in range(4)]


def _steps(initial: str) -> list[Step]:
    own = _INITIALS.get(initial)
    keep = [Step(EMPTY, SYSTEM, b"K", 0, (), "")] if own == SYSTEM else []
    for end in (USER, ASSISTANT):
        if own == end:
            keep += _towards(end, b"K", 0, "")
        else:
            keep += _towards(end, b"R", REROLE_COST, _NAMES[end])
    return keep + _DELETE


STEPS = {initial: _steps(initial) for initial in ("s", "u", "a", "")}
#: Insertions that end a conversation, by state.
ENDINGS = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: What state ``other`` needs at most beyond what ``state`` needs to end alike: a turn
#: inserted, a system turn deleted that the empty state may still keep, or both.
_TAKES_OVER = {
    (EMPTY, SYSTEM): 2 * INSERT_COST,
    (EMPTY, USER): INSERT_COST + DELETE_COST,
    (EMPTY, ASSISTANT): DELETE_COST,
    (SYSTEM, USER): INSERT_COST,
    (SYSTEM, ASSISTANT): 0,
    (USER, ASSISTANT): INSERT_COST,
    (ASSISTANT, USER): INSERT_COST,
}


class Node:
    """A node of the tree; ``edits`` lead to it from its parent."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: Node | None, edits: bytes) -> None:
        self.parent = parent
        self.edits = bytearray(edits)
        self.children: list[Node] = []  # as many as there are references to it
        if parent is not None:
            parent.children.append(self)


class Survivor(NamedTuple):
    cost: int
    leaf: Node
    digest: Any


class Viterbi:
    """The repair of one conversation, row by row."""

    def __init__(self) -> None:
        self.root = Node(None, b"")
        self.alive: dict[int, Survivor] = {EMPTY: Survivor(0, self.root, hashlib.sha256())}

    @staticmethod
    def _before(one: Node, other: Node) -> bool:
        """Whether the open edits up to ``one`` are first in order, from where they part on."""
        if one is other:
            return False
        above = {}
        while one is not None:
            above[one.parent] = one
            one = one.parent
        while other.parent not in above:
            other = other.parent
        return above[other.parent].edits < other.edits

    def _better(self, one: tuple[int, Step], other: tuple[int, Step]) -> bool:
        if one[0] != other[0]:
            return one[0] < other[0]
        mine, its = self.alive[one[1].start].leaf, self.alive[other[1].start].leaf
        return one[1].edits < other[1].edits if mine is its else self._before(mine, its)

    def _drop(self, leaf: Node) -> None:
        """Take a leaf away, and join its parent with an only child that is left."""
        parent = leaf.parent
        if parent is None:
            return
        parent.children.remove(leaf)
        if parent is not self.root and len(parent.children) == 1:
            (child,) = parent.children
            parent.edits += child.edits
            child.edits, child.parent = parent.edits, parent.parent
            above = parent.parent.children
            above[above.index(parent)] = child

    def _emit(self) -> bytes:
        """What all survivors share."""
        if len(self.root.children) != 1:
            return b""
        (child,) = self.root.children
        shared, child.edits, child.parent = bytes(child.edits), bytearray(), None
        self.root = child
        return shared + self._emit()

    def add(self, initial: str, text: str, role: str, must_go: bool, truncated: bool) -> bytes:
        """Take in a row; the edits that are certain now."""
        best: dict[int, tuple[int, Step]] = {}
        for step in _DELETE if must_go else STEPS.get(initial) or STEPS[""]:
            if (survivor := self.alive.get(step.start)) is None:
                continue
            extra = TRUNCATED_COST if truncated and step.role is not None else 0
            found = survivor.cost + step.cost + extra, step
            if step.end not in best or self._better(found, best[step.end]):
                best[step.end] = found
        kept = {state: found for state, found in best.items() if not self._given_up(state, found, best)}
        goes_on: dict[int, list[int]] = {state: [] for state in self.alive}
        for state, (_, step) in kept.items():
            goes_on[step.start].append(state)
        alive = {}
        for start, ends in goes_on.items():
            _, leaf, digest = self.alive[start]
            alone = len(ends) == 1
            for end in ends:
                cost, step = kept[end]
                own = digest if alone else digest.copy()
                self._write(own, step, role, text)
                if alone:
                    leaf.edits += step.edits
                alive[end] = Survivor(cost, leaf if alone else Node(leaf, step.edits), own)
        for start, ends in goes_on.items():
            if not ends:
                self._drop(self.alive[start].leaf)
        self.alive = alive
        return self._certain()

    def _certain(self) -> bytes:
        shared = self._emit()
        if not self.root.children and self.root.edits:  # a single survivor
            shared, self.root.edits = shared + bytes(self.root.edits), bytearray()
        return shared

    def _given_up(self, state: int, found: tuple[int, Step], best: dict[int, tuple[int, Step]]) -> bool:
        for other, taken in best.items():
            extra = _TAKES_OVER.get((state, other))
            if extra is None:
                continue
            if found[0] > taken[0] + extra:
                return True
            # After an assistant's turn may come all that may come after a system turn.
            if extra == 0 and found[0] == taken[0] and self._better(taken, found):
                return True
        return False

    @staticmethod
    def _write(digest: Any, step: Step, role: str, text: str) -> None:
        lines = [f"{name}:" for name in step.inserted]
        if step.role is not None:
            lines.append(f"{step.role or role}:{text}")
        if lines:
            joined = "\n".join(lines)
            digest.update((joined if step.start == EMPTY else "\n" + joined).encode("utf-8", "surrogatepass"))

    def end(self) -> tuple[bytes, int, str]:
        """The edits that were still open, the cost, and the hash of the repaired lines."""
        best: tuple[int, Step] | None = None
        for state, inserts in ENDINGS.items():
            if (survivor := self.alive.get(state)) is None:
                continue
            names = ("user", "assistant")[2 - inserts :]
            found = survivor.cost + INSERT_COST * inserts, Step(state, state, b"I" * inserts, 0, names, None)
            if best is None or self._better(found, best):
                best = found
        cost, step = best
        _, leaf, digest = self.alive[step.start]
        self._write(digest, step, "", "")
        parts = [step.edits]
        while leaf is not None:
            parts.append(bytes(leaf.edits))
            leaf = leaf.parent
        return b"".join(reversed(parts)), cost, digest.hexdigest()


class _Audit:
    """Figures of one conversation whose rows come in order."""

    def __init__(self, key: Any) -> None:
        self.key = key
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least: int | None = None
        self.last_turn: int | None = None
        self.turns = 0
        self.before: str | None = None
        self.edits = bytearray()
        self.repair = Viterbi()

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool, truncated: bool) -> bytes:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.last_turn = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        must_go = blank or repeated
        certain = self.repair.add(initial, text, role, must_go, truncated and not must_go)
        self.edits += certain
        return certain

    def row(self) -> tuple:
        edits, cost, digest = self.repair.end()
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        figures = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (self.key, *figures, (self.edits + edits).decode(), digest)


_FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _marked(df: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Rows with their faults, a conversation's rows in one task and in order."""
    rows = df.select(
        F.col(conv).alias("_conv"),
        F.col(turn).cast("bigint").alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
        (F.lit(True) if present is None else F.col(present)).alias("_present"),
    ).repartition("_conv")
    solid = F.rtrim(F.col("_text"), F.lit(SPACE))
    # The first of equal rows, by turn; the digest stands for the text in the sort.
    same = F.row_number().over(_equal_rows())
    return (
        rows.withColumn("_digest", F.sha2("_text", 256))
        .withColumns(
            {
                "_repeated": same > 1,
                "_blank": solid == "",
                "_truncated": ~F.substring(solid, -1, 1).isin(*ENDS),
            }
        )
        .drop("_digest")
        .sortWithinPartitions("_conv", F.desc("_present"), F.asc_nulls_first("_turn"), "_role", "_text")
    )


def _equal_rows():
    from pyspark.sql import Window

    return Window.partitionBy("_conv", "_present", "_role", "_digest").orderBy(F.asc_nulls_first("_turn"))


_COLUMNS = ["_conv", "_present", "_turn", "_role", "_text", "_blank", "_repeated", "_truncated"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Audit, bool, tuple | None]]:
    """Each row with the audit of its conversation, and once more, without a row, at its end."""
    audit: _Audit | None = None
    for batch in batches:
        for start in range(0, len(batch), 512):
            some = batch.slice(start, 512)
            for key, present, *row in zip(*(some.column(i).to_pylist() for i in range(len(_COLUMNS)))):
                if audit is None or key != audit.key:
                    if audit is not None:
                        yield audit, True, None
                    audit = _Audit(key)
                if present:
                    yield audit, False, tuple(row)
    if audit is not None:
        yield audit, True, None


def _audits(kind: pa.DataType):
    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        held = 0
        for audit, is_end, row in _read(batches):
            if not is_end:
                audit.add(*row)
                continue
            done.append(audit.row())
            held += len(done[-1][-2])
            if len(done) >= 1024 or held > 1 << 20:
                yield _audit_batch(done, kind)
                done, held = [], 0
        if done:
            yield _audit_batch(done, kind)

    return audits


def _audit_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * len(_FIGURES), pa.string(), pa.string()]
    arrays = [pa.array(column, one) for column, one in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["_conv", *_FIGURES, "audit", "repaired_sha256"])


def audit_conversations(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """One row for each conversation: its faults, and cost, initials and hash of its cheapest repair.

    Rows where BOOLEAN ``present`` is false only name their conversation.
    """
    rows = _marked(df, conv, turn, role, text, present).select(*_COLUMNS)
    figures = ", ".join(f"{name} bigint" for name in _FIGURES)
    kind = rows.schema["_conv"].dataType.simpleString()
    schema = f"_conv {kind}, {figures}, audit string, repaired_sha256 string"
    from pyspark.sql.pandas.types import to_arrow_type

    audits = rows.mapInArrow(_audits(to_arrow_type(rows.schema["_conv"].dataType)), schema)
    return audits.withColumnRenamed("_conv", conv)


def _repaired(kind: pa.DataType):
    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        waiting: deque[tuple] = deque()
        place, last = 0, ""

        def settle(key: Any, edits: bytes) -> None:
            nonlocal place, last
            for edit in edits.decode():
                turn, role, text = (None, "", "") if edit == "I" else waiting.popleft()
                if edit == "D":
                    continue
                if edit in "IR":
                    role = "assistant" if last == "u" else "user"
                done.append((key, place, edit, turn, role, text))
                place, last = place + 1, role[:1]

        for audit, is_end, row in _read(batches):
            if not is_end:
                waiting.append(row[:3])
                settle(audit.key, audit.add(*row))
            else:
                settle(audit.key, audit.repair.end()[0])
                place, last = 0, ""
            if len(done) >= 1024:
                yield _repaired_batch(done, kind)
                done = []
        if done:
            yield _repaired_batch(done, kind)

    return repaired


def _repaired_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    arrays = [pa.array(column, one) for column, one in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["_conv", "place", "edit", "turn", "role", "text"])


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The turns of the repaired conversations: ``conv``, place (from 0), edit, turn, role, text.

    ``edit`` is K (kept), R (role changed) or I (inserted; without a turn). Texts
    wait until their edit is certain.
    """
    rows = _marked(df, conv, turn, role, text, None).select(*_COLUMNS)
    from pyspark.sql.pandas.types import to_arrow_type

    data_type = rows.schema["_conv"].dataType
    schema = f"_conv {data_type.simpleString()}, place bigint, edit string, turn bigint, role string, text string"
    return rows.mapInArrow(_repaired(to_arrow_type(data_type)), schema).withColumnRenamed("_conv", conv)


def damage_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kinds: int = 20
) -> DataFrame:
    """``df``'s four columns with planted faults, and BOOLEAN ``present``, false for a dropped row.

    A row's fault is crc32(``conv:turn``) modulo ``kinds``: 0 drops it, 1 empties its
    text, 2 removes the ends of sentences, 3 repeats it, 4 makes it a user's.
    """
    own = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in (conv, turn, role, text)]
    fault = id_fold(F.concat(own[0], F.lit(":"), own[1]), kinds)
    rows = df.select(
        conv,
        turn,
        F.when(fault == 4, F.lit("user")).otherwise(own[2]).alias(role),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(own[3], "[.!?]", "")).otherwise(own[3]).alias(text),
        (fault != 0).alias("present"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_copies"),
    )
    return rows.select("*", F.explode("_copies").alias("_copy")).drop("_copies", "_copy")
