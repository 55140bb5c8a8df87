"""Repair of conversations against all edits there are."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, _conv int"
LEGAL = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(SPACES)
        blank = not solid
        repeated = not blank and (role, text) in seen
        out.append((blank, repeated, not blank and not repeated and solid[-1] not in ".!?"))
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, initials and lines of the cheapest edits, out of all with at most two insertions a gap."""
    marks = faults(rows)
    partial = {("", "", ()): 0}  # initials of roles, of edits, lines: the cost
    best = None
    for at in range(len(rows) + 1):
        for _ in range(2):
            for (kept, edits, lines), cost in list(partial.items()):
                for role in ("user", "assistant"):
                    key = kept + role[0], edits + "I", (*lines, f"{role}:")
                    partial[key] = min(partial.get(key, 1 << 30), cost + 2)
        if at == len(rows):
            break
        role, text = rows[at]
        blank, repeated, truncated = marks[at]
        after = {}
        for (kept, edits, lines), cost in partial.items():
            ways = [("D", None, 3)]
            if not blank and not repeated:
                ways.append(("K", role, truncated))
                ways += [("R", other, 2 + truncated) for other in ("user", "assistant")]
            for edit, own, price in ways:
                initial = "" if own is None else own[:1] or "?"
                more = () if own is None else (f"{own}:{text}",)
                if re.fullmatch(r"s?(ua)*u?", kept + initial):
                    key = kept + initial, edits + edit, (*lines, *more)
                    after[key] = min(after.get(key, 1 << 30), cost + price)
        partial = {key: cost for key, cost in after.items() if re.fullmatch(r"s?(ua)*u?", key[0])}
    for (kept, edits, lines), cost in partial.items():
        if LEGAL.fullmatch(kept):
            found = cost, edits, lines
            best = found if best is None or found[:2] < best[:2] else best
    return best


def streamed(rows):
    audit = cv._Audit(0)
    for turn, ((role, text), (blank, repeated, truncated)) in enumerate(zip(rows, faults(rows))):
        audit.add(turn, role, text, blank, repeated, truncated)
    return audit.row()


ROW = st.tuples(
    st.sampled_from(["user", "assistant", "system", "tool", "", "user", "assistant"]),
    st.sampled_from(["One.", "Two!", "cut", " \n", "", "Three?  "]),
)


@settings(max_examples=120, deadline=None)
@given(st.lists(ROW, max_size=5))
def test_against_all_edits(rows):
    cost, edits, lines = brute(rows)
    got = streamed(rows)
    assert got[6:8] == (cost, edits)
    assert got[8] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def whole(rows):
    """The same by keeping every state's whole initials and lines; for longer conversations."""
    alive = {"": (0, "", ())}
    for (role, text), (blank, repeated, truncated) in zip(rows, faults(rows)):
        after = {}
        for last, (cost, edits, lines) in alive.items():
            ways = [("D", None, 3)]
            if not blank and not repeated:
                ways += [("K", role, truncated), ("R", "user", 2 + truncated), ("R", "assistant", 2 + truncated)]
            for edit, own, price in ways:
                state, more, put = last, (), ""
                if own is not None:
                    state = own[:1]
                    if state not in ("s", "u", "a") or (state == "s" and last):
                        continue
                    other = {"u": "assistant", "a": "user"}.get(state)
                    if (state == "u" and last == "u") or (state == "a" and last != "u"):
                        put, price, more = "I", price + 2, (f"{other}:",)
                    more += (f"{own}:{text}",)
                found = cost + price, edits + put + edit, lines + more
                if state not in after or found[:2] < after[state][:2]:
                    after[state] = found
        alive = after
    ends = {"s": (4, "II", ("user:", "assistant:")), "u": (2, "I", ("assistant:",))}
    found = []
    for last, (cost, edits, lines) in alive.items():
        price, put, more = ends.get(last, (0, "", ()))
        found.append((cost + price, edits + put, lines + more))
    return min(found, key=lambda one: one[:2])


@pytest.mark.parametrize("seed", range(12))
def test_long_conversations(seed):
    draw = random.Random(seed)
    roles = [["user"], ["tool"], ["system"], ["user", "assistant"], ["user", "assistant", "system", "x"]][seed % 5]
    rows = [(draw.choice(roles), f"{draw.randint(0, 600)}{draw.choice('.. ,')}") for _ in range(draw.randint(50, 400))]
    cost, edits, lines = whole(rows)
    got = streamed(rows)
    assert got[6:8] == (cost, edits)
    assert got[8] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def nodes(viterbi):
    found, left = 0, [viterbi.root]
    while left:
        node = left.pop()
        found += 1
        left += node.children
        assert all(child.parent is node for child in node.children)
    return found


def test_memory_stays_bounded():
    draw = random.Random(5)
    repair, open_edits, emitted = cv.Viterbi(), 0, 0
    for i in range(20_000):
        role = ("user", "assistant")[i % 2] if draw.random() < 0.9 else draw.choice(["user", "tool", "system"])
        emitted += len(repair.add(role[:1], "text.", role, draw.random() < 0.05, draw.random() < 0.1))
        assert nodes(repair) <= 7
        left = [repair.root]
        size = 0
        while left:
            size += len(left[-1].edits)
            left += left.pop().children
        open_edits = max(open_edits, size)
    assert open_edits < 2_000 and emitted > 18_000


def test_ties_that_never_end_keep_a_byte_an_edit():
    """Turns of users alone: which parity wins is open up to the end, and the first edits decide."""
    rows = [("user", f"{i}.") for i in range(4001)]
    repair = cv.Viterbi()
    certain = b""
    for role, text in rows:
        certain += repair.add("u", text, role, False, False)
        assert nodes(repair) <= 7
    edits, cost, digest = repair.end()
    assert len(certain) == 1 and len(edits) == 4001
    want = whole(rows[:401])
    assert streamed(rows[:401])[6:8] == want[:2]
    assert cost == 4002 and len(digest) == 64


def test_audit_of_a_table(spark):
    draw = random.Random(2)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(draw.randint(0, 9)):
            role = draw.choice(["user", "assistant", "system", None, "Tool"])
            turn = None if draw.random() < 0.1 else turn * draw.randint(1, 2)
            rows.append((conv, turn, role, draw.choice(["A.", "b", None, "", " ", "C!", "é?"]), "x", 1))
    rows += [(77, turn, ("user", "assistant")[turn % 2], f"t{turn}.", "x", 1) for turn in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: r for r in cv.audit_conversations(cv.damage_conversations(df), present="present").collect()}
    kept = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kept[conv] += damaged(conv, turn, role or " " if role is None else role, " " if text is None else text)
    assert set(got) == set(kept)
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        plain = [r[1:] for r in own]
        marks = faults(plain)
        turns = [r[0] for r in own if r[0] is not None]
        cost, edits, lines = whole(plain)
        row = got[conv]
        assert row.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (row.blank, row.duplicate, row.truncated) == tuple(sum(m[i] for m in marks) for i in range(3))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(plain, plain[1:])]
        assert row.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        assert (row.cost, row.audit) == (cost, edits)
        assert row.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conv, turn, role, text):
    key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
    fault = zlib.crc32(key.encode()) % 20
    if fault == 0:
        return []
    text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
    return [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def test_repaired_turns_make_the_hash(spark):
    rows = [(c, t, ("user", "assistant", "system")[(c * t * 7) % 3], f"{c * t % 5}.", "x", 1) for c in range(40) for t in range(c % 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.conv_id: r.repaired_sha256 for r in cv.audit_conversations(df).collect()}
    lines = defaultdict(dict)
    for r in cv.repair_conversations(df).collect():
        lines[r.conv_id][r.place] = f"{r.role}:{r.text}"
        assert (r.turn is None) == (r.edit == "I")
    for conv, digest in hashes.items():
        own = [lines[conv][i] for i in range(len(lines[conv]))]
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == digest


def test_a_conversation_of_dropped_rows(spark):
    rows = [(c, t, "user", "a.", "x", 1) for c in range(60) for t in range(1)]
    got = cv.audit_conversations(cv.damage_conversations(spark.createDataFrame(rows, SCHEMA)), present="present").collect()
    gone = [r for r in got if zlib.crc32(f"{r.conv_id}:0".encode()) % 20 == 0]
    assert len(got) == 60 and gone
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in gone} == {(0, 0, 0, 0, 0, 0, "", empty)}
    assert cv.audit_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
