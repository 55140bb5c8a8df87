"""Near duplicates by SimHash, compared around the anchors of a covering code.

A fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 if
more than half of the hashes have it. Texts are linked if their fingerprints
differ in at most ``max_distance`` bits.

To find the links, the 64 bits are halved; linked fingerprints differ in at most
half the distance in one of the halves. In a half (32 bits) the anchors are the
words of a covering code: a Hamming code over 31 bits, whose words lie within one
bit of every 31 bits, and the last bit as it is. Take two halves at most d bits
apart and a point half-way between them: the anchor next to that point is within
the covering radius plus ceil(d / 2) of both. So every fingerprint goes to each
anchor within that reach, and linked ones meet at one anchor at least. 2^27
anchors a half keep the number that meet small.

At an anchor, all fingerprints are compared with each other in blocks, and a
spanning forest of the links is passed on: it has the same components and never
more links than members. Anchors with very many members are split into pairs of
blocks. The components of all links are then joined by star operations.

Defined results: a NULL text, an empty one and one of white space alone have no
words and the fingerprint 0, which is linked like any other; a text with fewer
words than a shingle is one shingle. Equal texts have equal fingerprints.
Repeated rows are in one component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import UID, Landed
from labelloom.shared import measured, stored, with_group_values

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
HASH_SEED = 42

#: Fingerprints at one anchor that one task compares; more are split.
ANCHOR_MEMBERS = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_HELD = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text as a whole number from 0 to 2**64 - 1."""
    raw = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    space = _SPACE[raw]
    solid = ~space
    # One space after each word, no other white space.
    keep = solid | (space & np.append(False, solid[:-1]))
    words = raw[keep]
    words[_SPACE[words]] = 0x20
    gaps = np.flatnonzero(words == 0x20)
    if len(words) and words[-1] != 0x20:
        gaps = np.append(gaps, len(words))
    if not len(gaps):
        return 0
    data = words.tobytes()
    size = min(size, len(gaps))
    starts = np.concatenate([[0], gaps[:-1] + 1])[: len(gaps) - size + 1].tolist()
    ends = gaps[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _HELD):
        spans = zip(starts[at : at + _HELD], ends[at : at + _HELD])
        hashes = np.array([digest(data[a:b], HASH_SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as BIGINT with the same 64 bits."""

    @F.arrow_udf("bigint")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            prints = np.array([fingerprint(one.as_py(), size) for one in texts], np.uint64)
            yield pa.array(prints.view(np.int64))

    return made(text)


def error_patterns(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """What leads from 32 bits to the anchors within ``reach``: patterns, and where each syndrome's start.

    Bit 31 is on its own; the syndrome of the others is the exclusive or of
    (place + 1) over the set bits. Adding a pattern of the same syndrome gives a
    word of the code.
    """
    by_syndrome: list[list[int]] = [[] for _ in range(32)]
    for weight in range(reach + 1):
        for places in combinations(range(32), weight):
            syndrome = pattern = 0
            for place in places:
                pattern |= 1 << place
                syndrome ^= place + 1 if place < 31 else 0
            by_syndrome[syndrome].append(pattern)
    starts = np.concatenate([[0], np.cumsum([len(one) for one in by_syndrome])])
    return np.array([p for one in by_syndrome for p in one], np.uint32), starts


def _syndromes(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(len(halves), np.uint32)
    for place in range(31):
        out ^= ((halves >> np.uint32(place)) & np.uint32(1)) * np.uint32(place + 1)
    return out.astype(np.int64)


def _replicas(max_distance: int):
    reach = 1 + math.ceil(max_distance // 2 / 2)
    patterns, starts = error_patterns(reach)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy()
            prints = signed.view(np.uint64)
            for half in (0, 1):
                bits = ((prints >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                syndromes = _syndromes(bits)
                counts = starts[syndromes + 1] - starts[syndromes]
                ends = np.cumsum(counts)
                total = int(ends[-1]) if len(ends) else 0
                which = np.repeat(starts[syndromes] - (ends - counts), counts) + np.arange(total)
                anchors = np.repeat(bits, counts) ^ patterns[which]
                keys = anchors.astype(np.int64) | np.int64(half << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(signed, counts))], names=["anchor", "fp"]
                )

    return replicate


def forest(prints: np.ndarray, max_distance: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (u64): pairs of places."""
    n = len(prints)
    if n == 2:
        linked = np.bitwise_count(prints[0] ^ prints[1]) <= max_distance
        return (np.array([0]), np.array([1])) if linked else (np.zeros(0, int), np.zeros(0, int))
    waiting = np.arange(n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            some, front = front[:block], front[block:]
            near = np.bitwise_count(prints[some][:, None] ^ prints[waiting][None, :]) <= max_distance
            found = near.any(axis=0)
            left.append(some[near.argmax(axis=0)[found]])
            right.append(waiting[found])
            front = np.concatenate([front, waiting[found]])
            waiting = waiting[~found]
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


_FOUND = "a bigint, b bigint, anchor bigint"


def _compare(max_distance: int, most: int | None):
    """Links at each anchor, from rows sorted by anchor; members of anchors with more than ``most`` go on."""

    def rows(a: np.ndarray, b: np.ndarray | None, anchor: np.ndarray | None) -> pa.RecordBatch:
        nulls = pa.nulls(len(a), pa.int64())
        columns = [pa.array(a), nulls if b is None else pa.array(b), nulls if anchor is None else pa.array(anchor)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "anchor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_anchor: int | None = None
        held: list[np.ndarray] = []
        n_held = 0
        passing = False  # the held anchor has too many members; they go on as they come

        def ended() -> Iterator[pa.RecordBatch]:
            if n_held > 1 and not passing:
                prints = np.unique(np.concatenate(held))
                a, b = forest(prints.view(np.uint64), max_distance)
                if len(a):
                    yield rows(prints[a], prints[b], None)

        for batch in batches:
            anchors, prints = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(anchors):
                continue
            firsts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
            lasts = np.append(firsts[1:], len(anchors))
            # Most anchors have one member; between the first and the last run they need no look.
            inner = np.flatnonzero(lasts - firsts > 1)
            look = np.unique(np.concatenate([[0], inner, [len(firsts) - 1]]))
            for run in look.tolist():
                anchor, own = int(anchors[firsts[run]]), prints[firsts[run] : lasts[run]]
                if anchor != held_anchor:
                    yield from ended()
                    held_anchor, held, n_held, passing = anchor, [], 0, False
                held.append(own)
                n_held += len(own)
                if most is not None and n_held > most:
                    passing = True
                if passing:
                    members = np.concatenate(held)
                    held = []
                    yield rows(members, None, np.full(len(members), anchor))
        yield from ended()

    return compare


def _compared(replicas: DataFrame, max_distance: int, most: int | None) -> DataFrame:
    placed = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return placed.mapInArrow(_compare(max_distance, most), _FOUND)


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE, most: int = ANCHOR_MEMBERS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``), enough for all components."""
    if not 0 <= max_distance <= 7:
        raise ValueError("max_distance must be from 0 to 7")
    replicas = prints.select("fp").mapInArrow(_replicas(max_distance), "anchor bigint, fp bigint")
    found = stored(_compared(replicas, max_distance, most), "anchor-links")
    joined = found.where("b IS NOT NULL").select("a", "b")
    waiting = found.where("b IS NULL").select("anchor", F.col("a").alias("fp"))
    if not waiting.isEmpty():
        joined = joined.unionByName(_split_links(waiting, max_distance, most))
    return joined.distinct()


def _split_links(members: DataFrame, max_distance: int, most: int) -> DataFrame:
    """Links at anchors with very many members: each pair of blocks is compared by itself."""
    counts = members.groupBy("anchor").agg(F.count("*").alias("_rows"))
    blocks = F.ceil(F.col("_rows") * 2 / most).cast("int")
    table = stored(counts.select(F.col("anchor").alias("_group"), "_rows", blocks.alias("_blocks")), "anchors")
    own = F.pmod(F.hash("fp"), F.col("_blocks"))
    blocked = with_group_values(members, "anchor", table).withColumn("_own", own)
    paired = blocked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    key = F.xxhash64("anchor", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return _compared(paired.select(key.alias("anchor"), "fp"), max_distance, None).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node of ``edges``: the root is its component's smallest node.

    Alternates large-star and small-star operations until nothing changes; both
    keep every component, and end with each node linked to its root alone. Each
    round is written, so a lost executor costs no earlier one.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")), "edges")
    state = None
    for _ in range(0 if now.isEmpty() else max_rounds):
        now = _small_star(_large_star(now))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state is not None:
            raise RuntimeError(f"links not joined after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("root").alias("node"), "root")
    )


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashed).first())


def _with_least(edges: DataFrame, include: Column) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("_group")).agg(
        F.count("*").alias("_rows"), F.min("v").alias("_least")
    )
    table = stored(least.select("_group", "_rows", F.least("_least", "_group").alias("_least")), "least")
    return with_group_values(edges, "u", table).where(include)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _with_least(both, F.col("v") > F.col("u"))
    out = stars.select(F.col("v").alias("u"), F.col("_least").alias("v")).where("u != v").distinct()
    return stored(out, "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = _with_least(down, F.lit(True))
    moved = stars.select(F.col("v").alias("u"), F.col("_least").alias("v")).unionByName(
        stars.select("u", F.col("_least").alias("v"))
    )
    return stored(moved.where("u != v").distinct(), "small-star")


def _classes(rows: DataFrame, key: str, max_distance: int) -> DataFrame:
    """Per fingerprint of ``rows`` (stored; ``key``, ``fp``): its rows, its component's root and least key."""
    prints = stored(
        rows.groupBy("fp").agg(F.count("*").alias("_rows"), F.min(key).alias("_first")), "fingerprints"
    )
    joined = stored(components(links(prints, max_distance)), "components")
    roots = joined.join(prints.withColumnRenamed("fp", "node"), "node")
    least = stored(
        roots.groupBy(F.col("root").alias("_group")).agg(
            F.sum("_rows").alias("_rows"), F.min("_first").alias("_least")
        ),
        "roots",
    )
    # A component's fingerprints may be very many: its one value goes to them by size.
    members = with_group_values(joined.select("node", "root"), "root", least)
    linked = members.select(F.col("node").alias("fp"), "root", F.col("_least").alias("_linked"))
    both = prints.join(linked, "fp", "left")
    component = F.when(F.col("root").isNull(), F.col("_first")).otherwise(F.col("_linked"))
    values = ("_rows", F.coalesce("root", "fp").alias("root"), component.alias("component_id"))
    return stored(both.select(F.col("fp").alias("_group"), *values), "classes")


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``key``, fingerprint (16 hex digits) and component_id of every row.

    The component id is the smallest key that links lead to; NULL keys come last.
    """
    rows = stored(
        df.select(F.col(key).alias("_key"), fingerprints(F.col(text), size).alias("fp")), "simhashes"
    )
    table = _classes(rows, "_key", max_distance)
    return with_group_values(rows, "fp", table).select(
        F.col("_key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row of each component, that with the smallest key; with the columns that ``df`` has."""
    landed = Landed(df, {"_key": F.col(key), "fp": fingerprints(F.col(text), size)}, "simhash-rows")
    rows = landed.rows.select(UID, "_key", "fp")
    table = _classes(rows, "_key", max_distance)
    placed = stored(with_group_values(rows, "fp", table), "placed")
    # Of a component's rows with its smallest key (all of them, if keys are NULL) the first stays.
    first = placed.where(F.col("_key").eqNullSafe(F.col("component_id")))
    stays = first.groupBy("root").agg(F.min(UID).alias(UID))
    kept = landed.bitmaps(stays.select(UID))
    out = landed.whole(landed.marked(kept, True))
    landed.close()
    return out
