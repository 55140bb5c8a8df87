"""Pack documents into sequences of several permitted lengths.

Best fit over bins of variable capacity: pieces, the longest first, go where the
least room is left over; where they fit nowhere, a bin is opened, of the length
that costs least. At the end every bin shrinks to the cheapest permitted length
that holds its contents. What a length costs depends on what will lie beside the
piece: big bins fill well, small ones cost little. So each opening tries every
permitted length on the pieces still to come, and takes the one with the least
cost for each word held. That looks ahead one bin at a time, so the packings with
one length opened by preference throughout are made too, and of all the cheapest
stays.

Documents longer than the longest length are cut into pieces of it, and the rest.
Pieces are dealt by hash into shards of some 20,000; each is packed by itself, in
one task. The shards grow in number with the table and never in size, and leave
at most a few unfilled bins each. Rows alike in key and size give the same pieces,
so they are counted and numbered, and nothing depends on where a row lay: the same
table gives the same sequences however it is partitioned.

Defined results: a document of size 0 (a NULL text, or one without words) is in
no sequence, and has one row with NULL there; repeated rows are packed each, rows
without a key as well; a text of any length is packed whole; an empty table gives
an empty result. Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import word_count
from labelloom.shared import stored

LENGTHS = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000

#: Rows alike in key and size that are numbered in one go.
_COPIES = 1 << 16

_PLACED = "sequence bigint, capacity bigint, position bigint"


def sequence_costs(lengths: Sequence[int], quadratic: float = 1 / 16384) -> dict[int, float]:
    """Cost of a sequence of each length: its places, and attention that grows with their square."""
    return {n: n + quadratic * n * n for n in lengths}


class Waiting:
    """How many pieces of each size are still to come."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.counts = Counter(sizes)
        self.sizes = 0  # bit s is set if a piece of size s waits
        for size in self.counts:
            self.sizes |= 1 << size

    def take(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.sizes ^= 1 << size

    def filling(self, room: int) -> int:
        """The words that fit into ``room`` if the largest piece that fits goes in, again and again."""
        left, sizes = room, self.sizes
        while sizes := sizes & ((2 << left) - 1):
            size = sizes.bit_length() - 1
            left -= size * min(self.counts[size], left // size)
            sizes ^= 1 << size
        return room - left


def least_cost(size: int, costs: Mapping[int, float], waiting: Waiting) -> int:
    """The length to open for a piece: least cost for each word it would hold; ties go to the longer one."""
    prices = {}
    lengths = sorted(costs)
    for length in lengths:
        if length >= size:
            held = size + waiting.filling(length - size)
            prices[length] = min(costs[n] for n in lengths if n >= held) / held
    return min(prices, key=lambda n: (prices[n], -n))


def best_fit(
    sizes: Sequence[int], costs: Mapping[int, float], preferred: int | None = None
) -> tuple[list[int], list[int], float]:
    """Bin of each size (longest first), final capacity of each bin, and the cost of all.

    The length of a new bin is the ``least_cost`` one for the pieces to come. With
    ``preferred`` it is that, or, for a size beyond it, the length that costs least
    for each of its places; ties go to the longer one.
    """
    lengths = sorted(costs)
    rooms: dict[int, list[int]] = {}  # bins by the room they have
    open_ = 0  # bit r is set if a bin has room r
    waiting = Waiting(sizes) if preferred is None else None
    used: list[int] = []
    places: list[int] = []
    for size in sizes:
        if waiting:
            waiting.take(size)
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            if waiting:
                room = least_cost(size, costs, waiting)
            elif preferred >= size:
                room = preferred
            else:
                room = min((n for n in lengths if n >= size), key=lambda n: (costs[n] / n, -n))
            bin_ = len(used)
            used.append(0)
        places.append(bin_)
        used[bin_] += size
        if room > size:
            rooms.setdefault(room - size, []).append(bin_)
            open_ |= 1 << (room - size)
    final = [min((n for n in lengths if n >= total), key=costs.__getitem__) for total in used]
    return places, final, sum(costs[n] for n in final)


def _packed(costs: Mapping[int, float]):
    def pack(shard: pa.Table) -> pa.Table:
        order = ("_length", "descending"), ("_key", "ascending"), ("_size", "ascending"), ("_copy", "ascending")
        shard = shard.sort_by([*order, ("_piece", "ascending")])
        sizes = shard["_length"].to_pylist()
        tries = (best_fit(sizes, costs, preferred) for preferred in (None, *sorted(costs)))
        places, capacities, _ = min(tries, key=lambda one: one[2])
        filled = [0] * len(capacities)
        positions = []
        for place, size in zip(places, sizes):
            positions.append(filled[place])
            filled[place] += size
        bins = np.array(places, np.int64)
        # A shard has fewer pieces than 2**32.
        sequences = bins + (np.int64(shard["_shard"][0].as_py()) << np.int64(32))
        added = {
            "sequence": pa.array(sequences),
            "capacity": pa.array(np.array(capacities, np.int64)[bins]),
            "position": pa.array(positions, pa.int64()),
        }
        kept = shard.select(["_key", "_piece", "_first", "_length"])
        for name, column in added.items():
            kept = kept.append_column(name, column)
        return kept

    return pack


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lengths: Sequence[int] = LENGTHS,
    costs: Mapping[int, float] | None = None,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row for each piece of each row of ``df``.

    ``key``, piece (from 0), word and words (where the piece starts in the
    document, and its length), sequence, capacity (its length) and position
    (where the piece starts in it).
    """
    costs = dict(costs or sequence_costs(lengths))
    longest = max(costs)
    size = word_count(F.col(text)).alias("_size")
    counted = df.select(F.col(key).alias("_key"), size).groupBy("_key", "_size").agg(F.count("*").alias("_n"))
    sizes = stored(counted, "sizes")
    # Of many rows alike, each task numbers a stretch.
    stretch = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {_COPIES}"))).alias("_stretch")
    spread = sizes.select("*", stretch).repartition("_key", "_size", "_stretch")
    start = F.col("_stretch") * _COPIES
    end = F.least(start + _COPIES, F.col("_n")) - 1
    rows = spread.select("_key", "_size", F.explode(F.sequence(start, end)).alias("_copy"))
    last = F.expr(f"(_size - 1) div {longest}")
    pieces = rows.where("_size > 0").select(
        "_key", "_size", "_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_piece")
    )
    first = F.col("_piece") * longest
    n_pieces = sizes.agg(F.sum(F.expr(f"_n * ((_size + {longest - 1}) div {longest})"))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    dealt = pieces.select(
        "_key",
        "_size",
        "_copy",
        "_piece",
        first.alias("_first"),
        F.least(F.col("_size") - first, F.lit(longest)).alias("_length"),
        F.pmod(F.xxhash64("_key", "_size", "_copy", "_piece"), F.lit(shards)).alias("_shard"),
    )
    kind = sizes.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _piece bigint, _first bigint, _length bigint, {_PLACED}"
    placed = dealt.groupBy("_shard").applyInArrow(_packed(costs), schema)
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    empty = rows.where("_size = 0").select(
        "_key",
        zero.alias("_piece"),
        zero.alias("_first"),
        zero.alias("_length"),
        none.alias("sequence"),
        none.alias("capacity"),
        none.alias("position"),
    )
    return placed.unionByName(empty).select(
        F.col("_key").alias(key),
        F.col("_piece").alias("piece"),
        F.col("_first").alias("word"),
        F.col("_length").alias("words"),
        "sequence",
        "capacity",
        "position",
    )
