"""Mix sources to target weights with a low-discrepancy schedule.

Each source's documents, in an order drawn by hash, lie end to end as one stream
of words, repeated as often as the source may be; the stream is cut into blocks
of equally many words. Slot i of the mix gets the point frac(i / golden ratio);
the cumulative targets of the sources cut the line from 0 to 1 into intervals,
and the interval that the point falls into names the source. The slots of a
source, ranked, take its blocks one after the other. Whatever stretch of the
schedule is looked at, every source's share in it is off by a few slots only. The
plan names the first and last slot of each document, and mixed rows are written in
the order of the slots that they begin in. A source has as many slots as its target needs: those beyond are left out, and
missing ones come at the end. The last block of a source ends with its target.

Targets: all sources share the number of all words by weight. A target stops at
``repeats`` times its source's words, and the excess is shared again by weight
until none is above.

A source of any size is spread over many tasks: places in the streams and ranks
of slots are running totals over ranges of rows, and slots meet blocks by source
and number of the block.

Defined results: a NULL text has size 0, as has one without words; such rows take
no words. A NULL source is a source, the last one. Repeated rows are documents of
their own; the order of rows with the same id comes from their text. An empty
table gives an empty result, and a source without words the target 0.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import ROW, UID, WORD, Landed, running_totals, word_count
from labelloom.shared import stored, with_group_values

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 1024
SEED = 42

_LINE = 1 << 31
#: Odd, and next to _LINE / golden ratio: multiples modulo _LINE are the points, in whole numbers.
_GOLDEN = 1327217885


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS
) -> DataFrame:
    """``sizes`` (stored; source, source_size, _rows) plus _number, weight and target.

    Only sums come to the driver: a round finds the words a unit of weight gets
    once the sources above their limit are taken out.
    """
    ordered = sizes.select(
        "*", F.lit(0).alias("_all"), F.col("source").isNull().alias("_last"), F.lit(1).alias("_one")
    )
    numbered = running_totals(ordered, "_all", ["_last", "source"], "_one", "_number")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_number") % len(weights)).cast("int"))
    limited = stored(
        numbered.select(
            "source",
            "source_size",
            "_rows",
            "_number",
            weight.cast("bigint").alias("weight"),
            (F.col("source_size") * repeats).alias("_limit"),
        ),
        "sources",
    )
    total = limited.agg(F.sum("source_size")).first()[0] or 0
    unit, above = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(unit) > F.col("_limit")
        n, limits, free = limited.agg(
            F.count_if(over), F.sum(F.when(over, F.col("_limit"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == above or not free:
            break
        above, unit = n, (total - (limits or 0)) / free
    target = F.least(F.col("_limit").cast("double"), F.col("weight") * F.lit(unit))
    return limited.select("source", "source_size", "_rows", "_number", "weight", target.alias("target"))


def _slots(targets: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The schedule: slot, _number (of the source) and _block, as many as the targets need; a number above all slots."""
    spark = targets.sparkSession
    # Of the target, whole words are taken.
    takes = targets.select("_number", F.floor("target").alias("_take"), F.lit(0).alias("_all"))
    placed = stored(running_totals(takes, "_all", ["_number"], "_take", "_before"), "shares")
    n_sources, total = placed.agg(F.count("*"), F.sum("_take")).first()
    total = total or 0
    needed = F.ceil(F.col("_take") / block)
    n_slots = -(-total // block)
    bits = min(22, max(10, (4 * n_sources).bit_length()))
    shift = 31 - bits
    scale = _LINE / max(total, 1)

    def bound(words: Column) -> Column:
        return F.least(F.floor(words * F.lit(scale)), F.lit(_LINE))

    spans = placed.select(
        "_number",
        bound(F.col("_before")).alias("_low"),
        F.when(F.col("_before") + F.col("_take") == total, F.lit(_LINE))
        .otherwise(bound(F.col("_before") + F.col("_take")))
        .alias("_high"),
    ).where("_low < _high")
    # Stretches of the line, equally long: a source is in every one it reaches into.
    stretches = F.sequence(F.shiftright("_low", shift), F.shiftright(F.col("_high") - 1, shift))
    spread = spans.select("*", F.explode(stretches).alias("_stretch"))
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % _LINE) * _GOLDEN % _LINE).alias("_point")
    )
    points = points.withColumn("_stretch", F.shiftright("_point", shift))
    named = points.join(spread, "_stretch").where("_low <= _point AND _point < _high")
    ranked = running_totals(
        named.select("slot", "_number", F.lit(1).alias("_one")), "_number", ["slot"], "_one", "_block"
    )
    scheduled = stored(ranked.select("slot", "_number", "_block"), "slots")
    counted = scheduled.groupBy(F.col("_number").alias("_of")).agg(F.count("*").alias("_slots"))
    states = placed.join(counted, F.col("_number") == F.col("_of"), "left").select(
        "_number", needed.alias("_needed"), F.coalesce("_slots", F.lit(0)).alias("_slots")
    )
    states = stored(states, "needs")
    table = states.select(F.col("_number").alias("_group"), F.col("_slots").alias("_rows"), "_needed")
    in_time = with_group_values(scheduled, "_number", stored(table, "needed")).where("_block < _needed")
    missing = states.where("_slots < _needed").select(
        F.explode(F.sequence(F.col("_slots"), F.col("_needed") - 1)).alias("_block"), "_number"
    )
    late = missing.select((F.lit(n_slots) + F.col("_number")).alias("slot"), "_number", "_block")
    return in_time.select("slot", "_number", "_block").unionByName(late), n_slots + n_sources


class Mix:
    """The mix of a table with the columns ``_uid``, ``_key``, ``_source``, ``_size`` and ``_hash``."""

    def __init__(
        self,
        rows: DataFrame,
        weights: tuple[int, ...] = WEIGHTS,
        repeats: int = REPEATS,
        block: int = BLOCK_WORDS,
        seed: int = SEED,
    ) -> None:
        sizes = rows.groupBy(F.col("_source").alias("source")).agg(
            F.sum("_size").alias("source_size"), F.count("*").alias("_rows")
        )
        targets = stored(source_targets(stored(sizes, "source-sizes"), weights, repeats), "targets")
        table = targets.withColumnRenamed("source", "_group").drop("weight")
        self.rows = with_group_values(rows, "_source", table).drop("_rows")
        drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
        lengths = self.rows.where("_size > 0").select(
            UID, "_number", drawn.alias("_drawn"), "_key", "_hash", "_size", "source_size", "target"
        )
        placed = running_totals(lengths, "_number", ["_drawn", "_key", "_hash"], "_size", "_start")
        slots, self.slots = _slots(targets, block)
        self.repeats = repeats
        self.schedule = stored(self._pieces(placed, slots, block, repeats), "schedule")

    def _pieces(self, placed: DataFrame, slots: DataFrame, block: int, repeats: int) -> DataFrame:
        """slot, _uid, epoch, word (where the piece starts in the document) and words (its length)."""
        epochs = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch"))
        first = F.col("epoch") * F.col("source_size") + F.col("_start")
        last = F.least(first + F.col("_size"), F.floor("target"))
        taken = epochs.select(UID, "_number", "epoch", first.alias("_first"), last.alias("_last"))
        cut = taken.where("_first < _last").select(
            "*", F.explode(F.sequence(F.expr(f"_first div {block}"), F.expr(f"(_last - 1) div {block}"))).alias("_block")
        )
        start = F.greatest("_first", F.col("_block") * block)
        end = F.least("_last", (F.col("_block") + 1) * block)
        pieces = cut.select(
            UID, "_number", "_block", "epoch", (start - F.col("_first")).alias("word"), (end - start).alias("words")
        )
        return pieces.join(slots, ["_number", "_block"]).select("slot", UID, "epoch", "word", "words")

    def taken(self) -> DataFrame:
        """``_uid``, taken: the words of each document in the mix, repeats counted.

        A source's stream passes through a document again and again, and ends with
        the target; so every passage but the last one takes the whole document.
        """
        return self.schedule.groupBy(UID).agg(F.sum("words").alias("taken"))

    def places(self) -> DataFrame:
        """``_uid``, taken, first_slot and last_slot: how much of each document the mix has, and where."""
        return self.schedule.groupBy(UID).agg(
            F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
        )

    def passage(self, epoch: int) -> DataFrame:
        """``_uid``, _number: the slot that a passage through each document begins in."""
        return self.schedule.where(F.col("epoch") == epoch).groupBy(UID).agg(F.min("slot").alias("_number"))


def mix_plan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    **settings: object,
) -> DataFrame:
    """``key``, size, source, source_size, target, taken, first_slot and last_slot of every row.

    ``taken`` is the number of the row's words in the mix, repeats counted; the
    slots are NULL where that is 0.
    """
    rows = df.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        F.xxhash64(F.col(text)).alias("_hash"),
        F.monotonically_increasing_id().alias(UID),
    )
    rows = stored(rows, "document-sizes")
    mix = Mix(rows, **settings)
    taken = mix.places().withColumnRenamed(UID, "_of")
    return mix.rows.join(taken, F.col(UID) == F.col("_of"), "left").select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_source").alias(source),
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "first_slot",
        "last_slot",
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, counts: pa.Array) -> pa.Array:
        def one(whole: str | None, count: int | None) -> str | None:
            if whole is None or count is None:
                return None
            word = next(islice(re.finditer(WORD, whole), count - 1, None))
            return whole[: word.end()]

        return pa.array(map(one, texts.to_pylist(), counts.to_pylist()), pa.string())

    return cut(text, n)


def _in_order(rows: DataFrame, slots: int) -> DataFrame:
    """Rows ranged by ``_slot``: equal stretches of the schedule, which hold about as many words each."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.coalesce(F.expr(f"_slot * {parts} div {max(slots, 1)}"), F.pmod(UID, F.lit(parts)))
    ranged = rows.withColumn("_stretch", stretch.cast("int")).repartitionById(parts, "_stretch")
    return ranged.sortWithinPartitions("_slot", UID, "_passage").drop("_stretch")


def mixed_rows(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    length: str | None = None,
    **settings: object,
) -> DataFrame:
    """The mix as rows with the columns of ``df``: each as often as its source is passed through.

    Rows are in the order of the schedule, in equal stretches of it; those without
    words, which no slot holds, lie among them. A row is cut only where its source's target ends, to the words within; the
    column ``length``, if named and there, follows. Rows without words stay once.
    """
    extra = {
        "_key": F.col(key),
        "_source": F.col(source),
        "_size": word_count(F.col(text)),
        "_hash": F.xxhash64(F.col(text)),
    }
    landed = Landed(df, extra, "mix-rows")
    mix = Mix(landed.rows.select(UID, *extra), **settings)
    # Passages through a document end with the one that its source's target cuts.
    joined = landed.with_numbers(mix.taken().withColumnRenamed("taken", "_number"), "_all")
    passages = F.ceil(F.col("_all") / F.col("_size")).cast("int")
    once = F.when((F.col("_size") == 0), F.array(F.lit(1))).when(F.col("_all") > 0, F.sequence(F.lit(1), passages))
    slots = [f"_slot{epoch}" for epoch in range(mix.repeats)]
    for epoch, name in enumerate(slots):
        joined = landed.with_numbers(mix.passage(epoch), name, joined)
    joined = joined.withColumn("_passage", F.explode(once)).withColumn(
        "_taken", F.least(F.col("_size"), F.col("_all") - (F.col("_passage") - 1) * F.col("_size"))
    )
    joined = _in_order(joined.withColumn("_slot", F.get(F.array(*slots), F.col("_passage") - 1)).drop(*slots), mix.slots)
    whole = F.col(f"{ROW}.`{text}`")
    is_cut = F.coalesce(F.col("_taken") < F.col("_size"), F.lit(False))
    short = first_words(F.when(is_cut, whole), F.when(is_cut, F.col("_taken")))
    rows = joined.withColumn("_short", short)
    values = {f.name: F.col(f"{ROW}.`{f.name}`") for f in df.schema}
    values[text] = F.when(is_cut, F.col("_short")).otherwise(whole)
    if length in values:
        kind = df.schema[length].dataType
        values[length] = F.when(is_cut, F.length("_short").cast(kind)).otherwise(values[length])
    out = rows.select(*[c.alias(n) for n, c in values.items()])
    landed.close()
    return out
