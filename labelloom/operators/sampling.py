"""Exact seeded samples, per-class caps and stratified splits.

Rows have no position, so every operator orders them by ``md5(seed:step:key), key``
for a unique ``key`` column: same seed and keys, same rows, however the table is
partitioned. Each kind of step has a hash of its own, so that a sample of a part
is a sample of it and not its rows next to the cut. A key that the cut would have
to tell from its own repetition ends the query.

No operator sorts the rows, and none keeps a row for each of them. Hashes lie evenly
between 0 and 1, so from the number of a group's rows follows where its n-th hash
must be, give or take some square roots of that number. One pass counts the rows
below that window and keeps the keys inside; among those, the n-th row of the group,
its cut, is found by rank. If a cut lies outside its window (repeated keys may do
that), the search goes on in a wider one. The last pass compares each row with its
group's cut, a filter next to the scan. A group holding a third of all rows has a
window like any other: of 10^12 rows some 10 million keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.shared import BROADCAST_BYTES, measured, ranked, stored, stored_with_figures, with_group_values

_DIGITS = 12  # of a hash, that tell on which side of a window it lies
#: Half the width of a window in standard deviations, and how much wider each further one is.
_WIDTH = 8.0
_WIDER = 32.0
_ABOVE_ALL = "g"


def seeded_hash(key: Column, seed: int, step: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:{step}:"), key.cast("string")))


def _group_counts(df: DataFrame, group: Column) -> DataFrame:
    return df.groupBy(group.alias("_group")).agg(F.count("*").alias("_rows"))


def _edge(share: Column) -> Column:
    """The first digits of the hash at a share of all hashes."""
    digits = F.lower(F.hex(F.floor(share * float(16**_DIGITS)).cast("bigint")))
    edge = F.lpad(digits, _DIGITS, "0")
    return F.when(share <= 0, "").when(share >= 1, _ABOVE_ALL).otherwise(edge)


def windows(takes: DataFrame, width: float) -> DataFrame:
    """``takes`` (_group, _rows, _take) plus where the hash of the last row taken must lie: from _low, below _high."""
    n, take = F.col("_rows").cast("double"), F.col("_take").cast("double")
    spread = (F.sqrt(take * F.greatest(1 - take / n, F.lit(0.0))) + 1) * width
    edges = {"_low": _edge((take - spread) / n), "_high": _edge((take + spread) / n)}
    if math.isinf(width):
        edges = {"_low": F.lit(""), "_high": F.lit(_ABOVE_ALL)}
    return takes.where("_take > 0").withColumns(edges)


def _ranked_in_windows(rows: DataFrame, seed: int, step: str) -> DataFrame:
    """Hash and key of each group's cut, of ``rows`` (_group, _key, _rows, _take, _low, _high).

    Of the rows below a window only their number is kept, under a NULL key.
    """
    hashed = seeded_hash(F.col("_key"), seed, step)
    digits = F.substring(hashed, 1, _DIGITS)
    inside = F.when(digits >= F.col("_low"), F.col("_key"))
    near = (
        rows.where(digits < F.col("_high"))
        .groupBy("_group", inside.alias("_key"))
        .agg(F.count("*").alias("_n"), F.max("_rows").alias("_rows"), F.max("_take").alias("_take"))
        .withColumn("_hash", hashed)
    )
    by_hash = Window.partitionBy("_group").orderBy(F.asc_nulls_first("_hash"), "_key")
    upto = near.withColumn("_upto", F.sum("_n").over(by_hash))
    is_cut = F.col("_key").isNotNull() & (F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take"))
    message = F.concat(F.lit("the key is not unique: "), F.col("_key").cast("string"))
    repeated = F.when(F.col("_upto") > F.col("_take"), F.raise_error(message).cast(rows.schema["_key"].dataType))
    return upto.where(is_cut).select(
        "_group", "_rows", F.col("_hash").alias("_cut_hash"), repeated.otherwise(F.col("_key")).alias("_cut_key")
    )


def _cuts(
    df: DataFrame,
    group: Column,
    key: str,
    takes: DataFrame,
    seed: int,
    step: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per group of ``takes`` (stored; _group, _rows, _take): hash and key of its last row taken.

    Groups of which no row is taken are left out.
    """
    keys = df.select(group.alias("_group"), F.col(key).alias("_key"))
    found, width = None, _WIDTH
    while True:
        wanted = stored(windows(takes, width), "windows")
        rows = with_group_values(keys, "_group", wanted, broadcast_bytes=broadcast_bytes)
        cuts, figures = stored_with_figures(_ranked_in_windows(rows, seed, step), "cuts", [F.count("*").alias("n")])
        found = cuts if found is None else found.unionByName(cuts)
        if figures["n"] == wanted.count():
            return found
        if math.isinf(width):
            # Keys that are missing take no place, so the group has fewer than it should take.
            raise ValueError(f"{key!r} is NULL in some of the rows")
        takes = stored(_without(takes, cuts), "takes-left")
        width = width * _WIDER if width < _WIDTH * _WIDER else math.inf


def _without(takes: DataFrame, cuts: DataFrame) -> DataFrame:
    """The groups that have no cut yet."""
    done = cuts.select(F.col("_group").alias("_done"))
    return takes.where("_take > 0").join(done, F.col("_group").eqNullSafe(F.col("_done")), "left_anti")


def _with_taken(
    df: DataFrame, group: str, key: str, seed: int, step: str, cuts: DataFrame, broadcast_bytes: int
) -> DataFrame:
    """``df`` plus BOOLEAN ``_taken``: the row comes no later than its group's cut."""
    joined = with_group_values(df, group, cuts, broadcast_bytes=broadcast_bytes)
    own = seeded_hash(F.col(key), seed, step)
    taken = (own < F.col("_cut_hash")) | (
        (own == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key"))
    )
    return joined.select(*df.columns, F.coalesce(taken, F.lit(False)).alias("_taken"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key. Keys are sorted first, then the few rows up to the last of them."""
    last = df.select(key).orderBy(key).limit(n).agg(F.max(key).alias("last"))
    return df.where(F.col(key) <= last.scalar()).orderBy(key).limit(n)


def sample_exact(
    df: DataFrame, n: int | None, seed: int, key: str, step: str = "sample"
) -> DataFrame:
    """Exactly ``n`` rows, uniform, without replacement; all rows if ``n`` is none, 0 or too large.

    The input is computed three times, so it must give the same rows each time.
    """
    if not n:
        return df
    rows = df.count()
    if n >= rows:
        return df
    spark, width = df.sparkSession, _WIDTH
    take = spark.range(1).select(F.lit(0).alias("_group"), F.lit(rows).alias("_rows"), F.lit(n).alias("_take"))
    while True:
        # The only group's window goes to the rows as literals.
        (window,) = windows(take, width).collect()
        values = [F.lit(value).alias(name) for name, value in window.asDict().items()]
        keys = df.select(F.col(key).alias("_key"), *values)
        cuts, figures = stored_with_figures(_ranked_in_windows(keys, seed, step), "cuts", [F.count("*").alias("n")])
        if figures["n"]:
            break
        if math.isinf(width):
            raise ValueError(f"{key!r} is NULL in some of the rows")
        width = width * _WIDER if width < _WIDTH * _WIDER else math.inf
    cut = cuts.select(F.struct("_cut_hash", "_cut_key")).scalar()
    own = F.struct(
        seeded_hash(F.col(key), seed, step).alias("_cut_hash"), F.col(key).alias("_cut_key")
    )
    return df.where(own <= cut)


def cap_per_class(
    df: DataFrame,
    total: int,
    label: str,
    seed: int,
    key: str,
    classes: int = 9,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """At most ``total // classes`` rows of each class, and only if there are more than ``total`` rows."""
    counts = stored(_group_counts(df, F.col(label)), "class-counts")
    _, rows = measured(counts)
    if rows <= total:
        return df
    if total < classes:
        return df.where(F.lit(False))
    takes = counts.withColumn("_take", F.least("_rows", F.lit(total // classes).cast("bigint")))
    cuts = _cuts(df, F.col(label), key, takes, seed, "cap", broadcast_bytes)
    return _with_taken(df, label, key, seed, "cap", cuts, broadcast_bytes).where("_taken").drop("_taken")


def train_quotas(counts: DataFrame, n_train: int, n: int) -> DataFrame:
    """Training rows per class: proportional share rounded down, then largest remainders.

    ``counts`` has one row per class (_group, _rows); equal remainders go to the
    lower class. Products of two row counts leave BIGINT, hence the decimals.
    """
    share = F.col("_rows").cast("decimal(19,0)") * F.lit(n_train).cast("decimal(19,0)")
    whole = counts.withColumn("_share", share).select(
        "_group",
        "_rows",
        F.expr(f"_share div {n}").alias("_floor"),
        (F.col("_share") % F.lit(n).cast("decimal(19,0)")).alias("_rest"),
    )
    whole = stored(whole, "shares")
    missing = n_train - (whole.agg(F.sum("_floor")).first()[0] or 0)
    placed = ranked(whole, [F.desc("_rest"), F.asc("_group")], "_place")
    extra = (F.col("_place") <= F.lit(int(missing))).cast("bigint")
    return placed.select("_group", "_rows", (F.col("_floor") + extra).alias("_take"))


def _check_classes(counts: DataFrame, n: int, n_train: int, label: str) -> None:
    classes, smallest = counts.agg(F.count("*"), F.min("_rows")).first()
    if smallest is not None and smallest < 2:
        some = [row[0] for row in counts.where("_rows < 2").select("_group").limit(10).collect()]
        raise ValueError(f"classes of {label!r} with fewer than 2 rows, among them: {some}")
    for name, rows in (("test", n - n_train), ("train", n_train)):
        if rows < max(classes, 1):
            raise ValueError(f"{rows} {name} rows cannot hold {classes} classes of {label!r}")


def stratified_split(
    df: DataFrame,
    test_size: float | int,
    seed: int,
    label: str,
    key: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    step: str = "split",
) -> DataFrame:
    """``df`` plus ``split`` ('train' or 'test'), with exact sizes and class shares kept.

    The test part has ceil(test_size * rows) rows, or ``test_size`` rows if it is
    a whole number. Raises if a class has fewer than 2 rows or a part has fewer
    rows than there are classes. The input is computed three times, so it must give
    the same rows each time.
    """
    counts = stored(_group_counts(df, F.col(label)), "class-counts")
    _, n = measured(counts)
    n_test = test_size if isinstance(test_size, int) else math.ceil(test_size * n)
    n_train = n - n_test
    _check_classes(counts, n, n_train, label)
    takes = stored(train_quotas(counts, n_train, n), "quotas")
    cuts = _cuts(df, F.col(label), key, takes, seed, step, broadcast_bytes)
    split = F.when(F.col("_taken"), F.lit("train")).otherwise(F.lit("test"))
    marked = _with_taken(df, label, key, seed, step, cuts, broadcast_bytes)
    return marked.select(*df.columns, split.alias("split"))


def eval_subset(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``min(n, rows)`` rows of a test part; the seed is required, so a run can be repeated."""
    return sample_exact(df, n, seed, key, "eval")


def part(df: DataFrame, split: str, columns: Sequence[str] = ()) -> DataFrame:
    """One part of a split table, without the ``split`` column."""
    rows = df.where(F.col("split") == split).drop("split")
    return rows.select(*columns) if columns else rows
