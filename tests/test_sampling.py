from __future__ import annotations

import hashlib
import math
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelloom.operators import sampling as sm
from labelloom.shared import clean_up, measured, run_folder, stored, with_group_values
from tests.conftest import plan


def ordered(keys, seed, step="sample"):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{step}:{k}".encode()).hexdigest(), k))


def split_by_hand(rows, test_size, seed):
    """{key: part} by largest remainders, in plain Python."""
    classes = {}
    for key, label in rows:
        classes.setdefault(label, []).append(key)
    n = len(rows)
    n_train = n - math.ceil(test_size * n)
    quota = {c: len(k) * n_train // n for c, k in classes.items()}
    rest = sorted(classes, key=lambda c: (-(len(classes[c]) * n_train % n), c))
    for c in rest[: n_train - sum(quota.values())]:
        quota[c] += 1
    parts = {}
    for c, keys in classes.items():
        for rank, key in enumerate(ordered(keys, seed, "split")):
            parts[key] = "train" if rank < quota[c] else "test"
    return parts


def skewed(n):
    """Two thirds of all rows in one class, the others in nineteen."""
    return [(k, 0 if k % 3 else 1 + k // 3 % 19) for k in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(skewed(4000), "key bigint, label int").repartition(7)


@pytest.mark.parametrize("n", [1, 17, 3999, 4000, 9000])
def test_sample_is_exact(table, n):
    got = sorted(r.key for r in sm.sample_exact(table, n, 5, "key").collect())
    assert got == sorted(ordered(range(4000), 5)[:n])


def test_sample_without_size_is_the_table(table):
    assert sm.sample_exact(table, None, 5, "key") is table
    assert sm.sample_exact(table, 0, 5, "key") is table


def test_sample_does_not_depend_on_partitioning(table):
    one = {r.key for r in sm.sample_exact(table.coalesce(1), 300, 9, "key").collect()}
    many = {r.key for r in sm.sample_exact(table.repartition(31), 300, 9, "key").collect()}
    other = {r.key for r in sm.sample_exact(table, 300, 10, "key").collect()}
    assert one == many and one != other


def test_text_keys(spark):
    keys = [f"file_{i}" for i in range(500)]
    rows = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key for r in sm.sample_exact(rows, 100, 3, "key").collect()}
    assert got == set(ordered(keys, 3)[:100])


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_split_equals_the_one_by_hand(table, broadcast_bytes):
    got = sm.stratified_split(table, 0.23, 42, "label", "key", broadcast_bytes)
    assert {r.key: r.split for r in got.collect()} == split_by_hand(skewed(4000), 0.23, 42)


def test_split_properties(table):
    got = sm.stratified_split(table, 0.2, 1, "label", "key").collect()
    assert sorted(r.key for r in got) == list(range(4000))
    assert sum(r.split == "test" for r in got) == 800
    for label in {r.label for r in got}:
        rows = [r for r in got if r.label == label]
        assert abs(sum(r.split == "train" for r in rows) - 0.8 * len(rows)) < 1


def test_split_with_a_row_count(table):
    sizes = sm.stratified_split(table, 100, 1, "label", "key").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in sizes} == {"train": 3900, "test": 100}


def test_split_keeps_rows_without_a_label(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else 1) for k in range(40)], "key int, label int")
    got = sm.stratified_split(rows, 0.25, 1, "label", "key").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {
        (1, "train"): 15, (1, "test"): 5, (None, "train"): 15, (None, "test"): 5,
    }


def test_split_errors(spark):
    single = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "key int, label string")
    with pytest.raises(ValueError, match=r"fewer than 2 rows.*'b'"):
        sm.stratified_split(single, 0.5, 1, "label", "key")
    pairs = spark.createDataFrame([(i, i // 2) for i in range(10)], "key int, label int")
    with pytest.raises(ValueError, match="1 test rows cannot hold 5 classes"):
        sm.stratified_split(pairs, 0.1, 1, "label", "key")
    with pytest.raises(ValueError, match="1 train rows cannot hold 5 classes"):
        sm.stratified_split(pairs, 0.9, 1, "label", "key")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_cap(table, broadcast_bytes):
    got = sm.cap_per_class(table, 800, "label", 4, "key", 20, broadcast_bytes).collect()
    rows = skewed(4000)
    expected = set()
    for label in range(20):
        expected |= set(ordered([k for k, c in rows if c == label], 4, "cap")[:40])
    assert {r.key for r in got} == expected and len(got) == len(expected)


def test_cap_acts_only_on_larger_tables(table):
    assert sm.cap_per_class(table, 4000, "label", 4, "key") is table
    assert sm.cap_per_class(table, 5, "label", 4, "key").count() == 0


def test_eval_subset_and_preview(table):
    assert sm.eval_subset(table, 50, 2, "key").count() == 50
    assert [r.key for r in sm.preview(table, "key").orderBy("key").collect()] == [0, 1, 2, 3, 4]


def test_the_evaluation_subset_is_a_sample_of_the_test_part(spark):
    """At a size where rows next to the cut would all be of one class."""
    rows = spark.range(200_000).select(F.col("id").alias("key"), (F.col("id") % 9).alias("label"))
    test = sm.part(sm.stratified_split(rows, 0.2, 42, "label", "key"), "test")
    shares = {r.label: r["count"] for r in sm.eval_subset(test, 900, 42, "key").groupBy("label").count().collect()}
    assert len(shares) == 9
    # 100 rows a class are expected; five standard deviations are 47.
    assert all(abs(n - 100) <= 47 for n in shares.values())


def test_repeated_keys_end_the_query(spark):
    rows = spark.createDataFrame([(1,)] * 7 + [(2,)] * 3, "key int")
    with pytest.raises(PySparkException, match="key is not unique"):
        sm.sample_exact(rows, 3, 5, "key").collect()
    assert sm.preview(rows, "key").count() == 5


def test_windows_are_narrow_and_hold_the_cut(spark):
    takes = [(0, 10**12, 10**6), (1, 10**12, 8 * 10**11), (2, 10**9, 10**9), (3, 50, 20), (4, 7, 0)]
    df = spark.createDataFrame(takes, "_group int, _rows bigint, _take bigint")
    got = {r._group: r for r in sm.windows(df, 8.0).collect()}
    assert set(got) == {0, 1, 2, 3}

    def place(edge):
        return 0 if edge == "" else 1 if edge == "g" else int(edge, 16) / 16**12

    for group, rows, take in takes[:4]:
        low, high = place(got[group]._low), place(got[group]._high)
        assert low <= take / rows <= high
        assert (high - low) * rows <= 16 * (math.sqrt(take * (1 - take / rows)) + 1) + 1
    assert (got[3]._low, got[3]._high) == ("", "g")


@pytest.mark.parametrize("width", [0.001, 0.5, math.inf])
def test_cuts_outside_their_windows_are_found(spark, monkeypatch, width):
    rows = spark.createDataFrame(skewed(2000), "key bigint, label int")
    want = {r.key for r in sm.sample_exact(rows, 300, 9, "key").collect()}
    split = {r.key: r.split for r in sm.stratified_split(rows, 0.23, 42, "label", "key").collect()}
    monkeypatch.setattr(sm, "_WIDTH", width)
    assert {r.key for r in sm.sample_exact(rows, 300, 9, "key").collect()} == want
    assert {r.key: r.split for r in sm.stratified_split(rows, 0.23, 42, "label", "key").collect()} == split


def test_no_row_is_kept_for_each_row(spark, monkeypatch):
    """What sampling and splitting write is far smaller than the table."""
    rows = spark.range(300_000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("label"))
    written = []

    def counted(df, name, figures=None):
        table = stored(df, name)
        written.append((name, table.count()))
        return table if figures is None else (table, table.agg(*figures).first())

    monkeypatch.setattr(sm, "stored", counted)
    monkeypatch.setattr(sm, "stored_with_figures", counted)
    sm.sample_exact(rows, 1000, 1, "key")
    sm.stratified_split(rows, 0.2, 1, "label", "key")
    assert max(n for _, n in written) <= 3
    near = sm.windows(spark.createDataFrame([(0, 300_000, 1000)], "_group int, _rows bigint, _take bigint"), 8.0).first()
    inside = rows.select(F.substring(sm.seeded_hash(F.col("key"), 1, "sample"), 1, 12).alias("h"))
    assert inside.where((F.col("h") >= near._low) & (F.col("h") < near._high)).count() < 600


def test_no_window_over_all_classes(spark):
    counts = stored(spark.range(1000).select(F.col("id").alias("_group"), (F.col("id") % 7 + 2).alias("_rows")), "counts")
    quotas = sm.train_quotas(counts, 3000, counts.agg(F.sum("_rows")).first()[0])
    assert quotas.agg(F.sum("_take")).first()[0] == 3000


def test_intermediate_tables_share_one_folder(spark):
    folder = run_folder(spark).removeprefix("file:").strip("/")
    table = stored(spark.range(5), "test")
    assert all(path.removeprefix("file:").strip("/").startswith(folder) for path in table.inputFiles())


def test_clean_up_removes_the_folder(spark):
    folder = run_folder(spark)
    stored(spark.range(5), "test")
    clean_up(spark)
    assert not os.path.exists(folder.removeprefix("file:")) and run_folder(spark) != folder


def test_quotas_do_not_overflow(spark):
    rows = 40_000_000_000
    counts = spark.createDataFrame([(0, rows), (1, rows // 2), (2, 7)], "_group int, _rows bigint")
    n = rows + rows // 2 + 7
    n_train = n - math.ceil(0.2 * n)
    got = {r._group: r._take for r in sm.train_quotas(counts, n_train, n).collect()}
    assert sum(got.values()) == n_train
    for group, size in ((0, rows), (1, rows // 2), (2, 7)):
        assert abs(got[group] * n - size * n_train) < n


def test_group_values_beyond_the_broadcast_bound(spark):
    """A hot group is broadcast by itself, the many small ones are shuffled; no row is lost."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"))
    sizes = rows.groupBy(F.col("g").alias("_group")).agg(F.count("*").alias("_rows"))
    table = stored(sizes.withColumn("double", F.col("_group") * 2), "test")
    joined = with_group_values(rows, "g", table, broadcast_bytes=0)
    wrong, total = joined.agg(F.count_if(F.col("double") != F.col("g") * 2), F.count("double")).first()
    assert (wrong, total) == (0, 60_000)
    assert measured(table)[1] == 60_000


def test_wide_hot_groups_are_salted(spark):
    """Groups of 200 kB, one of them with most rows, beyond any bound: nothing of that size is broadcast."""
    wide = F.repeat(F.lit("x"), 200_000)
    own = F.when(F.col("id") % 4 != 0, 0).when(F.col("id") % 8 == 0, None).otherwise(F.col("id") % 50)
    rows = spark.range(2000).select("id", F.concat(wide, own.cast("string")).alias("g"))
    sizes = rows.groupBy(F.col("g").alias("_group")).agg(F.count("*").alias("_rows"))
    table = stored(sizes.withColumn("size", F.col("_rows") * 2), "test")
    joined = with_group_values(rows, "g", table, broadcast_bytes=1000)
    got = {r.id: (r._rows, r.size) for r in joined.select("id", "_rows", "size").collect()}
    counts = {}
    for i in range(2000):
        key = 0 if i % 4 else None if i % 8 == 0 else i % 50
        counts[key] = counts.get(key, 0) + 1
    assert len(got) == 2000
    for i in range(2000):
        n = counts[0 if i % 4 else None if i % 8 == 0 else i % 50]
        assert got[i] == (n, 2 * n)
    text = plan(joined)
    broadcasts = [line for line in text.splitlines() if "BroadcastExchange" in line]
    assert all("bigint" in line for line in broadcasts)  # hashes alone


def test_rows_are_never_sorted_or_shuffled(table):
    for df in (
        sm.sample_exact(table, 100, 1, "key"),
        sm.cap_per_class(table, 800, "label", 1, "key", 20),
        sm.stratified_split(table, 0.2, 1, "label", "key"),
    ):
        text = plan(df)
        assert "Sort" not in text and "Window" not in text
        assert text.count("Exchange") - text.count("BroadcastExchange") <= 1  # the fixture's own
