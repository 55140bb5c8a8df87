"""Shards: every row once, equal counts, and an order that neither ids nor partitions show in."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

from labelloom.llm import shuffling as sh
from tests.conftest import plan

SCHEMA = "doc_id bigint, text string, shard string, slot string, row string, _hash int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "s", "l", "r", 1) for k, t in rows], SCHEMA)


def check_law(got, n, shards):
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards)) and len(got) == n
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))


def some(n=700):
    draw = random.Random(n)
    rows = [(i, "é" * draw.randint(0, 40)) for i in range(n)]
    return rows + [(None, None), (None, "x"), (3, None), (5, ""), (7, "long " * 50_000), (7, "long " * 50_000)]


@pytest.mark.parametrize("shards, bucket_bytes", [(24, 1 << 27), (3, 2_000), (1, 1 << 20), (24, 20_000)])
def test_law_and_contents(spark, shards, bucket_bytes):
    rows = some()
    got = sh.shuffle_into_shards(documents(spark, rows), shards=shards, bucket_bytes=bucket_bytes).collect()
    check_law(got, len(rows), shards)
    assert Counter((r.row.doc_id, r.row.text, r.row.shard) for r in got) == Counter((k, t, "s") for k, t in rows)


@pytest.mark.parametrize("n", [0, 1, 5, 24])
def test_fewer_rows_than_shards(spark, n):
    got = sh.shuffle_into_shards(documents(spark, some()[:n])).collect()
    check_law(got, n, 24)


def order(got):
    return [(r.row.doc_id, r.row.text) for r in sorted(got, key=lambda r: (r.shard, r.slot))]


def test_same_shards_however_partitioned(spark):
    df = documents(spark, some())
    one, other = (order(sh.shuffle_into_shards(df.repartition(p), shards=5).collect()) for p in (1, 9))
    assert one == other
    assert order(sh.shuffle_into_shards(df, shards=5, seed=1).collect()) != one
    assert one != sorted(one, key=str)


def test_a_crowd_of_equal_rows_is_scattered(spark):
    rows = [(1, "same")] * 4000 + [(i, "other") for i in range(2000)]
    df = documents(spark, rows)
    got = sh.shuffle_into_shards(df, shards=8, least_crowd=50).collect()
    check_law(got, 6000, 8)
    per_shard = Counter(r.shard for r in got if r.row.text == "same")
    assert all(400 < per_shard[s] < 600 for s in range(8))
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter(rows)


def test_the_order_is_random(spark):
    """Neighbours by id are in no order, and every place is as likely: chi-square over shards by id range."""
    df = spark.range(24_000).selectExpr("id AS doc_id", "'t' AS text")
    got = sh.shuffle_into_shards(df).collect()
    cells = Counter((r.row.doc_id // 1000, r.shard) for r in got)
    expected = 1000 / 24
    chi = sum((cells[a, b] - expected) ** 2 / expected for a in range(24) for b in range(24))
    assert chi < 529 + 5 * (2 * 529) ** 0.5
    ids = [r.row.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(ids, ids[1:]))
    assert abs(rising - 12_000) < 400
    fixed = sum(a // 1000 == b // 1000 for a, b in zip(ids, ids[1:]))
    assert fixed < 1200


def test_files_are_shards_in_order(spark, tmp_path):
    path = str(tmp_path / "shards")
    sh.shuffle_into_shards(documents(spark, some()), shards=4, path=path)
    assert {f for f in os.listdir(path) if "=" in f} == {f"shard={i}" for i in range(4)}
    for shard in range(4):
        folder = f"{path}/shard={shard}"
        slots = []
        for name in sorted(f for f in os.listdir(folder) if f.endswith(".parquet")):
            slots += [r.slot for r in spark.read.parquet(f"{folder}/{name}").collect()]
        assert slots == list(range(len(slots)))


def test_records_move_once(spark):
    """One exchange of whole records, by bucket, and nothing in Python."""
    text = plan(sh.shuffled(documents(spark, some(50))))
    moving = [line for line in text.splitlines() if "Exchange" in line]
    assert sum("shufflepartitionidpassthrough" in line for line in moving) == 2  # records, permutations
    assert sum("hashpartitioning" in line or "rangepartitioning" in line for line in moving) == 0
    assert "Python" not in text and "InArrow" not in text
