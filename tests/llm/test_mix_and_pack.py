"""Mixing and packing against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.llm import mixing as mx
from labelloom.llm import packing as pk
from labelloom.llm.common import running_totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def brute_targets(sizes):
    """Targets by source, each round sharing what the limits have set free."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in sources if s not in full]
        unit = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * unit for s in sources}
        full |= over


def test_running_totals_over_a_hot_group(spark):
    rows = [(g, i, random.Random(i).randint(0, 9)) for i, g in enumerate(["hot"] * 3000 + [None] * 7 + ["b", "é"] * 3)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {(r.g, r.i): r.t for r in running_totals(df, "g", ["i"], "v", "t").collect()}
    sums: dict = {}
    for g, i, v in rows:
        assert got[g, i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v


SCHEMA = "doc_id bigint, text string, source string, taken string, target string, n_chars int"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, s, "t", "u", len(t or "")) for k, t, s in rows], SCHEMA)


def sample_rows():
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 300) + "end", draw.choice(["a", "b", "Z", "é", "hot", "hot", "hot"])) for i in range(300)]
    rows += [(1000, "w " * 40, None), (1001, None, "a"), (1002, " \n", "void"), (1003, "tiny", "ab"), (1003, "tiny", "ab")]
    return rows + [(1004, "long " * 20_000, "long"), (None, "no id here", "a")]


@pytest.mark.parametrize("block", [64, 100_000])
def test_targets_and_shares(spark, block):
    rows = sample_rows()
    df = documents(spark, rows)
    got = mx.mix_plan(df.repartition(5), block=block).collect()
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets = brute_targets(sizes)
    assert len(got) == len(rows)
    taken: dict = {}
    for row in got:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(targets[row.source], abs=1e-6)
        assert 0 <= row.taken <= 3 * row.size
        taken[row.source] = taken.get(row.source, 0) + row.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mx.mix_plan(df.repartition(2), block=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_every_stretch_of_the_schedule_has_the_shares(spark):
    sizes = {"a": 60_000, "b": 60_000, "c": 60_000}
    rows = [(i, "w " * 600, s) for i, s in enumerate(s for s in sizes for _ in range(100))]
    df = documents(spark, rows).select(
        F.col("doc_id").alias("_key"), F.col("source").alias("_source"), F.lit(600).cast("bigint").alias("_size"),
        F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_uid"),
    )
    mix = mx.Mix(mx.stored(df, "rows"), block=300)
    source = {i: s for i, _, s in rows}
    slots = sorted({(r.slot, source[r._uid]) for r in mix.schedule.collect()})
    share = {s: t / 180_000 for s, t in brute_targets(sizes).items()}
    order = [s for _, s in slots]
    for start in range(0, len(order) - 100, 37):
        some = order[start : start + 100]
        assert all(abs(some.count(s) - 100 * share[s]) <= 4 for s in sizes)


def test_mixed_rows(spark):
    rows = sample_rows()
    df = documents(spark, rows)
    plan = mx.mix_plan(df).collect()
    out = mx.mixed_rows(df, length="n_chars")
    assert out.columns == df.columns
    got = out.collect()
    texts: dict = {}
    for key, text, _ in rows:
        texts.setdefault(key, []).append(text)
    words: dict = {}
    for row in got:
        words[row.source] = words.get(row.source, 0) + size(row.text)
        whole = [t for t in texts[row.doc_id] if (t or "").startswith(row.text or "")]
        assert whole and row.n_chars == len(row.text or "")
    for source in words:
        assert words[source] == sum(r.taken for r in plan if r.source == source)
    assert sum(row.doc_id in (1001, 1002) for row in got) == 2
    cut = [row for row in got if row.text not in texts[row.doc_id]]
    assert len(cut) <= len(words)


def test_empty_mix_and_pack(spark):
    df = documents(spark, [])
    assert mx.mix_plan(df).collect() == [] and mx.mixed_rows(df).collect() == [] and pk.pack(df).collect() == []
    void = documents(spark, [(1, None, None), (2, "", "a")])
    assert [(r.taken, r.target) for r in mx.mix_plan(void).collect()] == [(0, 0.0)] * 2
    assert mx.mixed_rows(void).count() == 2


def test_cutting_keeps_the_text_before(spark):
    df = spark.createDataFrame([("  a\tb  c ", 2), ("x", 1), (None, 1), ("y", None)], "t string, n int")
    got = [r[0] for r in df.select(mx.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["  a\tb", "x", None, None]


COSTS = pk.sequence_costs((8, 16, 32))


def brute_opening(one, later, costs):
    """The length whose bin, filled up from the pieces to come, costs least for each word."""
    prices = []
    for length in costs:
        held = one
        for other in later if length >= one else ():
            held += other if held + other <= length else 0
        if length >= one:
            prices.append((min(costs[n] for n in costs if n >= held) / held, -length))
    return -min(prices)[1]


def brute_best_fit(sizes, costs, preferred):
    bins = []
    for at, one in enumerate(sizes):
        fits = [b for b in bins if b[0] - sum(b[1]) >= one]
        if fits:
            min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(one)
        else:
            if preferred is None:
                room = brute_opening(one, sizes[at + 1 :], costs)
            elif preferred >= one:
                room = preferred
            else:
                room = min((n for n in costs if n >= one), key=lambda n: (costs[n] / n, -n))
            bins.append((room, [one]))
    return sum(costs[min(n for n in costs if n >= sum(b[1]))] for b in bins)


@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([None, 8, 16, 32]))
def test_best_fit(sizes, preferred):
    sizes = sorted(sizes, reverse=True)
    places, capacities, cost = pk.best_fit(sizes, COSTS, preferred)
    used = [0] * len(capacities)
    for place, one in zip(places, sizes):
        used[place] += one
    assert all(0 < u <= c and not any(u <= n < c for n in COSTS) for u, c in zip(used, capacities))
    assert cost == pytest.approx(brute_best_fit(sizes, COSTS, preferred))


@pytest.mark.parametrize("shard_pieces", [20, 20_000])
def test_packed_documents(spark, shard_pieces):
    draw = random.Random(5)
    rows = [(i, "w " * draw.choice([0, 1, 3, 7, 8, 9, 31, 32, 33, 100]), "s") for i in range(200)]
    rows += [(None, "no id", "s"), (7, "twice here", "s"), (7, "twice here", "s"), (8, None, "s"), (9, "w " * 5000, "s")]
    got = pk.pack(documents(spark, rows).repartition(4), lengths=(8, 16, 32), shard_pieces=shard_pieces).collect()
    spans: dict = {}
    bins: dict = {}
    for row in got:
        spans.setdefault(row.doc_id, []).append((row.word, row.words))
        if row.words:
            bins.setdefault((row.sequence, row.capacity), []).append((row.position, row.words))
        else:
            assert row.sequence is row.capacity is row.position is None
    want: dict = {}
    for key, text, _ in rows:
        n = size(text)
        want.setdefault(key, []).extend((at, min(32, n - at)) for at in range(0, n, 32))
        want[key] += [(0, 0)] if not n else []
    assert {k: sorted(v) for k, v in spans.items()} == {k: sorted(v) for k, v in want.items()}
    assert len({sequence for sequence, _ in bins}) == len(bins)
    for (_, capacity), pieces in bins.items():
        at = 0
        for position, words in sorted(pieces):
            assert position == at
            at += words
        assert at <= capacity == min(n for n in (8, 16, 32) if n >= at)


def test_lengths_together_cost_no_more_than_any_alone(spark):
    rows = [(i, "w " * random.Random(i).randint(1, 1500), "s") for i in range(400)]
    df = documents(spark, rows)
    costs = pk.sequence_costs(pk.LENGTHS)

    def cost(lengths):
        bins = pk.pack(df, lengths=lengths).select("sequence", "capacity").distinct().collect()
        return sum(costs[b.capacity] for b in bins)

    assert cost(pk.LENGTHS) <= min(cost((2048,)), cost((4096,)))


def test_slots_come_from_the_schedule(spark, monkeypatch):
    """Documents lie in the slots of their source's blocks; with another schedule the plan is another one."""
    df = documents(spark, sample_rows())
    got = mx.mix_plan(df, block=64).collect()
    slots = {(r.doc_id, r.source): (r.first_slot, r.last_slot) for r in got}
    for r in got:
        assert (r.first_slot is None) == (r.taken == 0)
        if r.taken:
            assert 0 <= r.first_slot <= r.last_slot
    real = mx._slots

    def one_source_after_the_other(targets, block):
        scheduled, n = real(targets, block)
        place = F.expr("ROW_NUMBER() OVER (ORDER BY _number, _block) - 1")
        return scheduled.select(place.cast("bigint").alias("slot"), "_number", "_block"), n

    monkeypatch.setattr(mx, "_slots", one_source_after_the_other)
    other = {(r.doc_id, r.source): (r.first_slot, r.last_slot) for r in mx.mix_plan(df, block=64).collect()}
    assert slots != other


def test_mixed_rows_are_in_schedule_order(spark, tmp_path):
    """Every stretch of the written rows has its sources near their shares, though the table came sorted by source."""
    draw = random.Random(8)
    rows = [(i, "w " * draw.randint(5, 60), "abc"[i // 2000]) for i in range(6000)]
    mixed = mx.mixed_rows(documents(spark, rows).coalesce(1), block=64)
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    names = sorted(name for name in __import__("os").listdir(path) if name.endswith(".parquet"))
    found = [(r.source, size(r.text)) for name in names for r in spark.read.parquet(f"{path}/{name}").collect()]
    total = sum(n for _, n in found)
    shares = {s: sum(n for own, n in found if own == s) / total for s in "abc"}
    assert len(found) > 5000 and max(shares.values()) < 0.7
    for start in range(0, len(found) - 1000, 500):
        stretch = found[start : start + 1000]
        words = sum(n for _, n in stretch)
        for source in "abc":
            assert abs(sum(n for own, n in stretch if own == source) / words - shares[source]) < 0.05


def test_one_packing_opens_bins_of_several_lengths():
    """No single length opened by preference does as well as a choice for each bin."""
    costs = pk.sequence_costs((8, 16, 32), 1 / 64)
    sizes = [20, 20, 12, 12] + [5] * 3 + [3] * 3 + [8] * 4
    sizes.sort(reverse=True)
    alone = [pk.best_fit(sizes, costs, n)[2] for n in costs]
    _, capacities, cost = pk.best_fit(sizes, costs)
    assert len(set(capacities)) > 1 and cost <= min(alone)


def test_sequences_do_not_depend_on_partitions(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, "w " * draw.choice([0, 1, 3, 7, 9, 31, 33, 100]), "s") for i in range(200)]
    rows += [(7, "twice here", "s")] * 90 + [(None, "no id", "s")] * 3 + [(8, "w " * 70, "s"), (8, "w " * 7, "s")]
    df = documents(spark, rows)

    def packed(df):
        return sorted(map(str, pk.pack(df, lengths=(8, 16, 32), shard_pieces=50).collect()))

    once = packed(df.coalesce(1))
    assert packed(df.orderBy("text").repartition(5)) == once
    monkeypatch.setattr(pk, "_COPIES", 16)
    assert packed(df.repartition(3)) == once
