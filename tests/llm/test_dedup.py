"""Exact and near duplicates against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.llm import common
from labelloom.llm import exact_dedup as ed
from labelloom.llm import simhash as sh
from tests.conftest import plan

SCHEMA = "doc_id bigint, text string, keep_id string, _uid string"


def brute_exact(rows):
    groups: dict[str, list] = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    return groups


@given(st.lists(st.integers(0, 2**40), max_size=60), st.integers(0, 41))
def test_rice_round_trip(values, k):
    values = np.array(values, np.uint64)
    # No shorter parameter than the values' size allows, or the unary part grows without end.
    k = max(k, 30)
    assert (ed.rice_decode(ed.rice_encode(values, k), len(values), k) == values).all()


@pytest.mark.parametrize("bits", [56, 3])
def test_exact_groups(spark, bits):
    random.seed(bits)
    rows = [(i, random.choice(["a", "b", "c " * 9000, "", None, f"own {i}", " a"])) for i in range(400)]
    rows += [(7, "same row")] * 3 + [(None, "a"), (None, "alone"), (None, "alone")]
    random.shuffle(rows)
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(5)
    got = ed.exact_groups(df, fingerprint_bits=bits).collect()
    assert len(got) == len(rows)
    for text, keys in brute_exact(rows).items():
        digest = __import__("hashlib").sha256(text.encode()).hexdigest()
        own = [row for row in got if row.text_sha256 == digest]
        known = [key for key in keys if key is not None]
        keep = max(known) if known else None
        assert len(own) == len(keys)
        assert {(row.keep_id, row.group_size) for row in own} == {(keep, len(keys))}
        assert [row.doc_id for row in own if row.kept] == [keep]
    kept = ed.drop_exact_copies(df, fingerprint_bits=bits)
    assert kept.columns == df.columns
    assert sorted(row.text or "" for row in kept.collect()) == sorted(brute_exact(rows))


def test_no_shuffle_by_text_where_fingerprints_clash(spark):
    texts = [f"text {i % 60}" if i % 3 else "same" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    groups = ed.ExactGroups(df, fingerprint_bits=5)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        members = groups.members()
        assert not re.search(r"hashpartitioning\([^)]*_text#", plan(members))
    finally:
        spark.conf.set(threshold, before)
    brute = brute_exact(enumerate(texts))
    assert sorted((r._key, r._keep, r._rows) for r in members.collect()) == sorted(
        (key, max(brute[text]), len(brute[text])) for key, text in enumerate(texts)
    )
    groups.close()


def test_large_group_is_one_message_of_each_partition(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = ed.exact_groups(df.unionByName(spark.createDataFrame([(-1, "other")], "doc_id bigint, text string")))
    assert sorted(map(tuple, got.groupBy("keep_id", "group_size", "kept").count().collect())) == [
        (-1, 1, True, 1),
        (29_999, 30_000, False, 29_999),
        (29_999, 30_000, True, 1),
    ]


def test_buckets_grow_with_the_input(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text")).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    df, least = spark.read.parquet(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.bucket_count(df) == max(8, least)
    assert 40 <= common.bucket_count(df, size // 40) <= 41
    assert common.bucket_count(df.join(df.withColumnRenamed("text", "t"), "doc_id"), size // 40) <= 82
    assert common.bucket_count(df, 1) == 100_000
    assert common.bucket_count(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), 1) <= 100_000
    monkeypatch.setattr(common.bucket_count, "__defaults__", (size // 40,))
    landed = common.Landed(df, {}, "many-buckets")
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {landed.table}").collect()}
    assert 40 <= int(described["Num Buckets"]) <= 41
    assert landed.whole(landed.rows).count() == 20_000
    landed.close()
    assert ed.drop_exact_copies(df).count() == 20_000


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ed.exact_groups(df).collect() == [] and ed.drop_exact_copies(df).collect() == []
    assert sh.near_duplicates(df).collect() == [] and sh.drop_near_copies(df).collect() == []


def brute_print(text, size=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(one.encode(), 42) for one in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aBÉ \t\n\x0b\u00a0é", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text) == brute_print(text)


def brute_components(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near(random_, n, flips):
    base = [random_.getrandbits(64) for _ in range(n)]
    out = list(base)
    for one in base:
        for _ in range(4):
            for _ in range(random_.randint(1, flips)):
                one ^= 1 << random_.randrange(64)
            out.append(one)
    return list(dict.fromkeys(out))


def signed(value):
    return value - 2**64 if value >= 2**63 else value


@pytest.mark.parametrize("distance, most", [(4, 20_000), (4, 6), (0, 20_000), (1, 20_000), (7, 20_000)])
def test_no_link_is_lost(spark, distance, most):
    prints = near(random.Random(distance + most), 60, max(distance, 1) + 1)
    # Many around one point, so that anchors are crowded.
    centre = random.Random(1).getrandbits(64)
    prints += [p for p in {centre ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(8)} if p not in prints]
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = sh.links(df, distance, most).collect()
    place = {signed(p): i for i, p in enumerate(prints)}
    assert all((prints[place[a]] ^ prints[place[b]]).bit_count() <= distance for a, b in edges)
    got = spark.createDataFrame([(place[a], place[b]) for a, b in edges], "a bigint, b bigint")
    roots = {row.node: row.root for row in sh.components(got).collect()}
    assert [roots.get(i, i) for i in range(len(prints))] == brute_components(prints, distance)


def test_every_word_has_an_anchor_within_one_bit():
    patterns, starts = sh.error_patterns(1)
    assert (np.diff(starts) >= 1).all() and np.bitwise_count(patterns).max() == 1


def test_long_chain_is_one_component(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = sh.components(edges).select("root").distinct().collect()
    assert [row.root for row in roots] == [0]
    assert sh.components(edges).count() == 501


def test_near_duplicates_of_texts(spark):
    words = [f"w{i}" for i in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    rows = [
        (5, " ".join(words)),
        (3, " ".join(changed)),
        (9, "  ".join(words).upper()),
        (4, " ".join(reversed(words))),
        (8, None),
        (6, ""),
        (7, " \n "),
        (2, "two words"),
        (2, "two words"),
        (1, "x " * 50_000),
    ]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id bigint, text string, fp string, root string")
    got = sh.near_duplicates(df.repartition(4)).collect()
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, 4)
    least = {r: min(k for (k, _), q in zip(rows, roots) if q == r) for r in roots}
    want = sorted((k, f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, got)) == want
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted(set(least.values()))


def test_null_keys_stay_apart(spark):
    rows = [(None, "one two three four five"), (None, "something quite different altogether here"), (None, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sh.drop_near_copies(df).count() == 2


def test_near_duplicate_query(spark):
    from labelloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints, 4)
    least = {r: min(k for (k, _), q in zip(rows, roots) if q == r) for r in roots}
    want = sorted((k, f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, QUERIES["op7_simhash_dedup"](spark, sf).collect())) == want
