"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every row is written once with a fingerprint of its text.
2. Each partition sorts its distinct fingerprints and sends every owner, which
   holds one range of them, the differences between neighbours in Golomb-Rice
   code, with a bit for those it has several rows of.
3. An owner merges what it got and answers each partition with a bitmap: which of
   its fingerprints another row has too.
4. Rows with a set bit are suspects. Only they are shuffled, by their whole text,
   so that equality is one of bytes and not of fingerprints.

A partition sends a fingerprint once, however many rows it has of it, and sums
its rows of a text before the shuffle, so a text that a third of all rows share
is one message of each partition.

Defined results: NULL texts equal the empty text and each other. Of equal texts
the row with the largest id stays; a NULL id is smaller than any other. If a row
is there several times with the same id and text, one of them stays, each counts
in ``group_size``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import PART, ROW, UID, Landed
from labelloom.shared import stored, with_group_values

#: Fingerprints that an owner holds, about; it sets the number of owners.
PER_OWNER = 1_000_000

_MESSAGE = "_part int, _owner int, _base bigint, _n int, _k int, _code binary, _several binary"
_REPLY = "_part int, _owner int, _shared binary"


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Whole numbers from 0 in Golomb-Rice code: every value >> k in unary, then the low k bits of each."""
    high = (values >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(high.sum()) + len(values), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    low = (values[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, low.astype(np.uint8).ravel()])).tobytes()


def rice_decode(code: bytes, n: int, k: int) -> np.ndarray:
    """The ``n`` numbers of ``rice_encode``."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    stops = np.flatnonzero(bits == 0)[:n]
    high = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    start = int(stops[-1]) + 1 if n else 0
    low = bits[start : start + n * k].reshape(n, k).astype(np.uint64)
    return (high << np.uint64(k)) | (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def rice_parameter(span: int, n: int) -> int:
    """Bits to send plainly of differences whose mean is ``span / n``."""
    return max(0, int(0.69 * span / max(n, 1)).bit_length() - 1) if span else 0


def _messages(owner_span: int):
    def encode(group: pa.Table) -> pa.Table:
        part = group[PART][0].as_py()
        values, counts = np.unique(group["_print"].to_numpy().astype(np.uint64), return_counts=True)
        owners = values // np.uint64(owner_span)
        firsts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        rows = []
        for first, last in zip(firsts, [*firsts[1:], len(values)]):
            own = values[first:last]
            steps = np.diff(own)
            k = rice_parameter(int(own[-1] - own[0]), len(steps))
            several = np.packbits(counts[first:last] > 1).tobytes()
            rows.append((part, int(owners[first]), int(own[0]), len(own), k, rice_encode(steps, k), several))
        return _table(rows, _MESSAGE)

    return encode


def _replies(group: pa.Table) -> pa.Table:
    messages = group.to_pylist()
    lists = [_decoded(m) for m in messages]
    several = [np.unpackbits(np.frombuffer(m["_several"], np.uint8), count=m["_n"]) for m in messages]
    values, places, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = (counts[places] > 1) | (np.concatenate(several) > 0)
    ends = np.cumsum([len(one) for one in lists])
    rows = [
        (m["_part"], m["_owner"], np.packbits(bits).tobytes())
        for m, bits in zip(messages, np.split(shared, ends[:-1]))
    ]
    return _table(rows, _REPLY)


def _decoded(message: dict) -> np.ndarray:
    steps = rice_decode(message["_code"], message["_n"] - 1, message["_k"])
    return np.cumsum(np.append(np.uint64(message["_base"]), steps), dtype=np.uint64)


def _suspects(owner_span: int):
    def apply(rows: pa.Table, replies: pa.Table) -> pa.Table:
        prints = rows["_print"].to_numpy().astype(np.uint64)
        values, places = np.unique(prints, return_inverse=True)
        owners = values // np.uint64(owner_span)
        bits = {r["_owner"]: r["_shared"] for r in replies.to_pylist()}
        shared = np.zeros(len(values), bool)
        for owner in np.unique(owners):
            own = np.flatnonzero(owners == owner)
            shared[own] = np.unpackbits(np.frombuffer(bits[int(owner)], np.uint8), count=len(own))
        return pa.table({UID: rows[UID].to_numpy()[shared[places]]})

    return apply


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


class ExactGroups:
    """The groups of equal texts of a table."""

    def __init__(
        self, df: DataFrame, key: str = "doc_id", text: str = "text", fingerprint_bits: int = 56
    ) -> None:
        if not 1 <= fingerprint_bits <= 62:
            raise ValueError("fingerprint_bits must be from 1 to 62")
        whole = F.coalesce(F.col(text), F.lit(""))
        extra = {
            "_key": F.col(key),
            "_sha256": F.sha2(whole.cast("binary"), 256),
            "_print": F.shiftrightunsigned(F.xxhash64(whole), 64 - fingerprint_bits),
        }
        self.landed = Landed(df, extra, "exact-rows")
        self.text = F.coalesce(F.col(f"{ROW}.`{text}`"), F.lit(""))
        self.bitmaps = self._exchange(fingerprint_bits)
        self.classes = self._verified()

    def _exchange(self, bits: int) -> DataFrame:
        prints = self.landed.rows.select(UID, PART, "_print")
        owners = max(8, -(-prints.count() // PER_OWNER))
        span = -(-(1 << bits) // owners)
        messages = stored(prints.groupBy(PART).applyInArrow(_messages(span), _MESSAGE), "messages")
        # One group for each owner: about PER_OWNER fingerprints, each at most once a partition.
        replies = messages.groupBy("_owner").applyInArrow(_replies, _REPLY)
        suspects = prints.groupBy(PART).cogroup(stored(replies, "replies").groupBy(PART))
        return self.landed.bitmaps(suspects.applyInArrow(_suspects(span), f"{UID} bigint"))

    def _verified(self) -> DataFrame:
        """Texts that several suspects share: fingerprint, text, rows and the id that stays.

        A fingerprint that stands for several texts is marked.
        """
        suspects = self.landed.marked(self.bitmaps, True).select("_print", self.text.alias("_text"), "_key")
        sums = suspects.groupBy("_print", "_text").agg(
            F.count("*").alias("_rows"), F.max("_key").alias("_keep")
        )
        return stored(sums, "classes")

    def members(self) -> DataFrame:
        """``_uid``, ``_key``, ``_sha256``, ``_keep``, ``_rows`` of every row."""
        columns = [UID, "_key", "_sha256", "_print"]
        alone = self.landed.marked(self.bitmaps, False).select(
            UID, "_key", "_sha256", F.col("_key").alias("_keep"), F.lit(1).cast("bigint").alias("_rows")
        )
        ambiguous = stored(
            self.classes.groupBy(F.col("_print").alias("_group"))
            .agg(F.count("*").alias("_texts"), F.sum("_rows").alias("_rows"))
            .where("_texts > 1")
            .select("_group", "_rows"),
            "ambiguous",
        )
        suspects = self.landed.marked(self.bitmaps, True)
        classes = self.classes.select(F.col("_print").alias("_group"), "_text", "_rows", "_keep")
        if ambiguous.isEmpty():
            joined = with_group_values(suspects.select(*columns), "_print", classes.drop("_text"))
        else:
            # Rare: several texts under one fingerprint. There the text decides, and only there.
            alike = ambiguous.select("_group")
            single = stored(classes.drop("_text").join(alike, "_group", "left_anti"), "single")
            mixed = classes.join(alike, "_group", "left_semi").drop("_group").withColumnRenamed("_text", "_group")
            texts = suspects.select(*columns, self.text.alias("_text"))
            texts = with_group_values(texts, "_print", ambiguous).where("_rows IS NOT NULL").drop("_rows")
            plain = with_group_values(suspects.select(*columns), "_print", single).where("_rows IS NOT NULL")
            by_text = with_group_values(texts, "_text", stored(mixed, "mixed"))
            joined = plain.unionByName(by_text.drop("_text"))
        return alone.unionByName(joined.select(UID, "_key", "_sha256", "_keep", "_rows"))

    def kept(self, members: DataFrame) -> DataFrame:
        """``members`` (stored) plus ``_kept``; rows alike in id and text are told apart by ``_uid``."""
        at_keep = members.where(F.col("_key").eqNullSafe(F.col("_keep")))
        again = (
            at_keep.groupBy(F.col("_sha256").alias("_of"))
            .agg(F.max(UID).alias("_stays"), F.count("*").alias("_n"))
            .where("_n > 1")
        )
        twice = stored(again.select(F.col("_of").alias("_group"), F.col("_n").alias("_rows"), "_stays"), "repeated")
        marked = members.withColumnRenamed("_rows", "_size")
        if twice.isEmpty():
            marked = marked.withColumn("_stays", F.lit(None).cast("bigint"))
        else:
            marked = with_group_values(marked, "_sha256", twice).drop("_rows")
        stays = F.col("_key").eqNullSafe(F.col("_keep")) & (F.coalesce("_stays", UID) == F.col(UID))
        return marked.withColumn("_kept", stays).withColumnRenamed("_size", "_rows")

    def close(self) -> None:
        self.landed.close()


def exact_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", fingerprint_bits: int = 56
) -> DataFrame:
    """One row for each row: ``key``, keep_id, group_size, kept, text_sha256."""
    groups = ExactGroups(df, key, text, fingerprint_bits)
    members = stored(groups.members(), "members")
    groups.close()
    return groups.kept(members).select(
        F.col("_key").alias(key),
        F.col("_keep").alias("keep_id"),
        F.col("_rows").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def drop_exact_copies(
    df: DataFrame, key: str = "doc_id", text: str = "text", fingerprint_bits: int = 56
) -> DataFrame:
    """The rows of ``df`` that stay, with the columns they came with."""
    groups = ExactGroups(df, key, text, fingerprint_bits)
    kept = groups.kept(stored(groups.members(), "members"))
    dropped = groups.landed.bitmaps(kept.where(~F.col("_kept")).select(UID))
    rows = groups.landed.whole(groups.landed.marked(dropped, False))
    groups.close()
    return rows
