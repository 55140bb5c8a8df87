"""Exact top k by inner product: sorted lists read without random access.

Candidates are kept in blocks. Of each block and dimension there is a list of the
components in order, with the rows they belong to. A query reads the lists of all
dimensions in step, from the end where its own component makes the products
largest. What was read of a candidate, and what is at most or at least left in
the lists it was not met in, give bounds of its score. Once no candidate that was
never met, and none of those met, can pass the k-th best lower bound, reading
stops; those that may still qualify get their final scores. No block is read
without a bar: a task first scores some rows spread over its blocks, the scouts,
and the k-th best of them is a lower bound of the k-th best of all. From block to
block it carries the k-th best score found, so later blocks are read less far.

Queries come in blocks as well, and every block of queries meets every group of
candidate blocks once, in a task of its own.

Components become floor(scale * x). Defined results: vectors that are NULL, or
hold NULL or a number that is not finite, and rows without an id, take no part;
shorter vectors are filled up with 0, and any length is read whole; every row is a
candidate for every other one, rows alike in id and vector too, and each row that
asks has its own result; ties go to the smaller id; fewer candidates than k give
fewer rows, and an empty table none. Other columns are not read, whatever their
names. Scores beyond 64 bits end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.shared import stored

CANDIDATES = 4_096
QUERIES = 8_192
GROUP = 8
SCALE = 256

_BLOCK = "block int, rows binary, ids binary, vectors binary"
_FOUND = "_query bigint, query_id bigint, vec_id bigint, score bigint"


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``_id``, ``_vector`` (array of bigint) of the rows that take part."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    whole = F.transform(parts, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    return rows.select(F.col(key).cast("bigint").alias("_id"), whole.alias("_vector"))


def _blocked(dims: int):
    """Rows of one block as three byte strings: row numbers, ids, and vectors row by row."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_id", "ascending"), ("_row", "ascending")])
        vectors = np.zeros((len(group), dims), np.int64)
        for i, one in enumerate(group["_vector"].to_pylist()):
            vectors[i, : len(one)] = one
        return pa.table(
            {
                "block": group["_block"][:1].cast(pa.int32()),
                "rows": pa.array([group["_row"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "ids": pa.array([group["_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
            }
        )

    return pack


def _in_blocks(rows: DataFrame, size: int, dims: int, name: str) -> tuple[DataFrame, int]:
    n = rows.count()
    blocks = max(1, -(-n // size))
    numbered = rows.select("*", F.pmod(F.xxhash64("_id", "_row"), F.lit(blocks)).cast("int").alias("_block"))
    return stored(numbered.groupBy("_block").applyInArrow(_blocked(dims), _BLOCK), name), blocks


#: Largest score up to which sums of products are exact in double precision.
_EXACT = 1 << 53
_CHECKS = 32
#: Rows of a task's blocks whose scores give the first bar, and queries scored with them at a time.
_SCOUTS = 1_024
_AT_ONCE = 256


class SortedLists:
    """The lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.ids, self.vectors = ids, vectors
        self.rows = ids if rows is None else rows  # what tells candidates apart
        self.numbers = vectors.astype(np.float64)
        self.order = np.argsort(vectors, axis=0, kind="stable")  # per dimension, smallest first
        self.sorted = np.take_along_axis(self.numbers, self.order, axis=0)
        depths = np.ceil(np.linspace(0, len(vectors), _CHECKS + 1)[1:]).astype(int)
        self.checks = np.unique(depths[depths > 0])
        self.depths: list[int] = []  # how far each query read

    def _read(self, lists: np.ndarray, down: np.ndarray, upto: int) -> np.ndarray:
        """The first ``upto`` entries of every list, from the end that suits the query."""
        return np.where(down, lists[::-1][:upto], lists[:upto])

    def search(self, query: np.ndarray, k: int, passed: int | None, skip: int) -> np.ndarray:
        """Places of the candidates that may be among the ``k`` best, the row ``skip`` being none.

        ``passed`` is a score that the k-th best of all cannot lie below. Equal bounds
        stay in: ids decide at the end.
        """
        n = len(self.ids)
        alive = self.rows != skip
        down = query > 0
        # The product that reading has come to in each list, at some depths.
        edges = np.where(down, self.sorted[::-1][self.checks - 1], self.sorted[self.checks - 1]) * query
        if passed is not None:
            # The bound of an outsider, met in no list yet, is the sum of the edges.
            bar = passed
            at = int(np.argmax(edges.sum(axis=1) < bar)) if (edges.sum(axis=1) < bar).any() else len(edges) - 1
        else:
            at, bar = self._first_bar(query, k, alive, down, edges)
        depth = int(self.checks[at]) if n else 0
        self.depths.append(depth)
        if depth == n:
            return np.flatnonzero(alive)
        places = self._read(self.order, down, depth).ravel()
        gained = self._read(self.sorted, down, depth) * query - edges[at]
        upper = edges[at].sum() + np.bincount(places, gained.ravel(), n)
        return np.flatnonzero(alive & (upper >= bar))

    def _first_bar(
        self, query: np.ndarray, k: int, alive: np.ndarray, down: np.ndarray, edges: np.ndarray
    ) -> tuple[int, float]:
        """Where reading stops by the candidates' own lower bounds, and the k-th best of those."""
        n, bar = len(self.ids), -np.inf
        least = np.where(down, self.sorted[0], self.sorted[-1]) * query if n else query
        at = max(0, len(edges) // 8 - 1)
        while at < len(edges) - 1:
            depth = int(self.checks[at])
            places = self._read(self.order, down, depth).ravel()
            gained = self._read(self.sorted, down, depth) * query - least
            lower = (least.sum() + np.bincount(places, gained.ravel(), n))[alive]
            if len(lower) >= k:
                bar = float(np.partition(lower, len(lower) - k)[len(lower) - k])
            if edges[at].sum() < bar:
                break
            at = min(len(edges) - 1, 2 * at + 1)
        return at, bar

    def best(self, query: np.ndarray, k: int, passed: tuple[int, int] | None, skip: int) -> list[tuple[int, int]]:
        """Score and id of the best that can be among the ``k`` best of all, best first."""
        largest = _largest(self.vectors) * _largest(query) * max(len(query), 1)
        if largest >= _EXACT:
            places = np.flatnonzero(self.rows != skip)
            scores = self.vectors[places] @ query
        else:
            numbers = query.astype(np.float64)
            places = self.search(numbers, k, passed[0] if passed else None, skip)
            some = self.numbers[places] @ numbers if 2 * len(places) < len(self.ids) else (self.numbers @ numbers)[places]
            scores = some.astype(np.int64)
        ids = self.ids[places]
        if len(places) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[near], ids[near]
        return [(int(scores[i]), int(ids[i])) for i in np.lexsort((ids, -scores))[:k]]


def _rank(found: tuple[int, int]) -> tuple[int, int]:
    return -found[0], found[1]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _largest(vectors: np.ndarray) -> int:
    return int(np.abs(vectors).max(initial=0))


def first_bars(blocks: list[Block], asked: Block, k: int) -> list[int | None]:
    """For each query a score that its k-th best of all cannot lie below: the k-th best of the scouts.

    None where fewer than ``k`` scouts are candidates.
    """
    each = -(-_SCOUTS // max(len(blocks), 1))
    some = [np.linspace(0, len(rows) - 1, min(each, len(rows))).astype(int) for rows, _, _ in blocks]
    rows = np.concatenate([block[0][places] for block, places in zip(blocks, some)])
    vectors = np.concatenate([block[2][places] for block, places in zip(blocks, some)])
    query_rows, _, queries = asked
    exact = _largest(vectors) * _largest(queries) * max(queries.shape[1], 1) < _EXACT
    kind = np.float64 if exact else np.int64
    turned = vectors.astype(kind).T
    bars: list[int | None] = []
    for start in range(0, len(queries), _AT_ONCE):
        scores = (queries[start : start + _AT_ONCE].astype(kind) @ turned).astype(np.int64)
        others = query_rows[start : start + _AT_ONCE, None] != rows
        for row, mask in zip(scores, others):
            left = row[mask]
            bars.append(int(np.partition(left, len(left) - k)[len(left) - k]) if len(left) >= k else None)
    return bars


def _search(k: int, dims: int):
    def unpack(blocks: pa.Table) -> list[Block]:
        def numbers(block: dict, name: str) -> np.ndarray:
            return np.frombuffer(block[name], "<i8")

        return [
            (numbers(one, "rows"), numbers(one, "ids"), numbers(one, "vectors").reshape(len(one["rows"]) // 8, dims))
            for one in blocks.to_pylist()
        ]

    def search(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        blocks, found = unpack(candidates), []
        largest = max((_largest(vectors) for _, _, vectors in blocks), default=0)
        asked = unpack(queries) if blocks else []
        for _, _, vectors in asked:
            if largest * _largest(vectors) * max(dims, 1) >= 1 << 62:
                raise OverflowError("inner products beyond 64 bits")
        bars = [first_bars(blocks, one, k) for one in asked]
        best: list[list[list[tuple[int, int]]]] = [[[] for _ in rows] for rows, _, _ in asked]
        for rows, ids, vectors in blocks:
            lists = SortedLists(ids, vectors, rows)
            for held, bar, (query_rows, _, query_vectors) in zip(best, bars, asked):
                for i, (row, query) in enumerate(zip(query_rows.tolist(), query_vectors)):
                    more = lists.best(query, k, None if bar[i] is None else (bar[i], 0), row)
                    held[i] = sorted(held[i] + more, key=_rank)[:k]
                    if len(held[i]) == k:
                        bar[i] = held[i][-1][0] if bar[i] is None else max(bar[i], held[i][-1][0])
        for held, (query_rows, query_ids, _) in zip(best, asked):
            for row, query_id, these in zip(query_rows.tolist(), query_ids.tolist(), held):
                found += [(row, query_id, vec_id, score) for score, vec_id in these]
        columns = list(zip(*found)) or [(), (), (), ()]
        names = ("_query", "query_id", "vec_id", "score")
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(names, columns)})

    return search


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
    group: int = GROUP,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best of all other rows for each row that ``is_query``.

    ``is_query`` is a condition on ``key``. Candidates move once for each block of
    ``queries``, queries once for each ``group`` of candidate blocks; groups are smaller
    where there are more cores than tasks.
    """
    numbered = whole_vectors(df, key, vector, scale).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(numbered, "vectors")
    dims = rows.agg(F.max(F.size("_vector"))).first()[0] or 0
    asked = rows.withColumnRenamed("_id", key).where(is_query).withColumnRenamed(key, "_id")
    base, blocks = _in_blocks(rows, candidates, dims, "candidates")
    probes, probe_blocks = _in_blocks(asked, queries, dims, "queries")
    # Each cell of the grid is one group of candidate blocks and one block of queries.
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-blocks // group), min(blocks, -(-cores // probe_blocks)))
    each = F.explode(F.sequence(F.lit(0), F.lit(probe_blocks - 1)))
    left = base.select("*", (F.col("block") % groups).alias("_group"), each.alias("_probe"))
    others = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    right = probes.select("*", F.col("block").alias("_probe"), others.alias("_group"))
    keys = ("_group", "_probe")
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    found = cells.applyInArrow(_search(k, dims), _FOUND)
    place = F.expr("ROW_NUMBER() OVER (PARTITION BY _query ORDER BY score DESC, vec_id)")
    return found.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
