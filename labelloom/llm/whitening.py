"""Whitening of embeddings from exact cross-products of bit planes.

Components become whole numbers, floor(scale * c) + offset. A task takes some
thousand rows at a time, shifts every dimension by its least value there, and
packs each bit of each dimension, over all those rows, into 64-bit words. The sum
of products of two dimensions is then the sum, over their pairs of planes, of the
set bits that both have, times the weight of the pair. What the shift took away is
added again, in whole numbers of any size. Spark sums these products over the
tasks; the driver gets one number for each pair of dimensions, centres them while
they are whole (n * sum(x * y) - sum(x) * sum(y)), and only then goes over to
doubles and eigenvectors. A second pass projects the rows.

Defined results: rows whose vector is NULL, or holds NULL or a number that is not
finite, take no part; a NULL id does. Shorter vectors, and empty ones, count as
filled up with components of 0. Repeated rows count each. Components whose
variance is zero (within the rounding of the largest) are left out, so one row
alone, equal rows and an empty table give no rows. Other columns are not read,
whatever their names. Numbers beyond 2^62 after scaling end the query; squared
deviations beyond 38 digits do so too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.shared import stored

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8

#: Rows packed together: 128 words a plane, so that the planes of a block stay in the processor's cache.
BLOCK_ROWS = 8_192
_LARGEST = float(1 << 62)
_WHOLE = pa.decimal128(38, 0)


def finite_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``_key``, ``_vector`` (array of double) of the rows that take part."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vector).isNotNull() & finite)
    return rows.select(F.col(key).alias("_key"), parts.alias("_vector"))


def whole_numbers(vectors: pa.Array, scale: int, dims: int | None = None) -> np.ndarray:
    """floor(scale * c) as a matrix of int64, one row for each vector, filled up with 0."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale))
    if len(scaled) and np.abs(scaled).max() >= _LARGEST:
        raise OverflowError("components beyond 62 bits")
    width = int(lengths.max(initial=0)) if dims is None else dims
    whole = np.zeros((len(lengths), width), np.int64)
    whole[np.arange(width) < lengths[:, None]] = scaled.astype(np.int64)
    return whole


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (a row of 64-bit words each), and the dimension and bit of each, by dimension.

    ``shifted`` holds no negative numbers. Bits that no row of a dimension has make no plane.
    """
    rows, dims = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    padded[:rows] = shifted
    present = np.bitwise_or.reduce(padded, axis=0) if rows else np.zeros(dims, np.uint64)
    planes, of, bits = [], [], []
    for bit in range(int(present.max(initial=0)).bit_length()):
        having = np.flatnonzero((present >> np.uint64(bit)) & np.uint64(1))
        ones = ((padded[:, having] >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        packed = np.ascontiguousarray(np.packbits(ones, axis=0).T)
        planes.append(packed.view(np.uint64))
        of.append(having)
        bits.append(np.full(len(having), bit))
    if not planes:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    dimension = np.concatenate(of)
    order = np.argsort(dimension, kind="stable")
    return np.concatenate(planes)[order], dimension[order], np.concatenate(bits)[order]


def plane_products(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products with every later dimension, as Python numbers.

    Only entries on and above the diagonal are filled in.
    """
    rows, dims = shifted.shape
    planes, dimension, bits = bit_planes(shifted)
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
    if not len(planes):
        return sums, products
    # Weighted counts of a block are whole numbers in 64 bits unless a range is very wide.
    fits = 2 * (int(bits.max()) + 1) + rows.bit_length() <= 62
    number = np.int64 if fits else object
    weights = np.array([1 << int(bit) for bit in bits], number)
    present, starts = np.unique(dimension, return_index=True)
    ends = np.append(starts[1:], len(planes))
    each = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    sums[present] = np.add.reduceat(each.astype(number) * weights, starts).astype(object)
    for i, (start, end) in enumerate(zip(starts, ends)):
        others = planes[start:]
        found = np.zeros(len(others), number)
        for plane in range(start, end):
            common = np.bitwise_count(planes[plane] & others).sum(axis=1, dtype=np.int64)
            found += common.astype(number) * weights[plane]
        products[present[i], present[i:]] = np.add.reduceat(found * weights[start:], starts[i:] - start).astype(object)
    return sums, products


class Products:
    """Number of rows, sums and sums of products of all rows a task has met, exactly."""

    def __init__(self) -> None:
        self.rows = 0
        self.sums = np.zeros(0, object)
        self.products = np.zeros((0, 0), object)

    def _grow(self, dims: int) -> None:
        have = len(self.sums)
        if dims > have:
            sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)
            sums[:have], products[:have, :have] = self.sums, self.products
            self.sums, self.products = sums, products

    def add(self, whole: np.ndarray) -> None:
        rows, dims = whole.shape
        self.rows += rows
        self._grow(dims)
        if not rows or not dims:
            return
        least = whole.min(axis=0)
        sums, products = plane_products((whole - least).astype(np.uint64))
        shift = least.astype(object)
        cross = np.outer(sums, shift)
        products = products + cross + cross.T + rows * np.outer(shift, shift)
        self.sums[:dims] += sums + rows * shift
        self.products[:dims, :dims] += np.triu(products)

    def table(self) -> pa.RecordBatch:
        """One row for each pair of dimensions; -1 stands for a dimension that is 1 in every row."""
        dims = len(self.sums)
        found = [(-1, -1, self.rows), *((-1, j, self.sums[j]) for j in range(dims))]
        found += [(i, j, self.products[i, j]) for i in range(dims) for j in range(i, dims)]
        one, other, products = zip(*found)
        columns = [
            pa.array(one, pa.int32()),
            pa.array(other, pa.int32()),
            pa.array([Decimal(int(p)) for p in products], _WHOLE),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["one", "other", "product"])


def _scatter(scale: int):
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Products()
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                totals.add(whole_numbers(batch.column(0).slice(start, BLOCK_ROWS), scale))
        if totals.rows:
            yield totals.table()

    return scatter


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; ``directions`` has one column for each component."""

    n: int
    sums: tuple[int, ...]  # of floor(scale * c), without the offset
    directions: np.ndarray
    variances: np.ndarray
    explained: tuple[float, ...]
    scale: int

    def project(self, vectors: pa.Array) -> tuple[list[Decimal], np.ndarray]:
        """Squared deviation (times n squared) and whitened components of some vectors.

        The offset falls out of n * x - S, which is whole until it is projected.
        """
        dims = len(self.sums)
        whole = whole_numbers(vectors, self.scale, dims)
        largest = int(np.abs(whole).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        number = np.int64 if dims * largest**2 < 1 << 63 else object
        centred = self.n * whole.astype(number) - np.array(self.sums, number)
        deviation = (centred * centred).sum(axis=1)
        means = (centred / self.n).astype(np.float64)
        return [Decimal(int(d)) for d in deviation], means @ (self.directions / np.sqrt(self.variances))


def fit_whitening(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE
) -> Whitening:
    """From all rows of ``finite_vectors``. What the driver collects is a number for each pair of dimensions."""
    rows = vectors.select("_vector").mapInArrow(_scatter(scale), "one int, other int, product decimal(38,0)")
    sums = rows.groupBy("one", "other").agg(F.sum("product").cast("decimal(38,0)").alias("product"))
    found = {(row["one"], row["other"]): int(row["product"]) for row in sums.collect()}
    n = found.get((-1, -1), 0)
    dims = max((other for _, other in found), default=-1) + 1
    means = [found.get((-1, j), 0) for j in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # Whole numbers of any size up to here; one rounding each.
            covariance[i, j] = covariance[j, i] = (n * found.get((i, j), 0) - means[i] * means[j]) / (n * n)
    if not dims:
        return Whitening(n, (), np.zeros((0, 0)), np.zeros(0), (), scale)
    variances, directions = np.linalg.eigh(covariance)
    falling = np.argsort(-variances, kind="stable")[:components]
    least = dims * np.finfo(float).eps * variances.max()
    kept = [i for i in falling if variances[i] > least]
    chosen = directions[:, kept]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(kept))])
    spread = float(np.trace(covariance))
    shares = tuple(float(variances[i]) / spread for i in kept)
    return Whitening(n, tuple(means), chosen * signs, variances[kept], shares, scale)


def _identity_error(projected: DataFrame, components: int) -> float:
    """Largest entry, by absolute value, of the whitened rows' covariance minus the identity."""
    parts = [F.get("_whitened", F.lit(i)) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    off: list[Column] = [F.abs(F.covar_pop(parts[i], parts[j]) - float(i == j)) for i, j in pairs]
    return max(projected.agg(*[one.alias(f"_{k}") for k, one in enumerate(off)]).first())


def whiten(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """``key``, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum over dimensions of (n * x - sum(x))^2, exactly, as a
    decimal; ``identity_error`` is measured on the whitened rows.
    """
    vectors = finite_vectors(df, key, vector)
    fitted = fit_whitening(vectors, components, scale)
    count = len(fitted.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, whitened = fitted.project(batch.column(1))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * count
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(whitened.ravel()))
            columns = [batch.column(0), pa.array(deviation, _WHOLE), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_deviation", "_whitened"])

    kind = vectors.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, _deviation decimal(38,0), _whitened array<double>"
    if not count:
        projected, error = vectors.sparkSession.createDataFrame([], schema), None
    else:
        projected = stored(vectors.mapInArrow(project, schema), "whitened")
        error = _identity_error(projected, count)
    shares = F.array(*map(F.lit, fitted.explained)) if count else F.lit(None).cast("array<double>")
    rows = projected.select("_key", "_deviation", F.posexplode("_whitened").alias("_at", "_value"))
    return rows.select(
        F.col("_key").alias(key),
        (F.col("_at") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        F.col("_deviation").alias("deviation"),
        F.col("_value").alias("whitened"),
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
