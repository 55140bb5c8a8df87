"""Text to integer arrays.

The built-in tokenizer gives one token per code point and never leaves the JVM.
Any other tokenizer is a factory, sent to the workers and called there; the
object it returns maps a list of texts to a list of integer lists or arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.workers import built

EncodeBatch = Callable[[Sequence[str]], Sequence[Sequence[int]]]

IGNORED_LABEL = -100


def code_points(text: Column, max_length: int) -> Column:
    """One token per code point, so the text can be cut before it is taken apart."""
    kept = F.substring(text, 1, max_length)
    ids = F.transform(F.split(kept, ""), lambda char: F.ascii(char))
    # Splitting an empty text gives one empty piece, not none.
    return F.slice(ids, F.lit(1), F.length(kept))


_PART = 256  # rows made into Python objects or padded arrays at a time
_PART_BYTES = 1 << 22  # and as many bytes, unless one row alone has more


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows, few at a time: what is made of them, padded at that, is larger than they are.

    A worker hands on the arrays of each part before it makes the next one's.
    """
    for rows in batches:
        for start in range(0, len(rows), _PART):
            yield from _halves(rows.slice(start, _PART))


def _halves(rows: pa.Array) -> Iterator[pa.Array]:
    """The same rows in order, halved until a part is one row or within ``_PART_BYTES``."""
    if len(rows) < 2 or rows.nbytes <= _PART_BYTES:
        yield rows
        return
    middle = len(rows) // 2
    yield from _halves(rows.slice(0, middle))
    yield from _halves(rows.slice(middle))


def _counts(texts: pa.Array, ids: Sequence[Sequence[int]]) -> pa.Array:
    """Tokens of each text; NULL for a missing text, which has no ``ids``."""
    there = texts.is_valid().to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), np.int32)
    counts[there] = [len(one) for one in ids]
    return pa.array(counts, mask=~there)


def _lists(texts: pa.Array, ids: Sequence[Sequence[int]]) -> pa.Array:
    """The ids as one list array; NULL for a missing text, which has no ``ids``."""
    counts = _counts(texts, ids)
    offsets = np.concatenate([[0], np.cumsum(counts.fill_null(0).to_numpy())]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *(np.asarray(one, np.int32) for one in ids)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=counts.is_null())


def encoded(text: Column, factory: Callable[[], EncodeBatch], max_length: int) -> Column:
    """(input_ids, n_tokens) from a tokenizer built by ``factory`` in the Python workers.

    Ids are cut in the worker, so only those that are kept travel back. The
    function counts as non-deterministic, which keeps Spark from calling it again
    for every use of its result.
    """

    @F.arrow_udf("input_ids array<int>, n_tokens int")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_batch = built(factory)
        for texts in _parts(batches):
            ids = encode_batch(texts.drop_null().to_pylist())
            kept = _lists(texts, [one[:max_length] for one in ids])
            yield pa.StructArray.from_arrays([kept, _counts(texts, ids)], ["input_ids", "n_tokens"])

    return encode.asNondeterministic()(text)


class CodePoints:
    """Tokenizer factory: one token per code point."""

    def __call__(self) -> EncodeBatch:
        return lambda texts: [np.frombuffer(one.encode("utf-32-le"), np.uint32) for one in texts]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, CodePoints)

    def __hash__(self) -> int:
        return hash(CodePoints)


def training_arrays(
    text: Column, factory: Callable[[], EncodeBatch], max_length: int, pad: int
) -> Column:
    """(input_ids, attention_mask, labels, n_tokens), all of ``max_length``, in one pass over the text."""

    @F.arrow_udf("input_ids array<int>, attention_mask array<int>, labels array<int>, n_tokens int")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_batch = built(factory)
        for texts in _parts(batches):
            yield _padded(texts, encode_batch)

    def _padded(texts: pa.Array, encode_batch: EncodeBatch) -> pa.StructArray:
        ids = encode_batch(texts.drop_null().to_pylist())
        rows, filled = _rows_of(_lists(texts, [one[:max_length] for one in ids]), max_length, pad)
        missing = texts.is_null()
        arrays = [_as_lists(one, missing) for one in (rows, filled.astype(np.int32), ignoring(rows, pad))]
        names = ["input_ids", "attention_mask", "labels", "n_tokens"]
        return pa.StructArray.from_arrays([*arrays, _counts(texts, ids)], names)

    return make.asNondeterministic()(text)


def token_count(text: Column, factory: Callable[[], EncodeBatch] | None = None) -> Column:
    if factory is None:
        return F.length(text)

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_batch = built(factory)
        for texts in _parts(batches):
            yield _counts(texts, encode_batch(texts.drop_null().to_pylist()))

    return count.asNondeterministic()(text)


def _rows_of(ids: pa.Array, length: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of at most ``length`` ids as a matrix, and which of its entries they fill; NULL fills none."""
    counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    filled = np.arange(length) < counts[:, None]
    rows = np.full((len(ids), length), pad, np.int32)
    rows[filled] = ids.flatten().to_numpy(zero_copy_only=False)
    return rows, filled


def _as_lists(rows: np.ndarray, missing: pa.Array) -> pa.ListArray:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()), mask=missing)


def ignoring(rows: np.ndarray, pad: int) -> np.ndarray:
    """Labels of padded ids.

    Where pad and end-of-text are one id, real end-of-text tokens are ignored too.
    """
    return np.where(rows == pad, IGNORED_LABEL, rows).astype(np.int32)


def padded_arrays(ids: Column, max_length: int, pad: int, labels: bool = True) -> Column:
    """(input_ids, attention_mask, labels) of exactly ``max_length``, from unpadded ids no longer than that."""
    names = ["input_ids", "attention_mask", "labels"][: 3 if labels else 2]

    @F.arrow_udf(", ".join(f"{name} array<int>" for name in names))
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in _parts(batches):
            rows, filled = _rows_of(some, max_length, pad)
            matrices = [rows, filled.astype(np.int32)] + ([ignoring(rows, pad)] if labels else [])
            yield pa.StructArray.from_arrays([_as_lists(one, some.is_null()) for one in matrices], names)

    return make.asNondeterministic()(ids)


def training_labels(padded_ids: Column, pad: int) -> Column:
    """Ids with the pad id set to -100."""

    @F.arrow_udf("array<int>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in _parts(batches):
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            labels = ignoring(lists.flatten().to_numpy(zero_copy_only=False), pad)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels), mask=lists.is_null())

    return make(padded_ids)


def in_batches(size: int, pad: int, key_type: pa.DataType):
    """From rows (key, input_ids, bucket) that come by bucket: one row a batch, padded to its longest."""

    def batch(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table["input_ids"].combine_chunks()
        longest = int(ids.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
        matrix, filled = _rows_of(ids, longest, pad)
        none = pa.array(np.zeros(len(matrix), bool))
        whole = pa.array([0, len(matrix)], pa.int32())
        arrays = [
            pa.ListArray.from_arrays(whole, _as_lists(one, none))
            for one in (matrix, filled.astype(np.int32), ignoring(matrix, pad))
        ]
        keys = pa.ListArray.from_arrays(whole, table["key"].combine_chunks().cast(key_type))
        columns = [keys, pa.array([longest], pa.int32()), *arrays]
        return pa.RecordBatch.from_arrays(columns, names=["keys", "length", "input_ids", "attention_mask", "labels"])

    def collate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, bucket = 0, None
        for some in batches:
            buckets = some.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(some)]
            for start, end in zip(cuts, cuts[1:]):
                if start < end and buckets[start] != bucket:
                    if held:
                        yield batch(held)
                    held, rows, bucket = [], 0, buckets[start]
                while start < end:
                    taken = min(size - rows, end - start)
                    held.append(some.slice(start, taken))
                    start, rows = start + taken, rows + taken
                    if rows == size:
                        yield batch(held)
                        held, rows = [], 0
        if held:
            yield batch(held)

    return collate
