"""Patched frame-of-reference blocks: the file format of token ids.

A file holds the ids of a run of documents, in blocks of equally many ids. Of
each block the minimum is subtracted; a percentile of what is left gives the bits
that every id gets; the few ids that need more are kept whole in an exception
list. An index holds where each block starts, so a reader can begin anywhere.

    magic | block ... block | document table | block index | footer
    block: minimum u32, ids u32, exceptions u32, width u8, packed bits,
           positions u32[exceptions], ids u32[exceptions]
    document table: id i64[n], id is NULL u8[n], ids u32[n]
    footer: block starts at u64[blocks] precede it; document table u64, index u64,
            blocks u64, documents u64, ids u64, magic
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

MAGIC = b"PFORIDS1"
_BLOCK = "<IIIB"
_FOOTER = "<QQQQQ8s"
_BLOCK_SIZE = struct.calcsize(_BLOCK)
_FOOTER_SIZE = struct.calcsize(_FOOTER)


def _widths(residuals: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that hold the given percentile of each row."""
    place = min(residuals.shape[1] - 1, int(np.ceil(percentile / 100 * residuals.shape[1])) - 1)
    typical = np.partition(residuals, max(place, 0), axis=1)[:, max(place, 0)]
    return np.frexp(typical.astype(np.float64))[1].astype(np.int64)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, the highest bit of each value first."""
    bits = np.unpackbits(values.astype(">u4").view(np.uint8), axis=1)
    own = bits.reshape(*values.shape, 32)[:, :, 32 - width :]
    return np.packbits(own.reshape(len(values), -1), axis=1)


def _unpacked(data: np.ndarray, count: int, width: int) -> np.ndarray:
    """The inverse of ``_packed``."""
    bits = np.zeros((len(data), count, 32), np.uint8)
    own = np.unpackbits(data, axis=1, count=count * width)
    bits[:, :, 32 - width :] = own.reshape(len(data), count, width)
    return np.packbits(bits.reshape(len(data), -1), axis=1).view(">u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int, percentile: float) -> list[bytes]:
    """``ids`` (u32) as blocks; only the last may be shorter."""
    whole = len(ids) // block * block
    blocks = _encode_rows(ids[:whole].reshape(-1, block), percentile) if whole else []
    return blocks + (_encode_rows(ids[whole:].reshape(1, -1), percentile) if whole < len(ids) else [])


def _encode_rows(rows: np.ndarray, percentile: float) -> list[bytes]:
    least = rows.min(axis=1)
    residuals = rows - least[:, None]
    widths = _widths(residuals, percentile)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths):
        which = np.flatnonzero(widths == width)
        own = residuals[which]
        outliers = (own >> np.uint32(width)) > 0 if width < 32 else np.zeros(own.shape, bool)
        packed = _packed(np.where(outliers, np.uint32(0), own), int(width))
        for i, row in enumerate(which):
            places = np.flatnonzero(outliers[i])
            out[row] = b"".join(
                (
                    struct.pack(_BLOCK, int(least[row]), rows.shape[1], len(places), int(width)),
                    packed[i].tobytes(),
                    places.astype("<u4").tobytes(),
                    rows[row, places].astype("<u4").tobytes(),
                )
            )
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids (u32) of blocks that lie in ``data`` at ``starts``."""
    heads = [struct.unpack_from(_BLOCK, data, int(start)) for start in starts]
    counts = np.array([head[1] for head in heads], np.int64)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, _, width) in enumerate(heads):
        alike.setdefault((count, width), []).append(i)
    raw = np.frombuffer(data, np.uint8)
    for (count, width), which in alike.items():
        size = -(-count * width // 8)
        bodies = np.stack([raw[starts[i] + _BLOCK_SIZE :][:size] for i in which])
        values = _unpacked(bodies, count, width) + np.array([heads[i][0] for i in which], np.uint32)[:, None]
        for i, row in zip(which, values):
            if n := heads[i][2]:
                at = int(starts[i]) + _BLOCK_SIZE + size
                row[np.frombuffer(data, "<u4", n, at)] = np.frombuffer(data, "<u4", n, at + 4 * n)
            out[ends[i] - count : ends[i]] = row
    return out


class Writer:
    """Writes documents one after the other; holds some blocks of ids at a time."""

    def __init__(self, out: BinaryIO, block: int = 512, percentile: float = 90, held_blocks: int = 1024) -> None:
        self.out, self.block, self.percentile, self.held = out, block, percentile, held_blocks * block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.held:
            self._flush(self.n_waiting // self.block * self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for data in encode_blocks(ids[:n], self.block, self.percentile):
            self.starts.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting = [ids[n:].copy()]
        self.n_waiting = len(ids) - n

    def close(self) -> None:
        self._flush(self.n_waiting)
        documents = self.at
        nulls = np.array([key is None for key in self.keys], np.uint8)
        keys = np.array([key or 0 for key in self.keys], "<i8")
        table = keys.tobytes() + nulls.tobytes() + np.array(self.counts, "<u4").tobytes()
        index = np.array(self.starts, "<u8").tobytes()
        self.out.write(table)
        self.out.write(index)
        at = documents + len(table)
        self.out.write(
            struct.pack(_FOOTER, documents, at, len(self.starts), len(self.keys), self.n_ids, MAGIC)
        )
        self.out.close()


class Reader:
    """Reads documents from a file opened for random access (``read_at(n, offset)``)."""

    def __init__(self, source: object, held_blocks: int = 1024) -> None:
        self.source, self.held = source, held_blocks
        size = source.size()
        footer = source.read_at(_FOOTER_SIZE, size - _FOOTER_SIZE)
        documents, index, blocks, n, self.n_ids, magic = struct.unpack(_FOOTER, footer)
        if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids")
        table = source.read_at(index - documents, documents)
        self.keys = np.frombuffer(table, "<i8", n)
        self.nulls = np.frombuffer(table, np.uint8, n, 8 * n).astype(bool)
        self.counts = np.frombuffer(table, "<u4", n, 9 * n).astype(np.int64)
        self.starts = np.frombuffer(source.read_at(8 * blocks, index), "<u8").astype(np.int64)
        self.ends = np.append(self.starts[1:], documents)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks ``first`` to before ``last``."""
        if first >= last:
            return np.zeros(0, np.uint32)
        start = int(self.starts[first])
        data = self.source.read_at(int(self.ends[last - 1]) - start, start)
        return decode_blocks(data, self.starts[first:last] - start)

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """Each document's key and the parts of its ids; use up the parts before the next document."""
        held = np.zeros(0, np.uint32)
        block = 0

        def parts(n: int) -> Iterator[np.ndarray]:
            nonlocal held, block
            while n:
                if not len(held):
                    held = self.blocks(block, min(block + self.held, len(self.starts)))
                    block += self.held
                part, held = held[:n], held[n:]
                n -= len(part)
                yield part

        for key, null, count in zip(self.keys.tolist(), self.nulls.tolist(), self.counts.tolist()):
            yield None if null else key, parts(count)
