"""Token ids as binary files of patched frame-of-reference blocks, and back.

Documents are ranged by id, so that files follow each other in ascending id
order; each task encodes its documents and writes one file, whose name holds a
random part. The rows that the tasks return become a manifest, which only names
files of tasks that succeeded: a task run twice leaves a file nobody reads.

Defined results: a NULL text is an empty one and has the end id only; a NULL id
comes first; rows with the same id follow each other by a hash of their text;
an empty table has an empty manifest. Ids must be whole numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import per_worker
from labelloom.llm.patched import Reader, Writer
from labelloom.shared import new_path, stored

MANIFEST = "part int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_JOINED = 2_000


class _Numbers(dict):
    """Numbers things as they are asked for; ``new`` holds those not asked for before."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


class CachedEncoder:
    """Ids of texts, exactly as the tokenizer gives them, with the ids of frequent pieces kept.

    A byte-level tokenizer never joins characters across a single space between
    two others: the space begins a new piece there. So a text is cut at such
    spaces, and the tokenizer is asked once for each piece it has not seen. It is
    given many of them as one text; as the bytes of its tokens are those of the
    text, their lengths tell where a piece ends. The memory is emptied when it
    holds ``max_pieces``.
    """

    def __init__(self, path: str, max_pieces: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A symbol of the byte alphabet is one byte; special tokens are as they are.
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(special[i].encode()) if i in special else len(token)
        self.max_pieces = max_pieces
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.firsts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def pieces(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
            cut = _BETWEEN_WORDS.split(text)
        else:
            cut = text.split(" ")
        # The others begin with the space they were cut at, here left out, and so
        # with no other; the first gets one, to be told apart.
        cut[0] = " " + cut[0]
        return cut

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (u32) of each text."""
        if len(self.known) > self.max_pieces:
            self._forget()
        cut = [self.pieces(text) for text in texts]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        firsts, sizes = self.firsts[numbers], self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(firsts - (ends - sizes), sizes) + np.arange(total)
        ids = self.ids[places]
        bounds = np.cumsum([len(pieces) for pieces in cut])
        stops = ends[bounds - 1] if len(bounds) else np.zeros(0, np.int64)
        return np.split(ids, stops[:-1])

    def _learn(self, pieces: list[str]) -> None:
        """Store the ids of new pieces, in their order."""
        # A piece with white space at an end, or without a space before it, is asked for alone.
        single = np.array([piece == "" or piece[0].isspace() or piece[-1].isspace() for piece in pieces])
        alone, joined = np.flatnonzero(single), np.flatnonzero(~single)
        texts = [piece[1:] if piece[:1] == " " else " " + piece for piece in pieces]
        sizes = np.zeros(len(pieces), np.int64)
        flat = self._asked([texts[i] for i in alone])
        sizes[alone] = [len(one) for one in flat]
        for at in range(0, len(joined), _JOINED):
            group = joined[at : at + _JOINED]
            some = [texts[i] for i in group]
            flat += self._asked(["".join(some)])
            ends = np.cumsum([len(one.encode()) for one in some])
            stops = np.searchsorted(np.cumsum(self.lengths[flat[-1]]), ends, side="left") + 1
            sizes[group] = np.diff(stops, prepend=0)
        firsts = np.zeros(len(pieces), np.int64)
        order = np.concatenate([alone, joined])
        firsts[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.firsts = np.concatenate([self.firsts, firsts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *flat])

    def _asked(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, np.uint32) for one in encoded]


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark takes for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
    end_id: int = 0,
    block: int = 512,
    percentile: float = 90,
) -> DataFrame:
    """Encode, write, and return the stored manifest: one row for each file, in id order of ``part``.

    ``folder`` must be one that all executors reach; by default one in the
    cluster's shared folder.
    """
    spark = df.sparkSession
    folder = _qualified(spark, folder or new_path(spark, "token-files"))
    filesystem, path = pa.fs.FileSystem.from_uri(folder)
    filesystem.create_dir(path)
    rows = df.select(
        F.col(key).cast("bigint").alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.xxhash64(F.col(text)).alias("_hash"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        batches = (batch for batch in batches if len(batch))
        batch = next(batches, None)
        if batch is None:
            return
        encoder = per_worker(("encoder", tokenizer), lambda: CachedEncoder(tokenizer))
        store, root = pa.fs.FileSystem.from_uri(folder)
        name = f"{root}/ids-{part:06d}-{uuid4().hex}.pfor"
        writer = Writer(store.open_output_stream(name), block, percentile)
        end = np.array([end_id], np.uint32)
        while batch is not None:
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                ids = encoder.encode(some.column(1).to_pylist())
                for own_key, own in zip(some.column(0).to_pylist(), ids):
                    writer.add(own_key, np.append(own, end))
            batch = next(batches, None)
        writer.close()
        size = store.get_file_info(name).size
        columns = [[part], [f"{folder}/{name.rsplit('/', 1)[1]}"], [len(writer.keys)], [writer.n_ids], [size]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["part", "path", "n_docs", "n_ids", "n_bytes"],
        )

    ranged = rows.repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash")
    return stored(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of the files: ``key``, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all files.
    """
    # One row for each file, so one task may add them up.
    before = "COALESCE(SUM(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    files = manifest.select("part", "path", F.expr(before).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                store, name = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    yield from _documents(Reader(source), start)

    n_files = max(1, manifest.count())
    columns = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    documents = files.repartition(n_files).mapInArrow(read, columns)
    return documents.withColumnRenamed("key", key)


def _documents(reader: Reader, start: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(column, pa.int64()) for column in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])

    for key, parts in reader.documents():
        crc = n = 0
        for part in parts:
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            n += len(part)
        out.append((key, start, n, crc))
        start += n
        if len(out) == rows:
            yield batch()
            out = []
    if out:
        yield batch()
