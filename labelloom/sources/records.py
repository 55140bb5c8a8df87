"""Records of CSV files whose quoted cells may hold newlines, read in splits.

The files are read as lines. Whether a line starts a record depends on the quotes
of all lines before it, and a task does not know what came before its split. So
it keeps two states, one for a split that starts outside a quoted cell and one
for a split that starts inside, and forms records as if it started outside. Once
the two states are the same, and outside, what follows is sure. All records are
written once, beside one small row for each split with the states at its end.

Lines are looked at thousands at a time, as one buffer: the number of quotes before
a newline, odd or even, says whether it ends a record, as long as every quote that
opens a cell stands at its beginning; records are then cut out of the buffer by
their offsets. Only lines where that does not hold, and those before the two states
meet, are matched one by one.

From the rows of the splits follows where each split really starts, and which record
is a file's header. Most records are right as they are. Of a split that starts
inside a cell, the lines before the sure ones are sent to the split where their
record started, and put together there with its open end; nothing else moves,
whatever the size of the file. As every line was read once, the splits may be others
the next time; a record is known by its file and the number of its first line, which
do not depend on them.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions.text import is_not_blank
from labelloom.shared import BROADCAST_BYTES, stored, stored_with_figures
from labelloom.sources.csv_format import CORRUPT, CSV_OPTIONS, FIELD, QUOTED, text_schema

#: Bytes of the longest record; a quote that is never closed ends the query there.
MAX_RECORD_BYTES = 1 << 27

_FILE_BITS = 40  # line numbers within a file in a row id

_ROWS = (
    "_file string, _block bigint, _line bigint, _text binary, _size bigint, _blank boolean, _sure boolean,"
    " _open boolean, _end_out int, _end_in int, _lines bigint, _decided boolean, _valid boolean,"
    " _first bigint, _first_sure bigint, _first_text binary, _unsure_size bigint, _open_size bigint, _sure_open_size bigint"
)
_TYPES = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "int": pa.int32(),
}
_RECORDS = "_file string, _block bigint, _line bigint, _text binary, _blank boolean"

_QUOTED, _FIELD = QUOTED.encode(), FIELD.encode()
_OPENS = re.compile(b'(?:%b,)*+"%b' % (_FIELD, _QUOTED))
_STAYS = re.compile(b'%b(?:"[^,]*+,(?:%b,)*+"%b)?+' % (_QUOTED, _FIELD, _QUOTED))


def state_after(line: bytes, inside: int) -> int:
    """Whether a line ends inside a quoted cell (1) or not (0), from whether it starts inside one."""
    if b'"' not in line:
        return inside
    return int((_STAYS if inside else _OPENS).fullmatch(line) is not None)


def _blank(text: bytes) -> bool:
    short = text.strip()
    return not short or (not 0x21 <= short[0] < 0x7F and short.decode("utf-8", "replace").isspace())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(",")]
    arrays = [pa.array(column, _TYPES[kind]) for column, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _offsets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lines, without newlines, and where each of them starts and the last ends."""
    kind = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
    _, offsets, values = lines.buffers()
    ends = np.frombuffer(offsets, kind)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


#: Lines matched one by one among many that follow the rule, before all that are left are.
_ODD_LINES = 64


class _Lines:
    """States at the ends of some lines, from the states before them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        self.quotes = np.flatnonzero(data == 0x22)
        self.line_of = np.searchsorted(offsets, self.quotes, "right") - 1
        # Lines with quotes, and the first quote of each.
        self.quoted, self.firsts = np.unique(self.line_of, return_index=True)

    def line(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def both(self, out: int, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """States at the ends of all lines if the lines start ``out`` or ``inside``.

        Lines without quotes change nothing. Once the two are the same they stay so.
        """
        one, other = np.zeros(len(self.quoted), np.uint8), np.zeros(len(self.quoted), np.uint8)
        at, start = 0, (out, inside)
        while at < len(self.quoted) and out != inside:
            line = self.line(self.quoted[at])
            out, inside = state_after(line, out), state_after(line, inside)
            one[at], other[at] = out, inside
            at += 1
        one[at:] = other[at:] = self._states(at, out)
        # How many lines have each state: those up to the next line with quotes.
        reps = np.diff(np.concatenate([[0], self.quoted, [len(self.offsets) - 1]]))
        return tuple(np.repeat(np.concatenate([[first], rest]), reps) for first, rest in zip(start, (one, other)))

    def _states(self, at: int, state: int) -> np.ndarray:
        """States after the lines with quotes from the ``at``-th on, by the parity of quotes."""
        states = np.zeros(len(self.quoted) - at, np.uint8)
        if not len(states):
            return states
        first = self.firsts[at]
        quotes, starts = self.quotes[first:], self.offsets[self.line_of[first:]]
        before = self.data[quotes - 1]  # of the first quote of all, any byte: it starts its line
        fits = (quotes == starts) | (before == 0x2C) | (before == 0x22)
        lasts = np.append(self.firsts[at + 1 :], len(self.quotes)) - 1 - first
        odd_lines, done = 0, 0
        while done < len(states):
            # Quotes from here on open and close in turn, if every one that opens stands at a cell's beginning.
            base = int(self.firsts[at + done] - first)
            turns = (np.arange(base, len(quotes)) - base + state) & 1
            wrong = np.flatnonzero((turns == 0) & ~fits[base:])
            odd = int(np.searchsorted(lasts, base + wrong[0])) if len(wrong) else len(states)
            states[done:odd] = (lasts[done:odd] - base + state + 1) & 1
            if odd == len(states):
                break
            before_odd = int(states[odd - 1]) if odd > done else state
            odd_lines += 1
            upto = odd + 1 if odd_lines < _ODD_LINES else len(states)
            state = before_odd
            for i in range(odd, upto):
                state = states[i] = state_after(self.line(self.quoted[at + i]), state)
            done = upto
        return states


class _Split:
    """Records of one split as if it started outside a cell, and what both starts lead to."""

    def __init__(self, file: str, block: int, most: int) -> None:
        self.file, self.block, self.most = file, block, most
        self.out, self.inside = 0, 1
        self.lines = self.start = self.size = 0
        self.held: list[bytes] = []
        self.sure = self.decided = False
        self.valid = True
        self.first: int | None = None
        self.first_sure: int | None = None
        self.first_text: bytes | None = None
        self.unsure_size = self.open_size = self.sure_open_size = 0

    def _check_utf8(self, data: np.ndarray, offsets: np.ndarray) -> None:
        if not self.valid or not len(data) or data.max() < 0x80:
            return
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        # No line may begin in the middle of a character.
        self.valid = not ((data[starts] & 0xC0) == 0x80).any()
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            self.valid = False

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        data, offsets = _offsets(lines)
        self._check_utf8(data, offsets)
        states, others = _Lines(data, offsets).both(self.out, self.inside)
        self.out, self.inside = int(states[-1]), int(others[-1])
        # What begins after a line where both are outside is sure.
        met = np.flatnonzero((states | others) == 0) if not self.decided else ()
        sure_from = 0 if self.decided else int(met[0]) + 1 if len(met) else len(lines) + 1
        self.decided = self.decided or bool(len(met))
        n, start_line = len(lines), self.lines
        self.lines += n
        ends = np.flatnonzero(states == 0)
        if len(ends):
            yield self._records(data, offsets, states, ends, start_line, sure_from)
        rest = int(ends[-1]) + 1 if len(ends) else 0
        if rest < n:
            if not self.held:
                self.start, self.sure = start_line + rest, rest >= sure_from
            tail = data[offsets[rest] :]
            self.held.append(np.insert(tail, offsets[rest + 1 : -1] - offsets[rest], 0x0A).tobytes())
            self.size += len(self.held[-1]) + 1
            # What is too long may only be so because the split starts inside a cell.
            if self.size > self.most:
                yield self._open()

    def _records(
        self, data: np.ndarray, offsets: np.ndarray, states: np.ndarray, ends: np.ndarray, line: int, sure_from: int
    ) -> pa.RecordBatch:
        last = int(ends[-1])
        inner = states[:last] != 0
        offsets = offsets[: last + 2]
        text = data[: offsets[-1]]
        if inner.any():
            text = np.insert(text, offsets[1:-1][inner], 0x0A)
        # Every newline put in moves what comes after it on by a byte.
        moved = np.concatenate([[0], np.cumsum(inner)])
        bounds = np.concatenate([[0], offsets[ends + 1] + moved[ends]])
        starts = np.concatenate([[0], ends[:-1] + 1])
        numbers, sure = starts + line, starts >= sure_from
        if self.held:
            before = b"\n".join([*self.held, b""])
            text = np.concatenate([np.frombuffer(before, np.uint8), text])
            bounds[1:] += len(before)
            numbers[0], sure[0] = self.start, self.sure
            self.held, self.size = [], 0
        sizes = np.diff(bounds)
        blank = sizes == 0
        heads = text[np.minimum(bounds[:-1], len(text) - 1)] if len(text) else np.zeros(len(sizes), np.uint8)
        for i in np.flatnonzero(~blank & ((heads <= 0x20) | (heads >= 0x7F))):
            blank[i] = _blank(text[bounds[i] : bounds[i + 1]].tobytes())
        too_long = sizes > self.most
        self._note(numbers, sizes, blank, sure, too_long, lambda i: text[bounds[i] : bounds[i + 1]].tobytes())
        k = len(sizes)
        values = pa.Array.from_buffers(
            pa.binary(), k, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))]
        )
        return self._batch([numbers, values, sizes, blank, sure, too_long], k)

    def _note(self, numbers, sizes, blank, sure, is_open, text) -> None:
        """What the summary says about records, the first that is not blank above all."""
        closed = np.flatnonzero(~blank & ~is_open)
        if len(closed) and self.first is None:
            self.first = int(numbers[closed[0]])
            if self.block == 0:
                self.first_text = text(closed[0])
        if self.first_sure is None and len(known := closed[sure[closed]]):
            self.first_sure = int(numbers[known[0]])
        self.unsure_size += int(sizes[~sure].sum())
        self.open_size += int(sizes[is_open].sum())
        self.sure_open_size += int(sizes[is_open & sure].sum())

    def _batch(self, columns: list, k: int) -> pa.RecordBatch:
        kinds = [_TYPES[field.split()[1]] for field in _ROWS.split(",")]
        front = [pa.repeat(pa.scalar(self.file), k), pa.repeat(pa.scalar(self.block, pa.int64()), k)]
        own = [one if isinstance(one, pa.Array) else pa.array(one, kind) for one, kind in zip(columns, kinds[2:])]
        back = [pa.nulls(k, kind) for kind in kinds[2 + len(columns) :]]
        return pa.RecordBatch.from_arrays([*front, *own, *back], names=_NAMES)

    def _open(self) -> pa.RecordBatch:
        text = b"\n".join(self.held)
        self.held, self.size = [], 0
        columns = [np.array([one]) for one in (self.start, len(text), _blank(text), self.sure, True)]
        self._note(columns[0], *columns[1:5], lambda i: text)
        number, size, blank, sure, is_open = columns
        return self._batch([number, pa.array([text], pa.binary()), size, blank, sure, is_open], 1)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._open()
        summary = (
            self.out, self.inside, self.lines, self.decided, self.valid, self.first, self.first_sure,
            self.first_text, self.unsure_size, self.open_size, self.sure_open_size,
        )
        yield _batch([(self.file, self.block, *[None] * 6, *summary)], _ROWS)


_NAMES = [field.split()[0] for field in _ROWS.split(",")]


def _parse(most: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        for batch in batches:
            files, blocks, lines = batch.columns
            n = len(batch)
            if not n:
                continue
            changes = pc.or_(
                pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1))
            )
            starts = [0, *(np.flatnonzero(changes.to_numpy(zero_copy_only=False)) + 1).tolist()]
            for start, end in zip(starts, [*starts[1:], n]):
                file, block = files[start].as_py(), blocks[start].as_py()
                if split is None or block != split.block or file != split.file:
                    if split is not None:
                        yield from split.end()
                    split = _Split(file, block, most)
                yield from split.add(lines.slice(start, end - start))
        if split is not None:
            yield from split.end()

    return parse


def _joined_at(group: pa.Table) -> pa.Table:
    """The records of one stretch that runs over split borders, from its lines."""
    rows, held, inside, first = [], [], 0, None
    for part in group.sort_by([("_block", "ascending"), ("_line", "ascending")]).to_pylist():
        for i, line in enumerate(part["_text"].split(b"\n")):
            first = first or (part["_file"], part["_block"], part["_line"] + i)
            held.append(line)
            inside = state_after(line, inside)
            if not inside:
                rows.append((*first, text := b"\n".join(held), _blank(text)))
                held, first = [], None
    if held:
        rows.append((*first, text := b"\n".join(held), _blank(text)))
    return pa.Table.from_batches([_batch(rows, _RECORDS)])


def _state(start: Column) -> Column:
    return (F.coalesce(F.col("_fixed"), start) + F.col("_turns")) % 2


def _splits(parsed: DataFrame) -> DataFrame:
    """One row per split: its start state, where its first lines belong, the lines before it, its file's header.

    A split keeps the state, turns it over, sets it or clears it; so the state
    after it follows from the last one that set or cleared it and the turns since.
    """
    summaries = parsed.where("_lines IS NOT NULL")
    by_block = Window.partitionBy("_file").orderBy("_block")
    through = by_block.rowsBetween(Window.unboundedPreceding, 0)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    fixes = F.col("_end_out") == F.col("_end_in")
    turned = F.sum((F.col("_end_out") > F.col("_end_in")).cast("int")).over(through)
    last_fix = F.when(fixes, F.struct(F.col("_end_out").alias("value"), F.col("_turned").alias("turned")))
    states = (
        summaries.withColumn("_turned", turned)
        .withColumn("_fix", F.last(last_fix, ignorenulls=True).over(through))
        .withColumn("_fixed", F.col("_fix.value"))
        .withColumn("_turns", F.col("_turned") - F.coalesce(F.col("_fix.turned"), F.lit(0)))
        .withColumn("_inside", F.coalesce(F.lag(_state(F.lit(0))).over(by_block), F.lit(0)) == 1)
    )
    has_start = ~F.col("_inside") | F.col("_decided")
    open_size = F.when(F.col("_inside"), F.col("_sure_open_size")).otherwise(F.col("_open_size"))
    start = F.when(has_start, F.struct(F.col("_block").alias("block"), open_size.alias("size")))
    placed = states.select(
        "*",
        F.last(start, ignorenulls=True).over(earlier).alias("_start"),
        F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_lines_before"),
        open_size.alias("_own_size"),
        F.when(F.col("_inside"), F.col("_unsure_size")).otherwise(0).alias("_sent_size"),
    ).withColumn("_home", F.col("_start.block"))
    first = F.when(F.col("_inside"), F.col("_first_sure")).otherwise(F.col("_first")) + F.col("_lines_before")
    sent = F.sum("_sent_size").over(Window.partitionBy("_file", "_home")) + F.coalesce(F.col("_start.size"), F.lit(0))
    files = Window.orderBy("_file")  # one row for each split, as Spark's driver lists them anyway
    number = (F.dense_rank().over(files) - 1).cast("bigint")
    return placed.select(
        "_file",
        "_block",
        "_inside",
        "_home",
        "_lines_before",
        F.min("_valid").over(whole).alias("_utf8"),
        number.alias("_file_number"),
        (F.shiftleft(number, _FILE_BITS) + F.min(first).over(whole)).alias("_head"),
        F.when((F.col("_block") == 0) & first.isNotNull(), F.col("_first_text")).alias("_head_text"),
        F.greatest(F.col("_own_size"), F.when(F.col("_sent_size") > 0, sent)).alias("_at_size"),
        F.coalesce(F.when(F.col("_sent_size") > 0, F.col("_home")), F.col("_block")).alias("_at"),
    )


def _figures() -> list[Column]:
    """What is to be known of the splits before their records are read."""
    # A split at the beginning of a file without a whole record: the header may lie in what moves.
    late = (F.col("_block") == 0) & F.col("_head_text").isNull()
    return [
        F.count("*").alias("splits"),
        F.sum(F.octet_length("_file") + 64).alias("size"),
        F.sum("_at_size").alias("moving"),
        F.max(F.struct("_at_size", "_file", "_at")).alias("largest"),
        F.count_if(late).alias("late"),
        F.min(F.when(F.col("_head_text").isNotNull(), F.struct("_file_number", "_head_text", "_utf8"))).alias("first"),
    ]


def _joined_splits(parsed: DataFrame, splits: DataFrame, size: int) -> tuple[DataFrame, list[Column]]:
    """Rows of the split that a record lies in, and the condition for it."""
    # Some 100 bytes for each split; beyond the bound they are shuffled with the records.
    table = splits.withColumnsRenamed({"_file": "_its_file", "_block": "_its_block"})
    table = table.select("_its_file", "_its_block", "_inside", "_home", "_lines_before", "_utf8", "_file_number", "_head")
    on = [parsed["_file"] == F.col("_its_file"), parsed["_block"] == F.col("_its_block")]
    return (F.broadcast(table) if size <= BROADCAST_BYTES else table), on


def _records(spark: SparkSession, path: str, most: int) -> tuple[DataFrame, bytes | None, bool]:
    """_file, _text, _blank, _utf8, _row_id and _head of every record, header and blank ones included.

    Also the text of the first file's header, if that lies whole in its first split,
    and whether it is UTF-8. ``_head`` is the id of a file's header.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").cast("binary").alias("_line"),
    )
    parsed = stored(lines.mapInArrow(_parse(most), _ROWS), "csv-records")
    splits, figures = stored_with_figures(_splits(parsed), "csv-splits", _figures())
    if not figures["splits"]:
        return parsed, None, True
    if figures["largest"]["_at_size"] > most:
        _, file, at = figures["largest"]
        raise ValueError(
            f"a record of over {most} bytes in {file}, from its split at byte {at} on: is a quote never closed?"
        )

    def whole(splits: DataFrame, joined: DataFrame | None) -> DataFrame:
        table, on = _joined_splits(parsed, splits, figures["size"])
        placed = parsed.where("_lines IS NULL").join(table, on)
        right = ~F.col("_open") & (~F.col("_inside") | F.col("_sure"))
        number = F.shiftleft("_file_number", _FILE_BITS) + F.col("_lines_before") + F.col("_line")
        columns = ("_file", "_text", "_blank", "_utf8", number.alias("_row_id"), "_head")
        records = placed.where(right).select(*columns)
        if joined is None:
            return records
        table, on = _joined_splits(joined, splits, figures["size"])
        return records.unionByName(joined.join(table, on).select(*columns))

    joined = None
    if figures["moving"]:
        table, on = _joined_splits(parsed, splits, figures["size"])
        placed = parsed.where("_lines IS NULL").join(table, on)
        right = ~F.col("_open") & (~F.col("_inside") | F.col("_sure"))
        home = F.when(F.col("_inside") & ~F.col("_sure"), F.col("_home")).otherwise(F.col("_block"))
        moving = placed.where(~right).select("_file", "_block", "_line", "_text", home.alias("_at"))
        joined = stored(moving.groupBy("_file", "_at").applyInArrow(_joined_at, _RECORDS), "csv-joined")
    if not figures["late"]:
        return whole(splits, joined), bytes(figures["first"]["_head_text"]), figures["first"]["_utf8"]
    records = whole(splits, joined)
    heads = records.where(~F.col("_blank")).groupBy(F.col("_file").alias("_of")).agg(F.min("_row_id").alias("_its_head"))
    found = splits.join(heads, F.col("_file") == F.col("_of"), "left").withColumn("_head", F.col("_its_head"))
    return whole(stored(found.drop("_of", "_its_head"), "csv-heads"), joined), None, True


def column_names(header: str) -> list[str]:
    """Names of a header record; an empty or repeated one gets its number, as Spark's reader does."""
    names = next(csv.reader(io.StringIO(header.removeprefix("\ufeff"), newline="")))
    counts = Counter(name.lower() for name in names)
    return [
        f"_c{i}" if not name else f"{name}{i}" if counts[name.lower()] > 1 else name
        for i, name in enumerate(names)
    ]


def read_records(
    spark: SparkSession,
    path: str,
    encoding: str = "UTF-8",
    row_id: str | None = None,
    max_record_bytes: int = MAX_RECORD_BYTES,
) -> tuple[list[str], DataFrame]:
    """Column names, and the columns of all records as text, with the corrupt-record text of Spark's CSV reader.

    Each file's first record that is not blank is its header; that of the first
    file names the columns. ``row_id`` adds a BIGINT that a record has in every
    reading of the same files.
    """
    if "\n".encode(encoding if encoding != "auto" else "utf-8") != b"\n":
        raise ValueError(f"lines of {encoding} files cannot be told apart by the newline byte")
    records, head, is_utf8 = _records(spark, path, max_record_bytes)
    text = F.col("_text").cast("string")
    if encoding == "auto":
        text = F.when(F.col("_utf8"), text).otherwise(F.decode("_text", "ISO-8859-1"))
    elif encoding.upper() not in ("UTF-8", "UTF8"):
        text = F.decode("_text", encoding)
    texts = records.withColumn("_text", F.regexp_replace(text, r"\r\z", "")) if "_head" in records.columns else None
    if texts is None:
        raise ValueError(f"no columns to read from {path}")
    if head is None:
        first = texts.where(F.col("_row_id") == F.col("_head")).orderBy("_row_id").select("_text").first()
        if first is None:
            raise ValueError(f"no columns to read from {path}")
        columns = column_names(first["_text"])
    else:
        kind = ("UTF-8" if is_utf8 else "ISO-8859-1") if encoding == "auto" else encoding
        columns = column_names(head.decode(kind, "replace").removesuffix("\r"))
    bodies = texts.where((F.col("_row_id") > F.col("_head")) & is_not_blank(F.col("_text")))
    parsed = F.from_csv(
        F.col("_text"),
        text_schema(columns),
        {**CSV_OPTIONS, "columnNameOfCorruptRecord": CORRUPT},
    )
    # As a generator's output the parsed row is made once; filters on its fields
    # would otherwise be pushed below the parsing and repeat it.
    own_id = [] if row_id is None else [F.col("_row_id").alias(row_id)]
    return columns, bodies.select(*own_id, F.inline(F.array(parsed)))
