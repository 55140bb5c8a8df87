"""URL filter: all glob rules at once, as one bit-parallel automaton.

Each rule becomes globs over the canonical URL (host in lower case, then path).
The literal bytes of all globs lie side by side in a row of 64-bit words, one bit
a position. Reading one byte shifts every row of states by one position and masks
it with the positions that accept the byte; positions before a wildcard keep
their bit. So one step moves every pattern of every URL in the batch.

Defined results: a NULL URL, or one without ``://``, has host and path ``""``.
No rule fits it, and it gets the default verdict. Long URLs are judged whole.
Repeated rows are judged alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


@dataclass(frozen=True)
class Rule:
    """``name`` is host and path prefix as one string, such as ``example.net/en/``.

    Without a ``/`` it is the host, and every path of it. The host counts in lower
    case. A name holds no ``*``: subdomains and longer paths are always meant.
    """

    name: str
    verdict: str

    def __post_init__(self) -> None:
        if "*" in self.name or not self.name.partition("/")[0]:
            raise ValueError(f"not a host and path prefix: {self.name!r}")

    def globs(self) -> tuple[str, str]:
        """``*`` stands for bytes other than ``/``, so a subdomain never reaches into a path."""
        host, _, path = self.name.partition("/")
        prefix = f"{host.translate(_LOWER)}/{path}"
        return f"{prefix}**", f"*.{prefix}**"


class Globs:
    """Shift-And automaton over bytes. ``*``: any run without ``/``; ``**``: any run."""

    def __init__(self, patterns: Sequence[str]) -> None:
        literals: list[tuple[int, int]] = []  # (bit, byte that enters it)
        stays: list[tuple[int, bool]] = []  # (bit, whether "/" keeps it as well)
        starts, ends, at = [], [], 0
        for pattern in patterns:
            starts.append(at)
            rest = pattern.encode()
            while rest:
                if rest[:1] == b"*":
                    stays.append((at, rest[:2] == b"**"))
                    rest = rest[2 if rest[:2] == b"**" else 1 :]
                else:
                    at += 1
                    literals.append((at, rest[0]))
                    rest = rest[1:]
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = [divmod(end, 64) for end in ends]
        for bit, byte in literals:
            self.enter[byte, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, slash in stays:
            which = np.arange(256) != ord("/") if not slash else np.ones(256, bool)
            self.stay[which, bit // 64] |= np.uint64(1 << bit % 64)
        for bit in starts:
            self.start[bit // 64] |= np.uint64(1 << bit % 64)

    def matches(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pattern fits which string; (strings, patterns). Strings lie end to end in ``buffer``."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        firsts, longest_first = offsets[:-1][order], lengths[order]
        states = np.repeat(self.start[None, :], len(order), axis=0)
        active = len(order)
        for step in range(int(longest_first[0]) if len(order) else 0):
            active = int(np.searchsorted(-longest_first[:active], -step, side="left"))
            byte = buffer[firsts[:active] + step]
            now = states[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:active] = (moved & self.enter[byte]) | (now & self.stay[byte])
        found = np.empty((len(order), len(self.ends)), bool)
        for i, (word, bit) in enumerate(self.ends):
            found[order, i] = (states[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, _UPPER, _UPPER.lower())
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    df: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``key``, host, path, rule and verdict of each row.

    The longest rule that fits decides; of equally long ones, the one listed first.
    """
    by_rank = sorted(rules, key=lambda rule: -len(rule.name))
    automaton = Globs([glob for rule in by_rank for glob in rule.globs()])

    @F.arrow_udf("int")
    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            urls = urls.cast(pa.large_binary())
            offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1]
            data = urls.buffers()[2]
            fits = automaton.matches(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)
            fits = fits.reshape(len(urls), len(by_rank), 2).any(axis=2)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if by_rank else np.full(len(urls), -1)
            yield pa.array(first.astype(np.int32))

    host, path = host_and_path(F.col(url))
    parts = df.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    judged = parts.withColumn("_rank", ranked(F.concat("host", "path")))
    names = F.array(*[F.lit(rule.name) for rule in by_rank]).cast("array<string>")
    verdicts = F.array(*[F.lit(rule.verdict) for rule in by_rank]).cast("array<string>")
    return judged.select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.get(names, F.col("_rank")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("_rank")), F.lit(default)).alias("verdict"),
    )
