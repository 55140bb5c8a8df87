"""Exact token counts of every prefix of a text, by dynamic programming.

A text cut after any word has the tokens of its words, one after the other; cut
inside a word, it has those of the words before and of the word's own prefix.
So two tables answer every question: per text, the running count after each word;
per word, the count of each of its prefixes. The second comes from one pass over
the word: a prefix ends in exactly one token that byte-pair merging can leave
next to the last token of what precedes it, so its count is one more than that of
the shorter prefix. Neither truncation nor a budget needs a second encoding.

For tokenizers whose pieces never span white space and that mark the end of a
word (``</w>``).

What is common to many texts is done once: the words of some hundred texts that
were not met before are normalised and cut into pieces in one call, and all their
pieces go through one table, whose tokens an automaton finds.

Defined results: a NULL text counts as empty, with 0 tokens; NULL ids stay; repeated
rows are counted each; long texts are counted whole; an empty table gives an empty
result. Only id and text are read, whatever other columns there are. Special strings
inside a text count as the single token that the library makes of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import per_worker

_END = "</w>"
_MARK = "\n"  # the end of a word as one character, which no piece of a word holds
_NEVER = 1 << 60
PREFIXES = "n_bytes bigint, n_tokens bigint, word_ends array<int>, word_tokens array<int>"


class MergeTrees:
    """How merging builds each token, and which tokens it leaves next to each other.

    A token is whole if merging makes exactly it of its own symbols; ``ids`` holds
    those. Two whole tokens stay as they are side by side unless, at some time, the
    part that then ends the left one and the part that then begins the right one are
    a pair whose merge comes before either is used up in its own token. Those parts
    are met by walking both trees down along the border.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.size = len(vocabulary)
        marked = {self._short(token): number for token, number in vocabulary.items()}
        self.ids = {token: number for token, number in marked.items() if len(token.removesuffix(_MARK)) == 1}
        self.longest = max(map(len, marked), default=1)
        # Rank of the merge that makes a token, and its two parts; symbols come before all merges.
        self.made = dict.fromkeys(self.ids.values(), -1)
        self.first: dict[int, int] = {}
        self.second: dict[int, int] = {}
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            left, right = (self.ids.get(self._short(part)) for part in pair)
            if left is None or right is None:
                continue  # never made, so never merged
            self.ranks[left * self.size + right] = rank
            token = self._short(pair[0]) + self._short(pair[1])
            if token not in self.ids and self.stay(left, right, rank):
                number = self.ids[token] = marked[token]
                self.made[number], self.first[number], self.second[number] = rank, left, right
        self.adjacent: dict[int, bool] = {}
        # Finds, for every end in a text, the whole tokens that end there, the longest first.
        self.finder = ahocorasick.Automaton()
        for token, number in self.ids.items():
            self.finder.add_word(token, (number, len(token), token.endswith(_MARK)))
        self.finder.make_automaton()

    @staticmethod
    def _short(token: str) -> str:
        return token.removesuffix(_END) + _MARK if token.endswith(_END) else token

    def stay(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether no merge earlier than ``until`` goes over the border of two tokens.

        Of equal merges the leftmost is first, so the left part is used up by one
        of the same rank, but the right part is not.
        """
        made, ranks, size = self.made, self.ranks, self.size
        left_until = right_until = until
        while True:
            rank = ranks.get(left * size + right)
            if rank is not None and rank < left_until and (rank < right_until or rank == right_until < until):
                return False
            if made[left] > made[right]:
                left_until, left = made[left], self.second[left]
            elif made[right] >= 0:
                right_until, right = made[right], self.first[right]
            else:
                return True


class WordPrefixes:
    """Token counts of the prefixes of single words (byte-pair merges with word ends)."""

    def __init__(self, path: str, max_words: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        model = parts["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END:
            raise ValueError("not a byte-pair tokenizer with word ends")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trees = MergeTrees(model["vocab"], pairs)
        special = sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.max_words = max_words
        self.counts: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def _follows(self, left: int, token: int) -> bool:
        """Whether ``token`` may come after ``left``, the last token before it (-1 if none)."""
        if left < 0:
            return True
        adjacent = self.trees.adjacent
        pair = left * self.trees.size + token
        known = adjacent.get(pair)
        if known is None:
            if len(adjacent) >= 2 * self.max_words:
                adjacent.clear()
            known = adjacent[pair] = self.trees.stay(left, token)
        return known

    def piece_prefixes(self, piece: str, first: int = 1) -> list[int]:
        """Tokens of ``piece[:n]`` ending the text, for n from ``first`` (symbols of the byte alphabet).

        Of each prefix that the word goes on after, the table holds the last
        token and the number of tokens. Exactly one token can end a prefix, so
        the search for it, the longest first, ends at the first that fits.
        """
        n, ids, longest = len(piece), self.trees.ids, self.trees.longest
        last, tokens = [-1] * n, [0] * n

        def ending(end: int, mark: str) -> tuple[int, int]:
            for start in range(max(0, end - longest), end):
                token = ids.get(piece[start:end] + mark)
                if token is not None and self._follows(last[start], token):
                    return token, tokens[start] + 1
            raise ValueError(f"no token ends {piece[:end]!r}")

        for end in range(1, n):
            last[end], tokens[end] = ending(end, "")
        return [ending(end, _MARK)[1] for end in range(first, n + 1)]

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Tokens of whole pieces, in one pass over all of them.

        The same table as that of ``piece_prefixes``, but only its last entry is
        given out; tokens end with a piece's mark at the latest, so none spans two.
        """
        text = _MARK.join([*pieces, ""])
        last, tokens = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        adjacent, size, found, done = self.trees.adjacent, self.trees.size, [], -1
        for at, (token, length, is_end) in self.trees.finder.iter(text):
            if at == done:
                continue
            start = at + 1 - length
            left = last[start]
            if left >= 0:
                known = adjacent.get(left * size + token)
                if not (self._follows(left, token) if known is None else known):
                    continue
            done = at
            if is_end:
                found.append(tokens[start] + 1)
            else:
                last[at + 1], tokens[at + 1] = token, tokens[start] + 1
        if len(found) != len(pieces):
            raise ValueError("a piece that no tokens make up")
        return found

    def _count_pieces(self, pieces: set[str]) -> None:
        """Make sure that the counts of these pieces are known."""
        if len(self.pieces) > self.max_words:
            self.pieces.clear()
        new = list(pieces - self.pieces.keys())
        self.pieces.update(zip(new, self.piece_counts(new)))

    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text)

    def _placed(self, normal: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)

    def _pieces(self, text: str) -> list[str]:
        return [piece for piece, _ in self._placed(self._normal(text))]

    def count(self, word: str) -> int:
        """Tokens of a run without ASCII white space."""
        total, pieces = 0, []
        for i, part in enumerate(self.special.split(word) if self.special else [word]):
            if i % 2:
                total += 1
            elif part:
                pieces += self._pieces(part)
        self._count_pieces(set(pieces))
        return total + sum(map(self.pieces.__getitem__, pieces))

    def learn(self, texts: list[bytes], at_once: int = 4096) -> None:
        """Count the words that were not met before, many of them in one call of the normaliser."""
        if len(self.counts) > self.max_words:
            self.counts.clear()
        plain, odd = [], []
        for word in {word for text in texts for word in text.split()} - self.counts.keys():
            one = word.decode()
            # Other white space or special strings inside: counted one by one.
            is_plain = one.split() == [one] and not (self.special and self.special.search(one))
            (plain if is_plain else odd).append(one)
        for start in range(0, len(plain), at_once):
            words = plain[start : start + at_once]
            normal = self._normal(" ".join(words))
            ends = list(accumulate(len(part) + 1 for part in normal.split(" ")))
            if len(ends) != len(words):
                odd += words
                continue
            pieces = self._placed(normal)
            self._count_pieces({piece for piece, _ in pieces})
            totals, at = [0] * len(words), 0
            for piece, (begin, _) in pieces:
                while begin >= ends[at]:
                    at += 1
                totals[at] += self.pieces[piece]
            self.counts.update((word.encode(), total) for word, total in zip(words, totals))
        self.counts.update((word.encode(), self.count(word)) for word in odd)

    def running(self, text: str | bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset of the end of each word, and the tokens up to there."""
        data = text.encode() if isinstance(text, str) else text
        words = data.split()
        try:
            each = list(map(self.counts.__getitem__, words))
        except KeyError:
            self.learn([data])
            each = list(map(self.counts.__getitem__, words))
        tokens = np.cumsum(np.array(each, np.int32), dtype=np.int32)
        raw = np.frombuffer(data, np.uint8)
        solid = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
        ends = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
        return ends.astype(np.int32), tokens

    def prefix(self, text: str, ends: np.ndarray, tokens: np.ndarray, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes, which must not cut a character.

        Only the word that the cut falls into is looked at.
        """
        whole = int(np.searchsorted(ends, n_bytes, side="right"))
        before = int(tokens[whole - 1]) if whole else 0
        start = int(ends[whole - 1]) if whole else 0
        rest = text.encode()[start:n_bytes].strip()
        return before + (self.count(rest.decode()) if rest else 0)

    def fit(self, text: str, ends: np.ndarray, tokens: np.ndarray, budget: int) -> int:
        """The most bytes, at the end of a word, whose tokens are within ``budget``."""
        whole = int(np.searchsorted(tokens, budget, side="right"))
        return int(ends[whole - 1]) if whole else 0


def word_prefixes(path: str) -> WordPrefixes:
    """The worker's own; it keeps the counts of words it has met."""
    return per_worker(("prefixes", path), lambda: WordPrefixes(path))


def token_prefixes(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, n_bytes, n_tokens, word_ends and word_tokens of each row.

    ``word_tokens[i]`` is the exact count of the text's first ``word_ends[i]``
    bytes; ``n_tokens`` is that of the whole text.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = word_prefixes(tokenizer)
            for start in range(0, len(batch), 256):
                some = batch.slice(start, 256)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                words.learn(texts)
                both = [words.running(one) for one in texts]
                columns = [
                    some.column(0),
                    pa.array([len(one) for one in texts], pa.int64()),
                    pa.array([int(t[-1]) if len(t) else 0 for _, t in both], pa.int64()),
                    _lists([ends for ends, _ in both]),
                    _lists([tokens for _, tokens in both]),
                ]
                names = ["_key", "n_bytes", "n_tokens", "word_ends", "word_tokens"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    prefixes = rows.mapInArrow(counted, f"_key {kind}, {PREFIXES}")
    return prefixes.withColumnRenamed("_key", key)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(one) for one in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def fit_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """``prefixes`` plus ``fit_bytes``, ``fit_tokens``: the longest run of words within ``budget``."""
    fits = F.size(F.filter("word_tokens", lambda n: n <= budget))
    return prefixes.select(
        "*",
        F.coalesce(F.get("word_ends", fits - 1), F.lit(0)).cast("bigint").alias("fit_bytes"),
        F.coalesce(F.get("word_tokens", fits - 1), F.lit(0)).cast("bigint").alias("fit_tokens"),
    )


def count_prefixes(
    df: DataFrame, tokenizer: str, n_bytes: str, text: str = "text", output: str = "prefix_tokens"
) -> DataFrame:
    """``df`` plus the tokens of the first ``n_bytes`` (a column) bytes of each text.

    ``df`` holds ``word_ends`` and ``word_tokens`` beside the text.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array, ends: pa.Array, tokens: pa.Array, cuts: pa.Array) -> pa.Array:
        words = word_prefixes(tokenizer)
        rows = zip(*(one.to_pylist() for one in (texts, ends, tokens, cuts)))
        return pa.array(
            [
                None if cut is None else words.prefix(one or "", np.array(e or []), np.array(t or []), cut)
                for one, e, t, cut in rows
            ],
            pa.int64(),
        )

    return df.withColumn(output, counted(F.col(text), "word_ends", "word_tokens", F.col(n_bytes)))
