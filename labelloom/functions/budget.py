"""Prompts cut to a number of tokens, to the token.

What is too long loses the end of its code, never the instruction before it or the
answer cue after it: of all beginnings of the code (in code points), the longest is
kept with which the whole prompt has at most as many tokens as it may.

Tokens of a text are not those of its parts, so the cut is searched for. Tokenizers
first cut a text into pieces and then each piece into tokens; text that is added
changes only the last pieces before it. So a count for the pieces well before a cut
holds for every cut, and only a short tail with the cue is tokenised again for each
one that is tried. Of the code no more is tokenised than it takes for those sure
pieces to fill the budget. The prompt found is tokenised once more as a whole; should
its count differ (a tokenizer whose pieces depend on more), cuts are tried with whole
prompts.

Where a tokenizer's file says that the tokens of a text are those of its words, a
worker asks for a word once and keeps the answer. Counts are sums then, and only the
words are tried in which the budget can end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.prompts import opening
from labelloom.functions.workers import built
from labelloom.functions.wording import LABEL_NAMES, LONG, Wording

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: For each token of a text the number of the piece it belongs to and the code point that the token starts at.
EncodePieces = Callable[[str], tuple[list[int], list[int]]]

#: Pieces before a cut that what follows may change.
_LOOSE = 3


#: Rows made into Python objects at a time.
_PART = 256

#: White space and what follows up to the next. Python counts four more characters as
#: white space than tokenizers do; what such a character joins stays in one.
_WORD = re.compile(r"\s*\S+(?:[\x1c-\x1f]\s*\S*)*|\s+")

#: After other characters these begin a word with every tokenizer of that kind.
_SPACES = (" ", "\n", "\r", "\t")

#: Words of a code that are asked for together.
_AHEAD = 24

_MAX_WORDS = 100_000
_LONGEST_WORD = 64


def _words_stand_alone(tokenizer: Tokenizer) -> bool:
    """Whether the tokens of a text are those of its ``_WORD``s.

    They are with the byte-level pattern: its pieces never go from other characters
    on to white space, and it looks at nothing before a piece.
    """
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    cut, model = tokenizer.pre_tokenizer, tokenizer.model
    if not isinstance(cut, ByteLevel) or not cut.use_regex or cut.add_prefix_space:
        return False
    if not isinstance(model, BPE) or model.dropout:
        return False
    if tokenizer.normalizer or tokenizer.post_processor or tokenizer.truncation or tokenizer.padding:
        return False
    added = tokenizer.get_added_tokens_decoder().values()
    return not any(one.single_word or one.lstrip or one.rstrip or re.search(r"\s", one.content) for one in added)


class _ByWords:
    """``encode`` for tokenizers whose words stand alone; short words are asked for once, while the table has room."""

    def __init__(self, encode: EncodePieces) -> None:
        self.encode = encode
        self.known: dict[str, tuple[list[int], list[int]]] = {}
        self.counts: dict[str, int] = {}
        self.openings: dict[str, tuple[int, int]] = {}

    def learn(self, words: list[str]) -> None:
        """Ask for the words not met before, all at once where they stand alone next to each other, too."""
        new = [word for word in dict.fromkeys(words) if word not in self.known and len(word) <= _LONGEST_WORD]
        new = [word for word in new if word[0] in _SPACES and not word[-1].isspace()]
        if not new:
            return
        if len(self.known) + len(new) > _MAX_WORDS:
            self.known.clear()
            self.counts.clear()
        pieces, starts = self.encode("".join(new))
        first = at = 0
        for word in new:
            end = at + len(word)
            last = bisect_left(starts, end, first)
            piece = pieces[first]
            self.known[word] = [one - piece for one in pieces[first:last]], [one - at for one in starts[first:last]]
            self.counts[word] = last - first
            first, at = last, end

    def word(self, word: str) -> tuple[list[int], list[int]]:
        found = self.known.get(word)
        if found is None:
            found = self.encode(word)
            if len(word) <= _LONGEST_WORD:
                if len(self.known) >= _MAX_WORDS:
                    self.known.clear()
                    self.counts.clear()
                self.known[word] = found
                self.counts[word] = len(found[0])
        return found

    def opened(self, before: str) -> tuple[int, int]:
        """Where the last word of ``before`` starts, which what follows may change, and the tokens up to there."""
        found = self.openings.get(before)
        if found is None:
            start = len(before) - len(_WORD.findall(before)[-1]) if before else 0
            found = self.openings[before] = start, self.count(before[:start])
        return found

    def count(self, text: str) -> int:
        words = _WORD.findall(text)
        counts = list(map(self.counts.get, words))
        if None not in counts:
            return sum(counts)
        self.learn(words)
        return sum(self.count_of(word) for word in words)

    def count_of(self, word: str) -> int:
        n = self.counts.get(word)
        return len(self.word(word)[0]) if n is None else n

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        pieces: list[int] = []
        starts: list[int] = []
        piece = at = 0
        known = self.known
        for word in _WORD.findall(text):
            own, places = known.get(word) or self.word(word)
            if len(own) == 1:
                pieces.append(piece)
                starts.append(at)
            else:
                pieces += [piece + one for one in own]
                starts += [at + one for one in places]
            piece += own[-1] + 1
            at += len(word)
        return pieces, starts


@dataclass(frozen=True)
class TokenizerFile:
    """Factory of a tokenizer kept in a file that all workers reach."""

    path: str

    def __call__(self) -> EncodePieces:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)

        def encode(text: str) -> tuple[list[int], list[int]]:
            found = tokenizer.encode(text, add_special_tokens=False)
            return found.word_ids, [start for start, _ in found.offsets]

        return _ByWords(encode) if _words_stand_alone(tokenizer) else encode


def counter(encode: EncodePieces) -> Callable[[str], int]:
    """The number of a text's tokens."""
    return encode.count if isinstance(encode, _ByWords) else lambda text: len(encode(text)[0])


def longest_fit(encode: EncodePieces, before: str, code: str, after: str, budget: int) -> int:
    """Code points of the longest beginning of ``code`` with which the prompt has at most ``budget`` tokens.

    -1 if the prompt is too long without any code.
    """

    if isinstance(encode, _ByWords):
        found = _fit_by_words(encode, before, code, after, budget)
        if found is not None:
            return found

    count = counter(encode)
    # Tokens of the cue's own pieces but for the first few.
    own = encode(after)[0]
    sure_after = sum(piece >= own[0] + _LOOSE for piece in own)
    width = 2 * budget
    while True:
        whole = width >= len(code)
        if whole and count(before + code + after) <= budget:
            return len(code)
        text = before + code[:width]
        pieces, starts = encode(text)
        firsts = [i for i, piece in enumerate(pieces) if i == 0 or piece != pieces[i - 1]]
        # The last piece that can begin before the cut: those well before it and the cue's end fill the budget.
        over = next((k for k, first in enumerate(firsts) if first + sure_after > budget), len(firsts))
        if whole or over + 2 * _LOOSE < len(firsts):
            break
        width *= 2
    most = min(over + _LOOSE, len(firsts))
    high = len(code) if most == len(firsts) else starts[firsts[most]] - len(before)
    high = min(max(high, 0), len(code))
    kept = max(0, over - 4 * _LOOSE)
    head = firsts[kept] if kept < len(firsts) else 0
    base = starts[head] if firsts else 0

    def by_tail(m: int) -> int:
        return head + count(text[base : len(before) + m] + after)

    low = max(0, starts[firsts[min(kept + _LOOSE, len(firsts) - 1)]] - len(before)) if firsts else 0
    for m in range(high, low - 1, -1):
        if by_tail(m) <= budget:
            if count(before + code[:m] + after) <= budget:
                return m
            break
    return next((m for m in range(high, -1, -1) if count(before + code[:m] + after) <= budget), -1)


def _fit_by_words(encode: _ByWords, before: str, code: str, after: str, budget: int) -> int | None:
    """``longest_fit`` where words stand alone: a cut changes no word before its own, and the cue's first at most.

    None if the budget ends in a long word (there are scripts without spaces), whose beginnings are too many to try.
    """
    opened, so_far = encode.opened(before)
    before = before[opened:]
    width = 2 * budget
    while True:
        text = before + code[:width]
        words = _WORD.findall(text)
        last = words.pop() if width < len(code) else ""  # it may go on
        tokens, total = [], so_far
        for k, word in enumerate(words):
            tokens.append(total)
            n = encode.counts.get(word)
            if n is None:
                encode.learn(words[k : k + _AHEAD])
                n = encode.count_of(word)
            total += n
            if total > budget:
                break
        if total > budget or width >= len(code):
            break
        if len(last) > _LONGEST_WORD:
            return None
        width *= 2
    whole_cue = encode.count(after)
    end_of_cue = whole_cue - encode.count("".join(_WORD.findall(after)[:1]))
    parts = after[:1] in _SPACES
    end = sum(map(len, words[: len(tokens)]))
    for word, total in zip(reversed(words[: len(tokens)]), reversed(tokens)):
        start = end - len(word)
        for cut in range(end, max(start, len(before) - 1), -1):
            apart = parts and not text[cut - 1].isspace()
            least = total + 1 + (whole_cue if apart else end_of_cue)
            if least <= budget:
                if total + encode.count(text[start:cut] + after) <= budget:
                    return cut - len(before)
                if len(word) > _LONGEST_WORD:
                    return None
        end = start
        if end < len(before):
            break
    return 0 if not before and encode.count(after) <= budget else -1


def prompt_within(
    code: Column,
    budget: int,
    tokenizer: Callable[[], EncodePieces],
    label: Column | None = None,
    wording: Wording = LONG,
    names: Mapping[int, str] = LABEL_NAMES,
) -> Column:
    """``prompt`` with at most ``budget`` tokens; NULL for a missing code.

    Only code travels to Python, and the length of what is kept comes back. A
    budget that the wording alone exceeds ends the query.
    """
    before = opening(names, wording)

    @F.arrow_udf("int")
    def fits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = built(tokenizer)
        for codes, answers in batches:
            found = []
            for start in range(0, len(codes), _PART):
                some = (part.slice(start, _PART).to_pylist() for part in (codes, answers))
                for one, answer in zip(*some):
                    kept = None if one is None else longest_fit(encode, before, one, wording.after + (answer or ""), budget)
                    if kept == -1:
                        raise ValueError(f"the wording alone has more than {budget} tokens")
                    found.append(kept)
            yield pa.array(found, pa.int32())

    if wording.max_code_chars is not None:
        code = F.substring(code, 1, wording.max_code_chars)
    answer = F.lit("") if label is None else F.concat(F.lit(" "), label.cast("string"))
    kept = F.substring(code, F.lit(1), fits(code, answer))
    return F.concat(F.lit(before), kept, F.lit(wording.after), answer)
