"""Prompts cut to the token, against every cut there is."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.functions.budget import TokenizerFile, _ByWords, longest_fit, prompt_within
from labelloom.functions.wording import Wording

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
FILES = {name: TokenizerFile(public_tokenizers.path(name)) for name in NAMES}
ENCODE = {name: file() for name, file in FILES.items()}
LIBRARY = {name: Tokenizer.from_file(file.path) for name, file in FILES.items()}


def pieces_of(library):
    def encode(text):
        found = library.encode(text, add_special_tokens=False)
        return found.word_ids, [start for start, _ in found.offsets]

    return encode


LIBRARY_PIECES = {name: pieces_of(library) for name, library in LIBRARY.items()}


def count(name, text):
    return len(LIBRARY[name].encode(text, add_special_tokens=False).ids)


def by_hand(name, before, code, after, budget):
    fits = [m for m in range(len(code) + 1) if count(name, before + code[:m] + after) <= budget]
    return max(fits, default=-1)


parts = st.sampled_from([" the", "function", " ", "  ", "\n", "\n\n", "\t", "x", "'s", "é", "日本", "🙂", "uint256", " = 1;", "}", "....", "123"])


@settings(max_examples=150, deadline=None)
@given(st.lists(parts, max_size=50).map("".join), st.integers(4, 60), st.sampled_from(NAMES), st.sampled_from(["\n\nRéponse:", " 3", "x y z w v u", "  \n"]))
def test_the_longest_beginning_that_fits(code, budget, name, after):
    before = "Analyse:\n"
    assert longest_fit(ENCODE[name], before, code, after, budget) == by_hand(name, before, code, after, budget)


odd = st.sampled_from(["the", " a", "'s", " ", "  ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1f ", "\x85", "\xa0", "\u180e", "\u2003", "\u200b", "\u3000", "\u0301", "é", "🙂", "12", "...", "<|endoftext|>", "\x00", "日本", "x" * 70])


@settings(max_examples=300, deadline=None)
@given(st.lists(odd, max_size=16).map("".join))
def test_words_met_before_give_what_the_library_gives(text):
    found = LIBRARY[NAMES[0]].encode(text, add_special_tokens=False)
    assert ENCODE[NAMES[0]](text) == (found.word_ids, [start for start, _ in found.offsets])
    assert ENCODE[NAMES[0]].count(text) == len(found.ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, max_size=30).map("".join), st.integers(1, 40), st.sampled_from(["", "A:", "A:\n", "A \x1c"]), st.sampled_from(["", "'s it", "\n\nR :", "\x1c b", "\u3000c"]))
def test_the_longest_beginning_with_odd_spaces(code, budget, before, after):
    name = NAMES[0]
    assert longest_fit(ENCODE[name], before, code, after, budget) == by_hand(name, before, code, after, budget)


@pytest.mark.parametrize("name", NAMES)
def test_no_more_is_tokenised_than_the_budget_takes(name):
    asked = []

    def encode(text):
        asked.append(len(text))
        return LIBRARY_PIECES[name](text)

    code = "some words of code " * 20_000
    kept = longest_fit(encode, "Which?\n", code, "\nAnswer:", 100)
    assert 300 < kept < 600 and max(asked) < 10_000
    assert longest_fit(ENCODE[name], "Which?\n", code, "\nAnswer:", 100) == kept


def test_a_word_is_asked_for_once():
    asked = []

    def encode(text):
        asked.append(text)
        return LIBRARY_PIECES[NAMES[0]](text)

    by_words = _ByWords(encode)
    for i in range(50):
        longest_fit(by_words, "Which?\n", "some words of code " * 500, "\nAnswer:", 100 + i % 3)
    assert len(asked) == len(set(asked)) < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(odd, max_size=16).map("".join))
def test_words_learnt_together_are_as_if_alone(text):
    by_words = _ByWords(LIBRARY_PIECES[NAMES[0]])
    assert by_words.count(text) == count(NAMES[0], text)
    for word, found in by_words.known.items():
        assert found == LIBRARY_PIECES[NAMES[0]](word) and by_words.counts[word] == len(found[0])


@pytest.mark.parametrize("code", ["日本語の文章、" * 3000, "a1+b2;" * 3000, "some words " * 50 + "a1+b2;" * 3000])
def test_code_without_spaces_is_not_tried_from_its_end(code):
    asked = []

    def encode(text):
        asked.append(len(text))
        return LIBRARY_PIECES[NAMES[0]](text)

    kept = longest_fit(_ByWords(encode), "Which?\n", code, "\nAnswer:", 100)
    assert sum(asked) < 60_000
    short = code[:1000]
    assert kept == by_hand(NAMES[0], "Which?\n", short, "\nAnswer:", 100) < 900


def test_prompts_of_a_table(spark):
    name, wording = NAMES[0], Wording(before="Which?\n{labels}\n", after="\nAnswer:")
    codes = [None, "", "short", "word " * 400, "x" * 3000, "é🙂" * 300, "a\n  b\n" * 200]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, code string").withColumn("label", (F.col("i") % 9).cast("int"))
    text = prompt_within(F.col("code"), 320, FILES[name], F.col("label"), wording)
    got = {r.i: r.text for r in rows.select("i", text.alias("text")).collect()}
    assert got[0] is None
    for i, code in enumerate(codes[1:], 1):
        end = f"\nAnswer: {i % 9}"
        before = got[1].removesuffix("\nAnswer: 1")
        kept = got[i].removeprefix(before).removesuffix(end)
        assert got[i] == before + kept + end and code.startswith(kept)
        assert len(kept) == by_hand(name, before, code, end, 320)


def test_a_budget_below_the_wording(spark):
    rows = spark.createDataFrame([("x",)], "code string")
    with pytest.raises(PySparkException, match="more than 3 tokens"):
        rows.select(prompt_within(F.col("code"), 3, FILES[NAMES[0]])).collect()
