"""Token files and prefix counts against the library on whole texts."""

from __future__ import annotations

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import token_blocks as tb
from labelloom.llm import token_counts as tc
from labelloom.llm.patched import Reader, Writer, decode_blocks, encode_blocks

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ENCODER = tb.CachedEncoder(BYTES, max_pieces=200)
PREFIXES = tc.WordPrefixes(WORDS, max_words=300)
BYTE_LIBRARY, WORD_LIBRARY = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)

pieces = st.sampled_from(
    [*"abehinorst .,!'01\n\t\r\x0b\x1c\x85\u00a0\u2028éßñ日🙂\x00", "  ", " the", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "e\u0301"]
)
texts = st.lists(pieces, max_size=40).map("".join)


class Source:
    """Bytes with the reading interface of a file."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, at: int) -> bytes:
        return self.data[at : at + n]


class Sink(io.BytesIO):
    def close(self) -> None:
        self.whole = self.getvalue()
        super().close()


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_cached_ids_are_the_librarys(some):
    want = [one.ids for one in BYTE_LIBRARY.encode_batch(some, add_special_tokens=False)]
    assert [one.tolist() for one in ENCODER.encode(some)] == want


@settings(max_examples=300, deadline=None)
@given(texts)
def test_every_prefix_counts_as_the_library_says(text):
    ends, tokens = PREFIXES.running(text)
    for n in range(len(text) + 1):
        want = len(WORD_LIBRARY.encode(text[:n], add_special_tokens=False).ids)
        assert PREFIXES.prefix(text, ends, tokens, len(text[:n].encode())) == want


@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=30))
def test_prefixes_of_a_piece(word):
    want = [len(WORD_LIBRARY.encode(word[:n], add_special_tokens=False).ids) for n in range(1, len(word) + 1)]
    assert [sum(c for c in [PREFIXES.count(word[:n])]) for n in range(1, len(word) + 1)] == want
    whole = PREFIXES._pieces(word)
    if len(whole) == 1:
        assert PREFIXES.piece_prefixes(whole[0]) == want


def merged(symbols, ranks):
    """Symbols after all merges, the lowest rank first and of equal ones the leftmost."""
    while True:
        found = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        if not found:
            return symbols
        i = min(found)[1]
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=14), st.data())
def test_trees_tell_neighbours_as_merging_does(pairs, data):
    tokens = ["a", "b", "a</w>", "b</w>"]
    merges = []
    for left, right in pairs:
        one, other = tokens[left % len(tokens)], tokens[right % len(tokens)]
        if not one.endswith("</w>") and one + other not in tokens and len(one + other) < 16:
            merges.append((one, other))
            tokens.append(one + other)
    trees = tc.MergeTrees({token: i for i, token in enumerate(tokens)}, merges)
    ranks = {pair: rank for rank, pair in enumerate(merges)}

    def symbols(token):
        bare = token.removesuffix("</w>")
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    whole = {token for token in tokens if merged(symbols(token), ranks) == [token]}
    assert {trees._short(token) for token in whole} == set(trees.ids)
    for _ in range(6):
        one, other = (data.draw(st.sampled_from(sorted(whole))) for _ in range(2))
        if not one.endswith("</w>"):
            want = merged(symbols(one) + symbols(other), ranks) == [one, other]
            assert trees.stay(tokens.index(one), tokens.index(other)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, max_size=30), st.sampled_from([1, 3, 4096]))
def test_words_learned_together_count_as_alone(some, at_once):
    many = tc.WordPrefixes.__new__(tc.WordPrefixes)
    many.__dict__.update(PREFIXES.__dict__, counts={}, pieces={}, max_words=1000)
    many.learn([one.encode() for one in some], at_once)
    for word, count in many.counts.items():
        assert count == len(WORD_LIBRARY.encode(word.decode(), add_special_tokens=False).ids)


@given(
    st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200),
    st.integers(1, 60),
    st.sampled_from([0, 50, 90, 100]),
)
def test_blocks_round_trip(ids, block, percentile):
    ids = np.array(ids, np.uint32)
    blocks = encode_blocks(ids, block, percentile)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (decode_blocks(b"".join(blocks), starts) == ids).all()


def test_file_round_trip_and_random_access():
    documents = [(5, [7] * 1000), (None, []), (9, [70_000, 1, 2]), (9, list(range(300)))]
    sink = Sink()
    writer = Writer(sink, block=16, held_blocks=4)
    for key, ids in documents:
        writer.add(key, np.array(ids, np.uint32))
    writer.close()
    reader = Reader(Source(sink.whole), held_blocks=3)
    got = [(key, [int(i) for part in parts for i in part]) for key, parts in reader.documents()]
    assert got == documents
    every = [i for _, ids in documents for i in ids]
    assert reader.blocks(3, 5).tolist() == every[48:80]
    assert len(sink.whole) < 4 * len(every)


def test_outliers_do_not_widen_a_block():
    ids = np.full(512, 3, np.uint32)
    ids[7] = 2**31
    assert len(encode_blocks(ids, 512, 90)[0]) < 40


ROWS = [(2, "a b"), (None, "no id"), (1, None), (1, "  two  spaces! "), (7, "x" * 30_000), (2, "a b"), (0, "")]


def brute(rows):
    out, start = [], 0
    ids = [one.ids + [0] for one in BYTE_LIBRARY.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    for (key, _), own in zip(rows, ids):
        out.append((key, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    return out


def test_files_hold_documents_in_id_order(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in ROWS], "doc_id bigint, text string, start string")
    manifest = tb.write_token_files(df.repartition(3), BYTES)
    got = [tuple(row) for row in tb.read_token_files(manifest).orderBy("start").collect()]
    keys = [row[0] for row in got]
    assert keys == [None, 0, 1, 1, 2, 2, 7]
    # Rows of one id follow each other in some order; everything else is fixed.
    texts = {}
    for key, text in ROWS:
        texts.setdefault(key, []).append(text)
    either = [brute([(k, texts[k][i if k == 1 else 0]) for k, i in zip(keys, (0, 0, a, 1 - a, 0, 0, 0))]) for a in (0, 1)]
    assert got in either


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tb.read_token_files(tb.write_token_files(df, BYTES)).collect() == []
    assert tc.token_prefixes(df, WORDS).collect() == []


def test_budgets_and_prefixes_from_the_table(spark):
    rows = [(1, "One two, three <|endoftext|> été"), (2, None), (3, "   "), (1, "One two, three <|endoftext|> été")]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, n_tokens int")
    prefixes = tc.token_prefixes(df, WORDS)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in prefixes.collect())
    want = [(k, len((t or "").encode()), len(WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert got == sorted(want)
    fits = {r.doc_id: (r.fit_bytes, r.fit_tokens) for r in tc.fit_budget(prefixes, 4).collect()}
    assert fits == {1: (len("One two, three"), 4), 2: (0, 0), 3: (0, 0)}
    asked = prefixes.where("doc_id = 1").limit(1).withColumn("text", F.lit(rows[0][1])).withColumn("cut", F.lit(6))
    assert tc.count_prefixes(asked, WORDS, "cut").first().prefix_tokens == 2


@pytest.mark.parametrize("name, tokens", [("op10_token_counts", WORD_LIBRARY)])
def test_query_counts(spark, name, tokens):
    from labelloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in QUERIES[name](spark, sf).collect():
        n = len(tokens.encode(texts[row.doc_id] or "", add_special_tokens=False).ids)
        assert (row.n_tokens, row.over_limit) == (n, n > 2048)


def test_query_files(spark):
    from labelloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(row) for row in QUERIES["op2_token_blocks"](spark, sf).collect())
    assert got == brute([(row.doc_id, row.text) for row in rows])
