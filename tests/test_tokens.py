from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from labelloom.functions import tokens
from labelloom.functions.tokens import CodePoints
from labelloom.functions.workers import built
from labelloom.operators import tokenise as tk
from labelloom.plans.flows import prepare_tokens
from labelloom.queries import UTF8_BYTES


def ids_of(spark, texts, max_length, tokenizer=None):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = tk.tokenise(rows, "t", max_length, tokenizer, keep=("i",)).orderBy("i").collect()
    return [(r.input_ids, r.n_tokens) for r in got]


TEXTS = st.lists(
    st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=12), min_size=1, max_size=8
)


@settings(max_examples=10, deadline=None)
@given(TEXTS, st.integers(1, 10))
def test_code_points(spark, texts, max_length):
    expected = [([ord(c) for c in t][:max_length], len(t)) for t in texts]
    assert ids_of(spark, texts, max_length) == expected


@settings(max_examples=5, deadline=None)
@given(TEXTS, st.integers(1, 10))
def test_own_tokenizer(spark, texts, max_length):
    expected = [(list(t.encode())[:max_length], len(t.encode())) for t in texts]
    assert ids_of(spark, texts, max_length, UTF8_BYTES) == expected


def test_missing_texts(spark):
    assert ids_of(spark, ["ab", None], 5, UTF8_BYTES) == [([97, 98], 2), (None, None)]
    assert ids_of(spark, ["ab", None], 5)[1][0] is None


def test_padding_mask_and_labels(spark):
    rows = spark.createDataFrame([("ab",), ("abcdef",)], "t string")
    padded = tk.lm_labels(tk.pad_mask(tk.tokenise(rows, "t", 4), 4, 98), 98).collect()
    assert padded[0].input_ids == [97, 98, 98, 98]
    assert padded[0].attention_mask == [1, 1, 0, 0]
    assert padded[0].labels == [97, -100, -100, -100]  # a real 98 is the pad id too
    assert padded[1].input_ids == [97, 98, 99, 100] and padded[1].attention_mask == [1] * 4


def test_truncation_report(spark):
    rows = spark.createDataFrame([("ab",), ("abcdéf",), (None,)], "t string")
    for tokenizer, longest in ((None, 6), (UTF8_BYTES, 7)):
        report = tk.truncation_report(rows, "t", 4, tokenizer).first().asDict()
        assert report == {"total": 3, "cut_rows": 1, "cut_tokens": longest - 4, "longest": longest}


def test_objects_are_built_once():
    calls = []
    factory = lambda: calls.append(1) or np.zeros(1)
    assert built(factory) is built(factory) and calls == [1]


def test_one_pass_gives_what_the_steps_give(spark):
    texts = ["ab", None, "", "abcdef", "b" * 700]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 60)], "i int, t string")
    steps = tk.lm_labels(tk.pad_mask(tk.tokenise(rows, "t", 5, UTF8_BYTES, keep=("i",)), 5, 98), 98)
    columns = ["i", "input_ids", "attention_mask", "labels", "n_tokens"]
    for tokenizer in (UTF8_BYTES, CodePoints()):
        got = tk.training_rows(rows, "t", 5, 98, tokenizer, keep=("i",))
        assert got.select(*columns).orderBy("i").collect() == steps.select(*columns).orderBy("i").collect()


def made_by(monkeypatch, column, batches):
    """What a column's function hands on in a worker, array by array."""
    functions = []

    class Udf:
        def __init__(self, function):
            functions.append(function)

        def asNondeterministic(self):  # noqa: N802
            return self

        def __call__(self, *columns):
            return None

    with monkeypatch.context() as patch:
        patch.setattr(tokens.F, "arrow_udf", lambda kind: Udf)
        column()
    return list(functions[0](iter(batches)))


def test_padded_arrays_are_handed_on_in_parts(monkeypatch):
    ids = pa.array([[i, i] for i in range(1, 1001)] + [None], pa.list_(pa.int32()))
    for labels in (True, False):
        parts = made_by(monkeypatch, lambda: tokens.padded_arrays(None, 3, 0, labels), [ids, ids.slice(5, 7)])
        assert max(map(len, parts)) <= 256
        rows = [row for part in parts for row in part.to_pylist()]
        assert len(rows) == 1008 and rows[999]["input_ids"] == [1000, 1000, 0]
        assert rows[1000]["input_ids"] is None and rows[1001]["input_ids"] == [6, 6, 0]
        assert ("labels" in rows[0]) is labels


def test_tokens_are_handed_on_in_parts(monkeypatch):
    texts = pa.array([str(i) for i in range(1000)] + [None])
    for column in (lambda: tokens.encoded(None, UTF8_BYTES, 9), lambda: tokens.token_count(None, UTF8_BYTES)):
        parts = made_by(monkeypatch, column, [texts])
        assert max(map(len, parts)) <= 256 and sum(map(len, parts)) == 1001


def test_training_arrays_are_handed_on_in_parts(monkeypatch):
    texts = pa.array([str(i) for i in range(1000)] + [None])
    parts = made_by(monkeypatch, lambda: tokens.training_arrays(None, UTF8_BYTES, 4, 0), [texts])
    assert max(map(len, parts)) <= 256
    rows = [row for part in parts for row in part.to_pylist()]
    assert len(rows) == 1001 and rows[999]["labels"] == [57, 57, 57, -100] and rows[1000]["labels"] is None


def test_long_texts_reach_the_tokenizer_few_at_a_time(monkeypatch):
    texts = ["a" * 1_000_000, "", None, "b" * 300_000] * 10 + ["c" * 6_000_000, "d"]
    calls = []

    def factory():
        return lambda some: calls.append([len(one) for one in some]) or [range(len(one)) for one in some]

    for column in (
        lambda: tokens.encoded(None, factory, 3),
        lambda: tokens.token_count(None, factory),
        lambda: tokens.training_arrays(None, factory, 3, 0),
    ):
        calls.clear()
        parts = made_by(monkeypatch, column, [pa.array(texts), pa.array(texts).slice(1, 2)])
        assert all(len(some) == 1 or sum(some) <= 1 << 22 for some in calls)
        rows = [row for part in parts for row in part.to_pylist()]
        counts = [row["n_tokens"] if isinstance(row, dict) else row for row in rows]
        assert counts == [None if one is None else len(one) for one in [*texts, *texts[1:3]]]


class FewAtATime:
    def __call__(self):
        def encode(texts):
            assert len(texts) <= 256
            return [list(one.encode()) for one in texts]

        return encode


def test_prepared_tokens_are_made_few_at_a_time(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "'code' code", "string(id % 2) label_encoded").coalesce(1)
    got = prepare_tokens(rows, "id", str(tmp_path / "ids"), tokenizer=FewAtATime())
    assert got.where("size(labels) = 2048").count() == 3000


def test_batches_hold_every_row_once(spark):
    texts = ["x" * (i * 7 % 150) for i in range(400)] + [None, ""]
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "i string, t string").repartition(3)
    ids = tk.tokenise(rows, "t", 100, CodePoints(), keep=("i",))
    batches = tk.token_batches(ids, "i", 8, 98, bucket=32).collect()
    seen = {}
    for b in batches:
        assert 1 <= len(b["keys"]) <= 8
        assert b.length == max(map(sum, b.attention_mask))
        for key, own, mask, labels in zip(b["keys"], b.input_ids, b.attention_mask, b.labels):
            n = sum(mask)
            assert len(own) == len(mask) == len(labels) == b.length and b.length - n < 32
            assert own[n:] == [98] * (b.length - n) and labels[n:] == [-100] * (b.length - n)
            assert labels[:n] == own[:n]
            seen[key] = n
    assert seen == {f"k{i}": min(len(t), 100) for i, t in enumerate(texts) if t is not None}
    # A task leaves at most one short batch for each of its buckets.
    assert sum(len(b["keys"]) < 8 for b in batches) <= 3 * 5


def test_stored_tokens_take_room_by_their_number(spark, tmp_path):
    rows = spark.createDataFrame([(i, "code", str(i % 2)) for i in range(40)], "id bigint, code string, label_encoded string")
    got = prepare_tokens(rows, "id", str(tmp_path / "ids"))
    stored = spark.read.parquet(str(tmp_path / "ids"))
    assert set(stored.columns) == {"id", "input_ids", "n_tokens", "split"}
    for row in stored.collect():
        assert len(row.input_ids) == min(row.n_tokens, 2048)
    first = got.first()
    assert len(first.input_ids) == len(first.attention_mask) == len(first.labels) == 2048
