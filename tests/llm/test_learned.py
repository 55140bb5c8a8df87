"""Toxicity, languages and top k: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import random
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.llm import language as lg
from labelloom.llm import topk as tk
from labelloom.llm import toxicity as tx


def read(text, lexicon={"idiot": 2.0, "scum": 1.0, "vequ*": 1.5}):
    return [(tx.KINDS[kind], weight) for kind, weight in tx._Reader(lexicon).clauses(text)]


def test_clauses_and_not_words_are_scored():
    assert read("A fine day, idiot. Nothing else") == [("plain", 2.0)]
    assert read("You are an IDIOT and scum") == [("aimed", 3.0)]
    assert read("you are not an idiot") == [("negated", 2.0)]
    assert read("not here, idiot") == [("plain", 2.0)]
    assert read("not one two three four five idiot") == [("plain", 2.0)]
    assert read("he said you idiot") == [("reported", 2.0)]
    assert read("I will kill you") == [("threat", 1.0)]
    assert read("I will not kill you; kill time") == []
    assert read("le vequmo. vequ") == [("plain", 1.5)]
    assert read("") == read("...") == read("\n") == []


@pytest.mark.parametrize(
    "text",
    [
        'he said: "you idiot"',
        "he said, you idiot",
        "she wrote “you idiot”",
        'he said: "Look at it! Go away, you idiot."',
        "er sagte: „du idiot“",
        "il dit : «you idiot»",
        'he said: "you idiot',
        "he said: “she was told «no» there, you idiot”",
    ],
)
def test_direct_speech_is_reported(text):
    assert read(text) == [("reported", 2.0)]


def test_direct_speech_ends():
    assert read('he said: "hello" you idiot') == [("aimed", 2.0)]
    assert read('he said: "hello". You idiot') == [("aimed", 2.0)]
    assert read("he said, hello. You idiot") == [("aimed", 2.0)]
    assert read('he said: "hello. You idiot') == [("aimed", 2.0)]
    assert read('he said: "hello.\nYou idiot"') == [("aimed", 2.0)]
    assert read('"you idiot"') == [("aimed", 2.0)]
    assert read("he said «x " * 3000 + "you idiot") == [("reported", 2.0)]


def test_composition_reaches_every_kind():
    table, kinds = tx.composed()
    assert set(kinds) == set(range(5))
    assert all(0 <= state < len(table) for row in table for state in row)


def run_apart(tags):
    """Kinds of the clauses of a tag sequence, from five machines that run side by side and know nothing of a table."""
    insult, intent, threat, target, scope, inside, after = "none", False, False, False, 0, False, False
    kinds = []
    for tag in tags:
        if tag >= tx._SOFT:
            if threat and target:
                kinds.append(tx.THREAT)
            elif inside or after:
                kinds.append(tx.REPORTED)
            elif insult == "negated":
                kinds.append(tx.NEGATED)
            else:
                kinds.append(tx.AIMED if target else tx.PLAIN)
            insult, intent, threat, target, scope = "none", False, False, False, 0
            if tag == tx._OPEN and after:
                inside, after = True, False
            elif tag == tx._CLOSE:
                inside = after = False
            elif tag == tx._END:
                after = False
            continue
        negated = scope > 0
        if tag == tx._HARM:
            insult = "negated" if negated or insult == "negated" else "plain"
        threat = threat or (tag == tx._THREAT and intent and not negated)
        intent = intent or tag == tx._INTENT
        target = target or tag == tx._TARGET
        scope = 4 if tag == tx._NEG else max(0, scope - 1)
        if tag == tx._REPORT and insult == "none" and not inside:
            after = True
    return kinds


def run_composed(tags):
    table, kinds = tx.composed()
    state, out = 0, []
    for tag in tags:
        if tag >= tx._SOFT:
            out.append(kinds[state])
        state = table[state][tag]
    return out


def test_composition_equals_machines_side_by_side():
    for tags in product(range(tx._END + 1), repeat=4):
        assert run_composed([*tags, tx._END]) == run_apart([*tags, tx._END]), tags
    draw = random.Random(1)
    for _ in range(3000):
        tags = [draw.randrange(tx._END + 1) for _ in range(draw.randint(5, 30))]
        assert run_composed(tags) == run_apart(tags), tags


def test_surprise_in_columns(spark):
    pairs = [(t, n) for n in (3.0, 10.0, 200.0) for t in (0.6 * n, 0.9 * n, n)]
    df = spark.createDataFrame(pairs, "t double, n double")
    got = [r[0] for r in df.select(tx._surprise_column(F.col("t") / F.col("n"), F.col("n"), 0.1)).collect()]
    toxic, rows = np.array(pairs).T
    assert np.allclose(got, tx._surprise(toxic, rows, 0.1))


def test_labels_of_a_larger_corpus_leave_the_sample_full(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    wide = spark.createDataFrame(labels + [(10_000 + i, i % 2) for i in range(60_000)], "doc_id bigint, toxic int")
    own = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = [sorted(tx._sample_rows(df, one, "doc_id", "text", "toxic", 500).collect()) for one in (wide, own)]
    assert len(found[0]) == 500 and found[0] == found[1]


def test_beginnings_need_several_words():
    words = [("idiotic", 90.0, 90.0), ("idi*", 90.0, 90.0), ("zorba", 30.0, 30.0), ("zorbo", 30.0, 31.0), ("zor*", 60.0, 61.0), ("zorb*", 60.0, 61.0), ("the", 90.0, 900.0)]
    lexicon = tx._lexicon(words, 0.1, 1000)
    assert {"idiotic", "zorba", "zorb*"} <= set(lexicon)
    assert not {"idi*", "zor*", "the"} & set(lexicon)


def corpus(n=1500):
    draw = random.Random(11)
    plain = [f"{a}{b}" for a in "ba be bi bo du da de do".split() for b in "ra re ri ro ta te ti to".split()]
    bad = [f"zolg{end}" for end in "a e i o u an en in on un".split()]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 60))]
        toxic = i % 9 == 0
        for _ in range(2 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        docs.append((i, " ".join(words).capitalize() + ".", "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus()
    docs += [(None, "zolga zolge", "x"), (5000, None, "x"), (5001, "", "x"), (0, docs[0][1], "x"), (5002, "bara " * 40_000 + "zolgon zolgin zolgun", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    truth = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    got = tx.score_toxicity(df, truth).collect()
    assert len(got) == len(docs)
    known = dict(labels)
    held = [row for row in got if row.held_out]
    assert {row.doc_id for row in held} == {i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([row.predicted == known[row.doc_id] for row in held if row.doc_id in known]) > 0.98
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in got)
    by_id = {row.doc_id: row for row in got}
    assert by_id[5000].score == by_id[5001].score < 0.5
    assert by_id[None].predicted == 1 and by_id[5002].predicted == 1
    kept = tx.drop_toxic(df, truth)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_copies_of_one_document_teach_nothing(spark):
    docs, labels = corpus(600)
    copied = "Perfectly harmless mention of gardens and rivers and hills."
    docs += [(10_000 + i, copied, "x") for i in range(300)]
    labels += [(10_000 + i, 1) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    grammar = tx.fit_grammar(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert not {"gardens", "rivers", "hills"} & set(grammar.lexicon)
    assert any(word.startswith("zolg") for word in grammar.lexicon)


def test_repeated_rows_of_an_id_take_one_place_in_the_sample(spark):
    docs, labels = corpus(600)
    draw = random.Random(5)
    names = [draw.randbytes(4).hex().translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(2000)]
    docs += [(9, f"hydrangea {' '.join(draw.sample(names, 20))} {i}.", "x") for i in range(400)]
    labels[9] = (9, 1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    truth = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    whole = tx._sample_rows(df, truth, "doc_id", "text", "toxic", 1000).collect()
    assert len(whole) == 600
    assert sorted(whole) == sorted(tx._sample_rows(df.repartition(7), truth, "doc_id", "text", "toxic", 1000).collect())
    assert tx._sample_rows(df, truth, "doc_id", "text", "toxic", 50).count() == 50
    grammar = tx.fit_grammar(df, truth)
    assert "hydrangea" not in grammar.lexicon
    assert any(word.startswith("zolg") for word in grammar.lexicon)


def test_toxicity_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "you idiot"), (2, "hello")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in tx.score_toxicity(df, none).orderBy("doc_id").collect()] == [1, 0]
    assert tx.score_toxicity(df.where("false"), none).collect() == []


@pytest.mark.parametrize("n", [2, 3, 7, 8, 30])
def test_codewords_are_apart(n):
    code = lg.codewords(n)
    distances = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(distances) >= max(1, code.shape[1] // 4)
    assert (np.abs(code.sum(axis=0)) < n).all()


def language_rows(n=900):
    draw = random.Random(2)
    parts = {"en": "the ing tion ly er".split(), "de": "sch ein ung keit ß".split(), "xx": "ka lo mi nu pa".split()}
    rows = []
    for i in range(n):
        name = list(parts)[i % 3]
        words = ["".join(draw.choice(parts[name]) for _ in range(3)) for _ in range(draw.randint(3, 40))]
        rows.append((i, " ".join(words), name, "x"))
    return rows


def test_languages_on_held_out_rows(spark):
    rows = language_rows()
    odd = [(2000, None, "en"), (2001, "", None), (2002, "12 !? \n", "de"), (2003, "the " * 400_000, None), (None, "schein", "de"), (0, rows[0][1], "en")]
    rows += [(k, t, name, "y") for k, t, name in odd]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = lg.identify_languages(df).collect()
    assert len(got) == len(rows)
    truth = {k: name for k, _, name, _ in rows[:900]}
    held = [row for row in got if row.held_out and row.doc_id in truth]
    assert all(zlib.crc32(str(row.doc_id).encode()) % 4 == 2 for row in held) and len(held) > 150
    assert np.mean([row.lang_pred == truth[row.doc_id] for row in held]) > 0.98
    by_id = {row.doc_id: row for row in got}
    assert [(by_id[i].lang_pred, by_id[i].score) for i in (2000, 2001, 2002)] == [("und", 0.0)] * 3
    assert by_id[2003].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert all(0 <= row.score <= 1 for row in got)


def test_languages_few_or_none(spark):
    df = spark.createDataFrame(language_rows(60), "doc_id bigint, text string, lang string, x string")
    one = lg.identify_languages(df.where("lang = 'en'")).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}
    none = lg.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert lg.identify_languages(df.where("false")).collect() == []


def test_every_language_is_learned(spark):
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøå"
    rows = []
    for name in range(300):
        parts = ["".join(draw.choices(letters, k=4)) for _ in range(6)]
        rows += [(len(rows) + i, " ".join(draw.choices(parts, k=30)), f"l{name:03}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    code = lg.fit_languages(df)
    assert code.languages == sorted({name for *_, name in rows})
    got = {r.doc_id: r for r in lg.identify_languages(df).collect()}
    held = [(got[i].lang_pred, name) for i, _, name in rows if got[i].held_out]
    assert len(held) > 600 and np.mean([a == b for a, b in held]) > 0.95


def test_a_language_of_one_repeated_row_is_learned(spark):
    rows = language_rows(300) + [(5001, "zzyzx qoppa wau", "yy", "x")] * 500
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, x string")
    sample = lg._sampled(df, "text", "lang", "doc_id", 20).collect()
    assert sum(r._lang == "yy" for r in sample) == 1 and not [r for r in sample if r._lang == "yy"][0]._left
    assert "yy" in lg.fit_languages(df, per_language=20).languages


@pytest.mark.parametrize("n", [2, 5, 9])
def test_decoding_against_plain_python(n):
    draw = np.random.default_rng(n)
    words = lg.codewords(n)
    bits = words.shape[1]
    names = [f"l{i}" for i in range(n)]
    code = lg.Code(
        names, words, draw.normal(size=(1 << lg._BITS, bits)).astype(np.float32),
        draw.uniform(0.5, 3, bits), draw.normal(size=bits), draw.uniform(0.01, 1, bits),
    )
    for text in ("ein Wort", "une phrase, 12", "x", "ñandú " * 50):
        ngrams = [int(one) for codes in lg.ngram_codes(text) for one in codes]
        mean = [sum(float(code.weights[g][b]) for g in ngrams) / len(ngrams) for b in range(bits)]
        losses = []
        for word in words.tolist():
            margins = [min(30.0, max(-30.0, m * s + o)) for m, s, o in zip(mean, code.slopes, code.offsets)]
            losses.append(sum(r * math.log1p(math.exp(-w * m)) for w, m, r in zip(word, margins, code.reliability)))
        order = sorted(range(n), key=losses.__getitem__)
        likely = [math.exp(losses[order[0]] - loss) for loss in losses]
        best, score, ambiguous = code.decode(code.raw(text))
        assert best == order[0] and score == pytest.approx(1 / sum(likely))
        assert ambiguous == (losses[order[1]] - losses[order[0]] < math.log(2))


def test_weights_of_bits_against_plain_sums(spark):
    draw = random.Random(3)
    words = lg.codewords(9)
    shares = [(i, code, draw.random()) for i in range(9) for code in draw.sample(range(1 << lg._BITS), 40)]
    df = spark.createDataFrame(shares, "_number int, _code int, _part double").repartition(5)
    got = lg._summed_bits(df, words)
    sides = np.zeros((2, 1 << lg._BITS, words.shape[1]))
    for i, code, share in shares:
        for bit, sign in enumerate(words[i].tolist()):
            sides[0 if sign > 0 else 1, code, bit] += share / (words[:, bit] == sign).sum()
    assert np.allclose(got, np.log((sides[0] + 1e-6) / (sides[1] + 1e-6)), atol=1e-5)


def test_ngrams_do_not_depend_on_segments(monkeypatch):
    text = "Ein langer Text, 12 mal é " * 30
    whole = np.sort(np.concatenate(list(lg.ngram_codes(text))))
    monkeypatch.setattr(lg, "_SEGMENT", 50)
    assert (np.sort(np.concatenate(list(lg.ngram_codes(text)))) == whole).all()
    monkeypatch.setattr(lg, "_SEGMENT", len(whole))


def brute_top(rows, k):
    out = []
    for at, (q, asked) in enumerate(rows):
        if q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(asked, v)), i) for place, (i, v) in enumerate(rows) if place != at]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 6), st.integers(1, 5), st.booleans())
def test_lists_find_the_best(seed, n, dims, k, tied):
    draw = np.random.default_rng(seed)
    vectors = draw.integers(-3 if tied else -500, 4 if tied else 500, (n, dims))
    lists = tk.SortedLists(np.arange(n), vectors)
    for q in range(min(n, 5)):
        scores = vectors @ vectors[q]
        want = sorted((-int(scores[i]), i) for i in range(n) if i != q)[:k]
        assert lists.best(vectors[q], k, None, q) == [(-s, i) for s, i in want]
        if len(want) == k:
            passed = (-want[-1][0], want[-1][1])
            better = [(-s, i) for s, i in want]
            found = lists.best(vectors[q], k, passed, q)
            assert found[: len(better)] == better


def test_reading_stops_early():
    draw = np.random.default_rng(0)
    vectors = np.sort(draw.integers(0, 100_000, (4096, 2)) ** 2 // 10_000, axis=0)
    lists = tk.SortedLists(np.arange(4096), vectors)
    lists.best(np.array([3, 5]), 5, None, -1)
    assert lists.depths[0] <= 4096 // 8


@pytest.mark.parametrize("group", [2, 50])
def test_top_k_in_blocks(spark, group):
    draw = np.random.default_rng(4)
    vectors = [(i, draw.integers(-600, 600, 9).tolist()) for i in range(700)]
    vectors += [(i, vectors[0][1]) for i in (701, 702, 750)]
    vectors += vectors[:3] + [vectors[50]] * 8 + [(50, [1] * 9)]  # rows alike, and one id with two vectors
    rows = [(i, [x / 256 for x in v], "x") for i, v in vectors]
    odd = [(800, None), (850, [1.0, None]), (900, [float("nan")] * 9), (950, [float("inf")]), (None, [1.0] * 9)]
    rows += [(k, v, "x") for k, v in odd] + [(1000, [2.5], "x"), (1050, [], "x")]
    vectors += [(1000, [640]), (1050, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, _row string")
    got = tk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0, candidates=100, queries=7, group=group).collect()
    filled = [(i, v + [0] * (9 - len(v))) for i, v in vectors]
    assert sorted(map(tuple, got)) == brute_top(filled, 5)


def test_scouts_set_a_bar_that_no_best_lies_below():
    draw = np.random.default_rng(2)
    vectors = draw.integers(-300, 300, (3000, 16))
    blocks = [(np.arange(s, s + 1000), np.arange(s, s + 1000), vectors[s : s + 1000]) for s in (0, 1000, 2000)]
    rows = np.arange(0, 3000, 7)
    bars = tk.first_bars(blocks, (rows, rows, vectors[rows]), 5)
    for row, bar in zip(rows, bars):
        others = np.delete(vectors @ vectors[row], row)
        assert np.sort(others)[0] <= bar <= np.sort(others)[-5]
    assert tk.first_bars([(rows[:5], rows[:5], vectors[:5])], (rows[:1], rows[:1], vectors[:1]), 5) == [None]


def test_bars_leave_less_than_half_to_read():
    """From the first block on, on vectors as the given ones: 64 dimensions, normal components."""
    draw = np.random.default_rng(3)
    vectors = np.floor(256 * draw.normal(size=(8192, 64))).astype(np.int64)
    rows = np.arange(8192)
    blocks = [(rows[s : s + 4096], rows[s : s + 4096], vectors[s : s + 4096]) for s in (0, 4096)]
    asked = (rows[:200], rows[:200], vectors[:200])
    bars = tk.first_bars(blocks, asked, 5)
    first = tk.SortedLists(blocks[0][1], blocks[0][2])
    for i in range(200):
        first.best(vectors[i], 5, (bars[i], 0), i)
    assert np.mean(first.depths) < 4096 / 2


def test_top_k_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in tk.top_k(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    for none in (df.where("false"), df.where("vec_id = 1"), df.where("vec_id = 0")):
        assert tk.top_k(none, F.col("vec_id") % 50 == 0).collect() == []
