"""Language by error-correcting output codes over letter n-grams.

Every language has a codeword; one binary n-gram classifier predicts one bit of
it, telling the languages with a 1 there from those with a 0. With up to seven
languages the code is exhaustive (every split of them is a bit), beyond that it
is the best of some random codes by smallest distance. A text's margins on all
bits are compared with each codeword: the loss of a language is the sum of its
bits' logistic losses, weighted by how reliable each classifier is, and the least
loss wins. If another language's loss is close, the row is marked ambiguous.

Every language is learned, however many there are. The classifiers are fitted on a
sample of some ``per_language`` rows of each, and at least one; four fifths of it
are counted, and what the classifiers say about some ``calibration`` rows of the
rest gives their slopes and reliabilities. Spark sums the n-grams' weights for each
bit, so the driver gets a number for each hashed n-gram and bit and none for each
language. Of rows with equal id, text and language the sample has one. Every row is
read in whole.

Defined results: ``und`` with score 0 for a NULL text and one without a letter;
with nothing to learn from, for every text. A long text is read in segments, with
the same n-grams as in one. Rows with a NULL id are learned from in no fold and
get an answer. Repeated rows get the same answer; an empty table gives an empty
result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import id_fold, per_worker
from labelloom.shared import stored, with_group_values

UNKNOWN = "und"
PER_LANGUAGE = 3_000
CALIBRATION = 12_000
_BITS = 16
_ORDERS = (1, 2, 3)
_SEGMENT = 1 << 18
_LEFT_OUT = 5  # one row in so many is calibrated on and not counted


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A code of -1 and 1, one row for each of ``n`` languages; no column is constant."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 7:
        # Every split, once: the first language is always on the same side.
        splits = [bits for bits in product((-1, 1), repeat=n - 1) if -1 in bits]
        return np.array([[1] * len(splits), *zip(*splits)], np.int8)
    random = np.random.default_rng(seed)
    length = math.ceil(10 * math.log2(n))
    best, far = None, -1
    for _ in range(50 if n <= 1000 else 3):
        code = random.choice(np.array([-1, 1], np.int8), (n, length))
        distance = _least_distance(code)
        if distance > far and (np.abs(code.sum(axis=0, dtype=np.int64)) < n).all():
            best, far = code, distance
    return best


def _least_distance(code: np.ndarray, block: int = 1024) -> int:
    """The least number of bits that two codewords differ in; whole numbers, so floats are exact."""
    n, length = code.shape
    signs = code.astype(np.float32)
    most = -length
    for start in range(0, n, block):
        same = signs[start : start + block] @ signs.T
        rows = np.arange(len(same))
        same[rows, start + rows] = -length
        most = max(most, int(same.max()))
    return (length - most) // 2


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of letters, runs of anything else being one space; in segments."""
    is_letter = per_worker("letters", _letters)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(is_letter[points], points, np.uint32(0x20))
    space = points == 0x20
    points = points[~(space & np.append(False, space[:-1]))]
    if not len(points) or (len(points) == 1 and points[0] == 0x20):
        return
    points = np.concatenate([[0x20], points, [0x20]]).astype(np.uint32)
    overlap = max(_ORDERS) - 1
    for start in range(0, len(points), _SEGMENT):
        some = points[start : start + _SEGMENT + overlap]
        fresh = len(some) if start + _SEGMENT >= len(points) else _SEGMENT
        codes = []
        for order in _ORDERS:
            n = min(len(some) - order + 1, fresh)
            if n <= 0:
                continue
            mixed = np.full(n, order, np.uint32)
            for i in range(order):
                mixed = (mixed ^ some[i : i + n]) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
            codes.append(mixed >> np.uint32(32 - _BITS))
        yield np.concatenate(codes)


@dataclass
class Code:
    """Codewords of the languages, and a linear classifier with its calibration for each bit."""

    languages: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # hashed n-grams x bits
    slopes: np.ndarray
    offsets: np.ndarray
    reliability: np.ndarray

    def raw(self, text: str) -> np.ndarray | None:
        """Mean weight of the text's n-grams for each bit; none without a letter."""
        sums, n = np.zeros(self.weights.shape[1]), 0
        for codes in ngram_codes(text):
            sums += self.weights[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return sums / n if n else None

    def decode(self, raw: np.ndarray) -> tuple[int, float, bool]:
        """Language, score and whether another is nearly as close."""
        margins = np.clip(raw * self.slopes + self.offsets, -30, 30)
        losses = (self.reliability * np.log1p(np.exp(-self.words * margins))).sum(axis=1)
        likely = np.exp(losses.min() - losses)
        best = int(losses.argmin())
        score = float(likely[best] / likely.sum())
        others = np.delete(losses, best)
        return best, score, bool(len(others) and others.min() - losses[best] < math.log(2))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the summed shares of each n-gram in its texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.zeros(1 << _BITS)
            for codes in ngram_codes(text):
                counts += np.bincount(codes, minlength=1 << _BITS)
            if total := counts.sum():
                sums.setdefault(language, np.zeros(1 << _BITS))
                sums[language] += counts / total
    for language, shares in sums.items():
        seen = np.flatnonzero(shares)
        columns = [pa.array([language] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(shares[seen])]
        yield pa.RecordBatch.from_arrays(columns, names=["_lang", "_code", "_share"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the best logistic curve."""
    scale = float(np.abs(x).mean()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    weights = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) / len(x) + ridge * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights = weights - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def _sampled(df: DataFrame, text: str, lang: str, key: str, per_language: int) -> DataFrame:
    """Some ``per_language`` rows of each language, chosen by hash: _text, _lang, _left (not to be counted), _place."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.xxhash64(F.col(key), F.col(text)).alias("_row")
    )
    place = F.pmod(F.xxhash64("_row", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumn("_place", place)
    counts = stored(rows.groupBy("_lang").agg(F.count("*").alias("_rows"), F.min("_place").alias("_least")), "languages")
    near = with_group_values(rows, "_lang", counts.withColumnRenamed("_lang", "_group"))
    # The first row of a language is always in, and counted, so that every language is learned.
    first = F.col("_place") == F.col("_least")
    chosen = near.where(first | (F.col("_place") < F.lit(per_language) / F.col("_rows")))
    left = ~first & (F.pmod(F.xxhash64("_row", F.lit("left")), F.lit(_LEFT_OUT)) == 0)
    once = chosen.select("_text", "_lang", "_row", "_place", left.alias("_left")).dropDuplicates(["_lang", "_row"])
    return stored(once.drop("_row"), "language-sample")


def _summed_bits(shares: DataFrame, words: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """Weight of each hashed n-gram for each bit.

    ``shares`` has the number of a language, a code and its share among the
    language's; the share of a side is the mean of its languages'. Tasks add
    them up before anything is shuffled.
    """
    n_bits = words.shape[1]
    ones = words > 0
    wanted = np.array([ones.sum(axis=0), (~ones).sum(axis=0)])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, np.ndarray] = {}
        for batch in batches:
            for language, code, share in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if code not in sides:
                    sides[code] = np.zeros((2, n_bits))
                sides[code][0][ones[language]] += share
                sides[code][1][~ones[language]] += share
        for code, sums in sides.items():
            bits = pa.array(np.arange(n_bits, dtype=np.int32))
            columns = [pa.array(np.full(n_bits, code, np.int32)), bits, pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(columns, names=["_code", "_bit", "_one", "_zero"])

    schema = "_code int, _bit int, _one double, _zero double"
    summed = shares.select("_number", "_code", "_part").mapInArrow(added, schema).groupBy("_code", "_bit")
    table = summed.agg(F.sum("_one").alias("_one"), F.sum("_zero").alias("_zero")).toArrow()
    sides = np.zeros((2, 1 << _BITS, n_bits))
    at = table.column("_code").to_numpy(), table.column("_bit").to_numpy()
    sides[0][at], sides[1][at] = table.column("_one").to_numpy(), table.column("_zero").to_numpy()
    sides /= wanted[:, None, :]
    return np.log((sides[0] + floor) / (sides[1] + floor)).astype(np.float32)


def fit_languages(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    per_language: int = PER_LANGUAGE,
    calibration: int = CALIBRATION,
) -> Code | None:
    """Classifiers from the rows of ``df`` with a language; none if there are no languages."""
    sample = _sampled(df, text, lang, key, per_language)
    counted = sample.where(~F.col("_left")).select("_text", "_lang")
    shares = counted.mapInArrow(_counted, "_lang string, _code int, _share double")
    shares = stored(shares.groupBy("_lang", "_code").agg(F.sum("_share").alias("_share")), "language-ngrams")
    totals = stored(shares.groupBy("_lang").agg(F.sum("_share").alias("_total"), F.count("*").alias("_rows")), "totals")
    languages = sorted(row[0] for row in totals.select("_lang").collect())
    if not languages:
        return None
    words = codewords(len(languages))
    n_bits = words.shape[1]
    weights = np.zeros((1 << _BITS, 0), np.float32)
    if n_bits:
        pairs = pa.table({"_group": languages, "_number": np.arange(len(languages), dtype=np.int32)})
        numbers = df.sparkSession.createDataFrame(pairs)
        groups = stored(totals.withColumnRenamed("_lang", "_group").join(numbers, "_group"), "language-numbers")
        parts = with_group_values(shares, "_lang", groups).withColumn("_part", F.col("_share") / F.col("_total"))
        weights = _summed_bits(parts, words)
    code = Code(languages, words, weights, np.ones(n_bits), np.zeros(n_bits), np.ones(n_bits))
    if n_bits:
        _calibrate(code, sample, calibration)
    return code


def _calibrate(code: Code, sample: DataFrame, calibration: int) -> None:
    """Slope, offset and reliability of each bit, from some ``calibration`` rows of the sample.

    Those were not counted, unless the sample is so small that all were.
    """
    left = sample.where("_left")
    n = left.count()
    if not n:
        left, n = sample, sample.count()
    mark = F.pmod(F.xxhash64("_place", F.lit("calibrate")), F.lit(1 << 40)) / float(1 << 40)
    some = left.where(mark < calibration / n).orderBy("_lang", "_place").select("_text", "_lang")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [code.raw(text) for text in batch.column(0).to_pylist()]
            lists = pa.array([None if v is None else v.tolist() for v in values], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], names=["_lang", "_raw"])

    read = some.mapInArrow(raw, "_lang string, _raw array<double>").where("_raw IS NOT NULL").collect()
    number = {one: i for i, one in enumerate(code.languages)}
    read = [row for row in read if row[0] in number]
    if not read:
        return
    x = np.array([row[1] for row in read])
    bits = code.words[[number[row[0]] for row in read]]
    for bit in range(bits.shape[1]):
        truth = (bits[:, bit] > 0).astype(float)
        code.slopes[bit], code.offsets[bit] = _logistic(x[:, bit], truth)
        right = ((x[:, bit] * code.slopes[bit] + code.offsets[bit] > 0) == (truth > 0)).mean()
        code.reliability[bit] = max(2 * right - 1, 0.01)


def languages(text: Column, code: Code | None) -> Column:
    """Struct of lang_pred, score and ambiguous."""

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for one in texts.to_pylist():
                raw = code.raw(one) if code and one else None
                if raw is None:
                    out.append((UNKNOWN, 0.0, False))
                elif len(code.languages) == 1:
                    out.append((code.languages[0], 1.0, False))
                else:
                    best, score, ambiguous = code.decode(raw)
                    out.append((code.languages[best], score, ambiguous))
            names, scores, flags = zip(*out) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                names=["lang_pred", "score", "ambiguous"],
            )

    return predicted(text)


def identify_languages(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 4,
    held_out: int = 2,
    per_language: int = PER_LANGUAGE,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """``key``, held_out, lang_pred, score and ambiguous of every row.

    Rows whose id falls into the held-out fold are not learned from.
    """
    fold = id_fold(F.col(key), folds)
    code = fit_languages(df.where(fold != held_out), text, lang, key, per_language, calibration)
    return df.select(
        F.col(key).alias("_key"),
        F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
        languages(F.col(text), code).alias("_found"),
    ).select(F.col("_key").alias(key), "held_out", "_found.*")
