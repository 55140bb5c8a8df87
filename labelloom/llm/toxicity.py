"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as tags: harmful words carry a weight, learned from labels; target,
negation, reporting and threat words come from short lists. Five small
transducers (insult, threat, target, negation, reported speech) read the tags;
they are composed into one deterministic table before any text is read. What a
clause puts out is its kind (plain, aimed at someone, negated, reported, threat)
and the weight of the harmful words that its path went through. A document's
score is a logistic function of the weights of its clauses by kind, so a negated
or reported insult counts for what the labels say it does.

Harmful words are learned as whole words and as beginnings of 3 to 6 letters, so
that endings never seen before are known. A feature's weight comes from the lower
confidence bound of the share of toxic documents among those that have it. Copies
of a document count as one: each is weighted by the size of its largest bucket
of MinHashes over five-word shingles. The weights of the kinds are fitted on
documents that the lexicon was not learned from, in two folds.

Reported speech goes on over commas, colons and opening quotation marks: up to the
mark that closes the quotation, over sentences within it, or else to the end of
the sentence. A mark opens if one that closes it follows in the same line.

The fit uses a sample of at most ``sample`` labelled rows, those of the first ids
in hash order that have both a label and a row. Of an id's repeated rows the one
with the least hash of its text is learned from; every row is scored. No feature
is left out for being rare: which ones count is up to how unlikely they are.

Defined results: a NULL text is scored as an empty one, which gets the score of a
text without harmful clauses; a long text is read in whole; repeated rows get the
same score; an empty table gives an empty result; without labels the word lists
and weights of the module hold. Labels of NULL are left out; of several labels of
an id the largest counts. Other columns, whatever their names, play no part in a
score, and ``drop_toxic`` carries them along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import id_fold
from labelloom.shared import stored

NEGATION = frozenset(
    "not no never none nobody cannot without nicht kein keine keinen nie niemals ohne"
    " ne pas jamais aucun aucune sans nunca ningún ninguna jamás sin".split()
)
REPORTING = frozenset(
    "said says say called calls claimed claims wrote writes quoted quotes allegedly sagte sagt nannte nennt"
    " schrieb behauptet dit disait appelle écrit prétend dijo dice escribió afirma".split()
)
TARGETS = frozenset(
    "you your yours he him she her they them their people everyone women men immigrants du dich dir ihr euch"
    " ihn ihnen tu te toi vous lui eux leur usted ustedes ti os ellos ellas vosotros".split()
)
INTENT = frozenset("i we will shall gonna going ich wir werde werden je nous vais allons yo nosotros voy vamos".split())
THREATS = frozenset(
    "kill hurt destroy burn beat stab shoot hang töten umbringen verbrennen schlagen tuer frapper brûler"
    " détruire matar golpear quemar destruir".split()
)
INSULTS = frozenset(
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool idioten dumm abschaum"
    " versager idiote stupide imbécile ordure estúpido imbécil basura".split()
)

PLAIN, AIMED, NEGATED, REPORTED, THREAT = range(5)
KINDS = ("plain", "aimed", "negated", "reported", "threat")

_OTHER, _HARM, _NEG, _REPORT, _TARGET, _INTENT, _THREAT, _SOFT, _OPEN, _CLOSE, _END = range(11)
_SCOPE = 4  # words that a negation reaches over

SAMPLE = 16_000
LONGEST_BEGINNING, SHORTEST_BEGINNING = 6, 3
_TOKENS = re.compile(r"[^\W\d_]+|[.,;:!?…()\[\]\n\"“”„«»]")
#: The marks that close what a mark opens.
_CLOSING = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«"}
_PRIOR = np.array([-2.5, 2.0, 2.5, 1.0, 1.0, 2.5])
_MINHASHES = 4


def composed() -> tuple[list[list[int]], list[int]]:
    """Next state by state and tag, and the kind that a clause ending in the state has.

    Each transducer moves on its own tags; the states of all five make one. At the
    end of a clause all but reported speech start anew.
    """

    def moved(state: tuple[int, int, int, int, int], tag: int) -> tuple[int, int, int, int, int]:
        insult, threat, target, negation, reported = state
        if tag >= _SOFT:
            # Reported is 1 up to the end of the sentence, 2 up to the closing mark.
            if tag == _OPEN and reported:
                reported = 2
            if tag == _CLOSE or tag == _END and reported == 1:
                reported = 0
            return 0, 0, 0, 0, reported
        if tag == _HARM:
            insult = 2 if negation or insult == 2 else 1
        if tag == _INTENT and threat == 0:
            threat = 1
        if tag == _THREAT and threat == 1 and not negation:
            threat = 2
        if tag == _TARGET:
            target = 1
        negation = _SCOPE if tag == _NEG else max(0, negation - 1)
        if tag == _REPORT and not insult:
            reported = max(reported, 1)
        return insult, threat, target, negation, reported

    def kind(state: tuple[int, int, int, int, int]) -> int:
        insult, threat, target, _, reported = state
        if threat == 2 and target:
            return THREAT
        if reported:
            return REPORTED
        if insult == 2:
            return NEGATED
        return AIMED if target else PLAIN

    states = list(product(range(3), range(3), range(2), range(_SCOPE + 1), range(3)))
    numbers = {state: i for i, state in enumerate(states)}
    table = [[numbers[moved(state, tag)] for tag in range(_END + 1)] for state in states]
    return table, [kind(state) for state in states]


def features(word: str) -> list[str]:
    """The word itself, and its beginnings (marked)."""
    longest = min(LONGEST_BEGINNING, len(word) - 1)
    return [word, *(word[:n] + "*" for n in range(SHORTEST_BEGINNING, longest + 1))]


_NOTHING = (_OTHER, 0.0)
_KEPT_TAGS = 100_000


class _Tags(dict):
    """Tag and weight of a token, worked out at its first use; the latest ``_KEPT_TAGS`` are kept."""

    def __init__(self, lexicon: Mapping[str, float]) -> None:
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= _KEPT_TAGS:
            self.clear()
        self[token] = found = self._tag(token)
        return found

    def _tag(self, token: str) -> tuple[int, float]:
        if not token[0].isalpha():
            return (_SOFT if token in ",:" or token in _CLOSING else _END), 0.0
        weight = max((self.lexicon.get(one, 0.0) for one in features(token)), default=0.0)
        if weight:
            return _HARM, weight
        lists = ((_NEG, NEGATION), (_REPORT, REPORTING), (_TARGET, TARGETS), (_INTENT, INTENT), (_THREAT, THREATS))
        return next(((tag, 0.0) for tag, words in lists if token in words), _NOTHING)


@dataclass
class Grammar:
    """Scores texts: the composed transducers, the lexicon and the weights of the kinds."""

    lexicon: Mapping[str, float]
    weights: np.ndarray = field(default_factory=lambda: _PRIOR.copy())

    def reader(self) -> _Reader:
        return _Reader(self.lexicon)

    def score(self, evidence: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-float(self.weights[0] + evidence @ self.weights[1:])))


def _mark_quotations(tokens: list[str], tags: list[tuple[int, float]]) -> None:
    """Tag the marks that open and close quotations; those within one or without a closing mark stay as they are."""
    ends: dict[int, int | None] = {}
    later: dict[str, int] = {}
    for i in range(len(tokens) - 1, -1, -1):
        if tokens[i] == "\n":
            later = {}
        elif tokens[i] in _CLOSING:
            ends[i] = min((later[mark] for mark in _CLOSING[tokens[i]] if mark in later), default=None)
            later[tokens[i]] = i
    last = -1
    for i in reversed(ends):
        if i > last and ends[i] is not None:
            last = ends[i]
            tags[i], tags[last] = (_OPEN, 0.0), (_CLOSE, 0.0)


class _Reader:
    def __init__(self, lexicon: Mapping[str, float]) -> None:
        self.tags = _Tags(lexicon)
        self.table, self.kinds = composed()

    def clauses(self, text: str) -> Iterator[tuple[int, float]]:
        """Kind and weight of every clause that the grammar matches."""
        tokens = _TOKENS.findall(text.lower())
        tags = [self.tags[token] for token in tokens]
        if not any(tag in (_HARM, _THREAT) for tag, _ in tags):
            return
        _mark_quotations(tokens, tags)
        state, weight = 0, 0.0
        for tag, own in [*tags, (_END, 0.0)]:
            if tag >= _SOFT:
                kind = self.kinds[state]
                if weight or kind == THREAT:
                    yield kind, weight + (1.0 if kind == THREAT else 0.0)
                weight = 0.0
            state = self.table[state][tag]
            weight += own

    def evidence(self, text: str | None) -> np.ndarray:
        """Per kind, the logarithm of 1 plus the weights of its clauses."""
        sums = np.zeros(len(KINDS))
        for kind, weight in self.clauses(text or ""):
            sums[kind] += weight
        return np.log1p(sums)


def _lower_bound(toxic: np.ndarray, rows: np.ndarray, z: float = 2.0) -> np.ndarray:
    """Wilson's lower bound of a share."""
    share = toxic / rows
    middle = share + z * z / (2 * rows)
    spread = z * np.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))
    return np.clip((middle - spread) / (1 + z * z / rows), 1e-9, 1 - 1e-9)


def _surprise(toxic: np.ndarray, rows: np.ndarray, base: float) -> np.ndarray:
    """Minus the logarithm of Chernoff's bound: how unlikely chance is to give so many toxic rows."""
    share = np.clip(toxic / rows, 1e-12, 1 - 1e-12)
    divergence = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
    return np.where(share > base, rows * divergence, 0.0)


def _surprise_column(share: Column, rows: Column, base: float) -> Column:
    """``_surprise`` of a share above ``base``, as a column."""
    share = F.least(F.greatest(share, F.lit(1e-12)), F.lit(1 - 1e-12))
    return rows * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))


def _lexicon(counts: list[tuple[str, float, float]], base: float, tried: float = 1e6) -> dict[str, float]:
    """Weights of the features (name, toxic rows, rows) that chance would not give once in ``tried`` features.

    Listed insults start with 12 toxic rows.
    """
    known = {name: (toxic, rows) for name, toxic, rows in counts}
    for word in INSULTS:
        toxic, rows = known.get(word, (0.0, 0.0))
        known[word] = toxic + 12, rows + 12
    # A beginning counts if it tells more than the commonest longer feature that begins so.
    longer: dict[str, float] = {}
    for name, (toxic, _) in known.items():
        for one in features(name.rstrip("*")):
            if one.endswith("*") and one != name:
                longer[one] = max(longer.get(one, 0.0), toxic)
    names = [name for name, (toxic, _) in known.items() if toxic > 1.25 * longer.get(name, 0.0)]
    toxic, rows = np.array([known[name] for name in names]).T
    base = min(max(base, 0.01), 0.5)
    bound = _lower_bound(toxic, rows)
    weights = np.log(bound / (1 - bound)) - math.log(base / (1 - base))
    sure = _surprise(toxic, rows, base) >= math.log(max(tried, 2.0))
    found = {name: float(weight) for name, weight, ok in zip(names, weights, sure) if ok and weight > 0}
    # Nor does it count if it tells much less than one of those: others begin so too.
    best: dict[str, float] = {}
    for name, weight in found.items():
        for one in features(name.rstrip("*")):
            if one.endswith("*") and one != name:
                best[one] = max(best.get(one, 0.0), weight)
    return {name: weight for name, weight in found.items() if weight >= best.get(name, 0.0) - 1.0}


def _fitted(evidence: np.ndarray, toxic: np.ndarray, rows: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression, drawn towards the prior weights; by Newton's method."""
    x = np.hstack([np.ones((len(evidence), 1)), evidence])
    weights = _PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (rows * (p - toxic)) + ridge * (weights - _PRIOR)
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    # More evidence never lowers a score, and an insult aimed at someone is no milder.
    weights[1:] = np.maximum(weights[1:], 0.0)
    weights[1 + AIMED] = max(weights[1 + AIMED], weights[1 + PLAIN])
    return weights


def _sample_rows(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows, one of each id: _text, _toxic, _fold."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    one = one.groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_toxic"))
    # Labels may be those of a larger corpus: only ids that have a row here are counted against the bound.
    present = df.select(F.col(key).alias("_id")).distinct()
    chosen = one.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # A label is one of an id, so each id has one row, or its repeated rows would outweigh the others. Tasks pick
    # theirs before the shuffle, so however often an id is there, a task sends one text of it.
    least = F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text")).alias("_least")
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(least)
    fold = (F.xxhash64("_id", F.lit("fold")) % 2 != 0).cast("int")
    return rows.select("_least._text", F.col("_toxic").cast("int").alias("_toxic"), fold.alias("_fold"))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, since what is made of a text is larger than the text."""
    for batch in batches:
        yield from (batch.slice(start, rows) for start in range(0, len(batch), rows))


def _read_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches):
        found, hashes = [], []
        for text in batch.column(0).to_pylist():
            words = [token for token in _TOKENS.findall(text.lower()) if token[0].isalpha()]
            found.append(list({one for word in set(words) for one in features(word)}))
            shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
            prints = np.array([xxhash.xxh64_intdigest(one) for one in shingles], np.uint64)
            odd = (np.arange(_MINHASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            least = [int((prints * one).min()) >> 1 for one in odd]
            hashes.append([i << 60 ^ value for i, value in enumerate(least)])
        columns = [
            batch.column(1),
            batch.column(2),
            batch.column(3),
            pa.array(hashes, pa.list_(pa.int64())),
            pa.array(found, pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["_row", "_toxic", "_fold", "_prints", "_features"])


def fit_grammar(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = SAMPLE,
) -> Grammar:
    """A grammar from the rows of ``df`` that ``labels`` has a label for."""
    rows = _sample_rows(df, labels, key, text, label, sample)
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "toxic-sample")
    schema = "_row bigint, _toxic int, _fold int, _prints array<bigint>, _features array<string>"
    read = stored(rows.select("_text", "_row", "_toxic", "_fold").mapInArrow(_read_features, schema), "features")
    prints = read.select("_row", F.explode("_prints").alias("_print"))
    alike = prints.join(prints.groupBy("_print").agg(F.count("*").alias("_n")), "_print")
    weighted = alike.groupBy("_row").agg((1 / F.max("_n")).alias("_weight"))
    weights = stored(weighted, "row-weights")
    both = read.join(weights, "_row")
    n, n_toxic = both.agg(F.sum("_weight"), F.sum(F.col("_weight") * F.col("_toxic"))).first()
    if not n or not n_toxic or n_toxic >= n - 1e-9:
        return Grammar(_lexicon([], 0.1))
    base = n_toxic / n
    counted = both.select("_toxic", "_fold", "_weight", F.explode("_features").alias("_feature"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_weight")).otherwise(0.0))

    toxic, odd = F.col("_toxic") == 1, F.col("_fold") == 1
    sums = counted.groupBy("_feature").agg(
        total(toxic & ~odd).alias("t0"), total(~odd).alias("n0"), total(toxic & odd).alias("t1"), total(odd).alias("n1")
    )
    share = (F.col("t0") + F.col("t1")) / (F.col("n0") + F.col("n1"))
    sums = stored(sums, "feature-counts")
    tried = float(sums.where("n0 + n1 >= 3").count())
    telling = sums.where((F.col("t0") + F.col("t1") >= 3) & (share > min(0.5, 3 * base)))
    # Of all features tried, chance gives this much surprise to the square root of their number. What is no
    # surprise at all neither enters a lexicon nor holds up a beginning that does.
    surprise = _surprise_column(share, F.col("n0") + F.col("n1"), min(max(base, 0.01), 0.5))
    listed = F.col("_feature").isin(sorted(INSULTS))
    found = telling.where((surprise >= math.log(max(tried, 2.0)) / 2) | listed).orderBy("_feature").collect()
    lexicons = [
        _lexicon([(r[0], r[1 + 2 * f], r[2 + 2 * f]) for r in found if r[2 + 2 * f] > 0], base, tried)
        for f in (0, 1)
    ]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row is read with the lexicon of the other fold.
        readers = [_Reader(lexicons[1]), _Reader(lexicons[0])]
        for batch in _sliced(batches):
            texts, folds = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            values = [readers[fold].evidence(one).tolist() for one, fold in zip(texts, folds)]
            arrays = [batch.column(1), batch.column(2), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "_toxic", "_evidence"])

    schema = "_row bigint, _toxic int, _evidence array<double>"
    seen = rows.select("_text", "_row", "_toxic", "_fold").mapInArrow(evidence, schema).join(weights, "_row")
    fitted = seen.select("_toxic", "_weight", "_evidence").orderBy("_row").collect()  # at most ``sample`` rows
    x = np.array([r[2] for r in fitted]).reshape(len(fitted), len(KINDS))
    y, w = (np.array([r[i] for r in fitted], float) for i in (0, 1))
    whole = _lexicon([(r[0], r[1] + r[3], r[2] + r[4]) for r in found], base, tried)
    return Grammar(whole, _fitted(x, y, w))


def toxicity(text: Column, grammar: Grammar) -> Column:
    """Score from 0 to 1 of each text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = grammar.reader()
        for texts in batches:
            yield pa.array([grammar.score(reader.evidence(one.as_py())) for one in texts], pa.float64())

    return scored(text)


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    sample: int = SAMPLE,
) -> DataFrame:
    """``key``, held_out, score and predicted (1 from a score of 0.5) of every row.

    Rows whose id falls into the held-out fold are not learned from.
    """
    learned = labels.where(id_fold(F.col(key), folds) != held_out)
    grammar = fit_grammar(df, learned, key, text, label, sample)
    fold = F.coalesce(id_fold(F.col(key), folds) == held_out, F.lit(False))
    scored = df.select(
        F.col(key).alias("_key"), fold.alias("_held"), toxicity(F.col(text), grammar).alias("_score")
    )
    return scored.select(
        F.col("_key").alias(key),
        F.col("_held").alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    held_out: int = 0,
    sample: int = SAMPLE,
) -> DataFrame:
    """The rows of ``df`` with a score below 0.5, in all its columns."""
    learned = labels.where(id_fold(F.col(key), folds) != held_out)
    grammar = fit_grammar(df, learned, key, text, label, sample)
    return df.where(toxicity(F.col(text), grammar) < 0.5)
