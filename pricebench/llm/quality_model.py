"""Quality classifier without hand labels.

Heuristic labellers vote good, bad or not at all on every document.  A document
counts only through its pattern of votes, so expectation-maximisation runs on a
table of patterns (at most 3 to the number of labellers, whatever the corpus
holds): it estimates how often each labeller votes each way on good documents and
on each kind of bad ones, and with that the probability that a pattern is of a
good one.  Bad text comes in kinds (one is seeded by each labeller), because a
labeller that knows one kind is blind to the others.  These posteriors, not the votes, are the labels of a linear scorer over hashed word
shapes and neighbours; the scorer decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm.common import cut_lineage, released, share_of, text_batches
from pricebench.llm.stop_words import STOP_WORDS

#: Documents the scorer is trained on, in expectation; counts and posteriors come from all documents.
SAMPLE = 12_000
BITS = 16
TRAINERS, EPOCHS = 4, 6
THRESHOLD = 0.5
_SCALE = 8.0
SMALLEST = 5  # words below which no labeller votes

GOOD, BAD, NONE = "g", "b", "-"
LABELLERS = 10
_SHOUT, _PLAIN, _SYMBOL, _BAR, _CRY, _END, _STOP = (1 << i for i in range(7))
_SYMBOLS = frozenset("#*$%&|<>")
_MARKS = ".,;:!?\"'()»«…-–"


def _kind(c: str) -> str:
    """What a character is for a shape: a capital, a small letter, a digit, white space or itself."""
    return " " if c.isspace() else "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c


_LATIN = bytes(ord(_kind(chr(i))) if ord(_kind(chr(i))) < 256 else 63 for i in range(256))


class _Kinds(dict):
    """Kinds of characters beyond the first 256 code points."""

    def __missing__(self, c: int) -> str:
        self[c] = k = _kind(chr(c))
        return k


class _Shapes(dict):
    """Shape of a word, letter by letter, to its code: flags below, then the hash of the shape with its runs cut to one or two."""

    def __missing__(self, shape: bytes | str) -> int:
        word = shape.decode("latin-1") if isinstance(shape, bytes) else shape
        core = word.strip(_MARKS)
        flags = (
            _SHOUT * (len(core) > 1 and set(core) == {"X"}) | _PLAIN * (bool(core) and set(core) <= {"X", "x"} and "!!" not in word)
            | _SYMBOL * (not _SYMBOLS.isdisjoint(word)) | _BAR * (word == "|") | _CRY * (word[-1] == "!") | _END * (word[-1] in ".!?")
        )
        runs = "".join(c for i, c in enumerate(word) if i < 2 or not c == word[i - 1] == word[i - 2])
        if len(self) >= 100_000:
            self.clear()
        self[shape] = code = flags | xxhash.xxh3_64_intdigest(runs) % (1 << BITS) << 8
        return code


_shapes, _kinds = _Shapes(), _Kinds()


class Words(NamedTuple):
    """The words of a text as numbers: codes of their shapes (with the flag of function words), and their hashes."""

    codes: np.ndarray
    hashes: np.ndarray


def words_of(text: str | None) -> Words:
    text = text or ""
    try:
        shapes: list = text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        shapes = text.translate(_kinds).split()
    words = text.split()
    codes = np.fromiter(map(_shapes.__getitem__, shapes), np.int64, len(words))
    stop = np.fromiter(map(STOP_WORDS.__contains__, text.lower().split()), bool, len(words))
    return Words(codes | stop * _STOP, np.fromiter(map(hash, words), np.int64, len(words)))


#: Which flags each value of the low byte holds, in the order of their names.
_FLAGS = (np.arange(128)[:, None] & np.array([_SHOUT, _PLAIN, _SYMBOL, _BAR, _CRY, _END, _STOP]) != 0).astype(float)


def _vote(value: float, bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def votes(words: Words) -> str:
    """One letter for each labeller.  They overlap, and none of them knows all kinds of bad text."""
    codes, hashes = words
    n = len(codes)
    if n < SMALLEST:
        return NONE * LABELLERS
    shout, plain, symbol, bar, cry, end, stop = (np.bincount(codes & 127, minlength=128) @ _FLAGS / n).tolist()
    repeated = np.count_nonzero(hashes[1:] == hashes[:-1]) / (n - 1)
    distinct = len(np.unique(hashes)) / n
    triples = hashes[2:] * 5 + hashes[1:-1] * 3 + hashes[:-2]
    new = len(np.unique(triples)) / len(triples)
    return "".join((
        _vote(symbol, symbol > 0.15, symbol < 0.03),
        _vote(shout, shout > 0.5, shout < 0.1),
        _vote(repeated, repeated > 0.2, repeated < 0.05),
        _vote(distinct, distinct < 0.15 and n < 2000, distinct > 0.45),
        _vote(plain, plain < 0.5, plain > 0.85),
        _vote(stop, stop < 0.02 and n >= 40, stop > 0.12),
        _vote(bar, bar > 0.1, False),
        _vote(cry, cry > 0.3, cry < 0.05),
        _vote(new, new < 0.5, new > 0.8),
        _vote(end, (end > 0.6 or end < 0.005) and n >= 40, 0.02 < end < 0.4),
    ))


def _hashes(words: Words) -> np.ndarray:
    """Hashed features of a text, with repeats: shapes (apart for function words), pairs of them, repeated words."""
    shape = (words.codes >> 8) * 2 + (words.codes & _STOP != 0) & (1 << BITS) - 1
    pair = shape[1:] * 31 + shape[:-1] * 17 + 7 & (1 << BITS) - 1
    same = np.ones(np.count_nonzero(words.hashes[1:] == words.hashes[:-1]), np.int64)
    return np.concatenate([shape, pair, same])


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed features of a text with words, and their weights."""
    index, count = np.unique(_hashes(words), return_counts=True)
    return index, count * (_SCALE / len(words.codes))


def estimate(patterns: pd.DataFrame, rounds: int = 100) -> pd.DataFrame:
    """Posterior of each pattern (votes, n) by expectation-maximisation, and the labellers' rates in ``.attrs``.

    Classes are good and one kind of bad per labeller.  A pattern starts as bad,
    of the kinds of those that object, if at least two labellers object: what a
    single one says needs support.  Every class has a smoothed rate of each vote
    for each labeller, so one that never speaks, or always says the same,
    carries no weight.
    """
    n = patterns["n"].to_numpy(float)
    cast = np.array([list(v) for v in patterns["votes"]]) if len(n) else np.full((0, LABELLERS), NONE)
    is_vote = np.stack([cast == GOOD, cast == BAD, cast == NONE], 2).astype(float)  # pattern, labeller, vote
    spoke, against = (cast != NONE).any(1), (cast == BAD).sum(1)
    kinds = np.where(against[:, None] > 1, (cast == BAD) / np.maximum(against, 1)[:, None], 1.0 / LABELLERS)
    good = np.where(against > 1, 0.05, 0.95)
    share = np.concatenate([good[:, None], (1 - good)[:, None] * kinds], 1).T  # class, pattern
    rates = np.full((1 + LABELLERS, LABELLERS, 3), 1 / 3)
    for _ in range(rounds):
        before, w = share, share * n * spoke
        rates = np.einsum("cp,plv->clv", w, is_vote) + 1.0
        rates /= rates.sum(2, keepdims=True)
        prior = (w.sum(1) + 1) / (w.sum() + 1 + LABELLERS)
        score = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(rates), is_vote)
        share = np.exp(score - score.max(0))
        share /= share.sum(0)
        share = np.where(spoke, share, prior[:, None])
        if np.abs(share - before).max(initial=0) < 1e-6:
            break
    out = patterns.assign(posterior=share[0])
    out.attrs["rates"] = rates
    return out


def _pattern_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([votes(words_of(t)) for t in texts], dtype=object)


def _pattern():
    @F.pandas_udf("string")
    def pattern(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(_pattern_of)(batches)

    return pattern


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights by adaptive gradient steps over one part of the sample, in hash order."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    docs = pd.concat(parts, ignore_index=True).sort_values("order", kind="stable")
    w, g = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    rows = [(features(words), p) for t, p in zip(docs["text"], docs["posterior"]) if len((words := words_of(t)).codes)]
    for _ in range(EPOCHS):
        for (index, value), p in rows:
            error = 1 / (1 + np.exp(-np.clip(w[index] @ value + w[-1], -30, 30))) - p
            step = error * value + 1e-5 * w[index]
            g[index] += step * step
            w[index] -= 0.3 * step / np.sqrt(g[index])
            g[-1] += error * error
            w[-1] -= 0.3 * error / np.sqrt(g[-1])
    index = np.flatnonzero(w)
    yield pd.DataFrame({"index": index, "weight": w[index] * len(rows), "n": float(len(rows))})


class QualityModel:
    """Posterior of each pattern of votes, and the scorer's weights (the last one is the bias)."""

    def __init__(self, posteriors: pd.DataFrame, weights: np.ndarray):
        self.posteriors, self.weights = posteriors, weights

    def score(self, words: Words) -> float:
        """Probability that a text is good; 0 without words."""
        if not len(words.codes):
            return 0.0
        sum_ = self.weights[_hashes(words)].sum() * (_SCALE / len(words.codes)) + self.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum_))))


def _chosen(docs: DataFrame, part: float) -> DataFrame:
    """(text, order) of about this part of the documents."""
    order = F.xxhash64(F.isnull("doc_id"), "doc_id", "text")
    chosen = docs.select("text", order.alias("order")).where(F.col("text").isNotNull() & share_of(F.col("order"), part))
    return chosen.dropDuplicates(["order"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Votes are counted over all documents; the scorer learns from about ``sample`` of them, chosen by hash.

    Copies are chosen one by one, by text and doc_id; rows that repeat both count once in the sample.
    """
    docs = text_batches(docs)
    voted = cut_lineage(docs.select(_pattern()("text").alias("votes")))
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).toPandas()  # at most 3 ** LABELLERS rows
    posteriors = estimate(counted.sort_values("votes", ignore_index=True))
    total = int(posteriors["n"].sum())
    weights = np.zeros((1 << BITS) + 1)
    if not total:
        return QualityModel(posteriors, weights)
    part = min(1.0, sample / total)
    chosen = _chosen(docs, part)
    by_pattern = docs.sparkSession.createDataFrame(posteriors[["votes", "posterior"]])
    labelled = chosen.withColumn("votes", _pattern()("text")).join(F.broadcast(by_pattern), "votes").select("text", "order", "posterior")
    trained = labelled.repartition(TRAINERS, F.pmod(F.shiftright("order", 20), F.lit(TRAINERS))).mapInPandas(released(_train), "index long, weight double, n double")
    trained = cut_lineage(trained)
    if not trained.limit(1).count() and docs.where(F.col("text").isNotNull()).limit(1).count():
        raise ValueError(f"no document was chosen for training: {sample} of {total}")
    # The bias is never zero, so its rows tell how much every trainer has seen.
    seen = trained.where(F.col("index") == 1 << BITS).agg(F.sum("n")).first()[0] or 1.0
    for index, weight in trained.groupBy("index").agg(F.sum("weight")).collect():  # at most 2 ** BITS + 1 rows
        weights[index] = weight / seen
    return QualityModel(posteriors, weights)


def _scored(model: QualityModel, spark: SparkSession):
    shared = spark.sparkContext.broadcast((model.posteriors[["votes", "posterior"]], model.weights))

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        posteriors, weights = shared.value
        model, posterior = QualityModel(posteriors, weights), dict(zip(posteriors["votes"], posteriors["posterior"]))
        for texts in batches:
            rows = []
            for t in texts:
                words = words_of(t)
                v = votes(words)
                rows.append((v, posterior.get(v), model.score(words)))
            yield pd.DataFrame(rows, columns=["votes", "posterior", "score"])

    @F.pandas_udf("votes string, posterior double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(judged)(batches)

    return score


def classify(docs: DataFrame, model: QualityModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): votes, posterior, score, kept.

    A null or empty text has no votes, score 0 and is not kept.  A text of fewer
    than five words gets no votes; its posterior is the share of good documents,
    and its score decides.  A pattern of votes that the model has not met has a
    null posterior.  Repeated rows get the same result, null doc_ids are carried,
    an empty table gives no rows, other columns are not read.
    """
    model = model or fit(docs)
    scored = text_batches(docs).select("doc_id", _scored(model, docs.sparkSession)("text").alias("s"))
    return scored.select("doc_id", "s.votes", "s.posterior", "s.score", (F.col("s.score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without what the model fitted on them rejects, columns unchanged; nothing is shuffled."""
    score = _scored(fit(docs), docs.sparkSession)("text")
    return docs.withColumn("__s", score).where(F.col("__s.score") >= threshold).select(*docs.columns)


def op5_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    out = classify(spark.read.parquet(f"{folder}/documents.parquet"))
    return out.select("doc_id", "votes", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")
