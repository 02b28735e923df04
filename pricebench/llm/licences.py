"""Licence scan: a trained classifier of paragraphs, confirmed by templates.

Paragraphs (neighbouring lines without their comment marks, in overlapping
windows when long) are described by the word pairs and triples they share with the licence templates.  A multinomial
logistic regression over these sparse features tells the licence family.  It is
trained on the templates, with words dropped and ordinary text around them,
against paragraphs of the corpus and sentences that use the same words
otherwise.  A window that is unknown as a whole, because several notices or other text
compete, is read in shorter parts, and again without the words of notices found.  Its temperature and the threshold below which a paragraph is unknown
are set on held-out examples.  A prediction counts only if the paragraph holds
enough of one of the family's templates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm.common import share_of, text_batches
from pricebench.llm.licence_templates import OTHERS, TEMPLATES
from pricebench.llm.stop_words import STOP_WORDS

UNKNOWN = "unknown"
#: Corpus paragraphs that stand for other text in training, in expectation; the scan itself covers everything.
SAMPLE = 2_000
WINDOW, STEP = 80, 30  # words; what is no longer than WINDOW - STEP lies whole in some window
PARTS = (60, 44, 32, 23, 16, 11, 8, 6, 4)  # words of the parts in which a window is read that is unknown as a whole
VARIANTS = 16  # training examples made from one template
CLOSE = 0.05  # probability from which a family is compared with its templates as well
ALIKE = 0.6  # part of a template's word pairs that confirms a prediction
FALSE_ALARMS = 0.001  # of held-out other text above the threshold
_CUE = re.compile(r"licen[cs]|copyright|rights reserved|spdx|creative commons|public domain|\bCC[ -]", re.I)
#: Comment marks at the start of a line, and signs without letters at its end.
_MARKS = re.compile(r"\s*(?:(?:[#*/;%>|!+=~-]+|<!--|\(\*|\{-|\.\.|@c|dnl|rem|REM)(?=\s|$)\s*|[#*/;%>|!]+\s*)*")
_END_MARKS = re.compile(r"(?:\s+[^\w\s]+)+\s*$|\*+/\s*$")
_STRIP = ".,;:!?\"'()[]{}<>*_`“”«»"


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_STRIP))]


class _Memory(dict):
    """Raw word to its number; bounded."""

    def __init__(self, word: dict[str, int]):
        super().__init__()
        self.word = word

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[raw] = i = self.word.get(raw.lower().strip(_STRIP), 0)
        return i

    def __reduce__(self):  # what was met in one process isn't sent to others
        return _Memory, (self.word,)


class Vocabulary:
    """Words of the templates, and the pairs and triples of neighbours among them."""

    def __init__(self, texts: list[str]):
        sequences = [words_of(t) for t in texts]
        self.word = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        self.base = len(self.word) + 1
        grams = sorted({g for s in sequences for g in self._grams(self._ids(s)).tolist()})
        self.grams = np.array(grams, np.int64)
        self.memory = _Memory(self.word)

    def _ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.word.get(w, 0) for w in words), np.int64, len(words))

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        two = ids[:-1] * self.base + ids[1:]
        three = two[:-1] * self.base + ids[2:] + self.base**3
        return np.concatenate([two[(ids[:-1] > 0) & (ids[1:] > 0)], three[(ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)]])

    def ids_of(self, raw: list[str]) -> np.ndarray:
        """Word numbers of raw words, 0 for words no template has."""
        return np.fromiter(map(self.memory.__getitem__, raw), np.int64, len(raw))

    def features(self, ids: np.ndarray) -> np.ndarray:
        """Positions of the template pairs and triples among these words."""
        g = np.unique(self._grams(ids))
        at = np.searchsorted(self.grams, g)
        at = at[at < len(self.grams)] if len(self.grams) else at[:0]
        return at[np.isin(self.grams[at], g)]


def _examples(other: list[str], rng) -> tuple[list[str], list[str]]:
    """Texts and families: variants of the templates, and other text."""
    texts, families = [], []
    fill = [w for t in other for w in t.split()[:60]] or ["text"]
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = t.split()
            for i in range(VARIANTS):
                kept = [w for w in words if i == 0 or len(words) < 6 or rng.random() > 0.08]
                around = [rng.choice(fill, rng.integers(0, 20)).tolist() if i % 2 else [] for _ in range(2)]
                texts.append(" ".join([*around[0], *kept, *around[1]]))
                families.append(family)
    for t in [*other, *OTHERS * VARIANTS]:
        words = t.split()
        texts.append(" ".join(w for w in words if rng.random() > 0.05))
        families.append(UNKNOWN)
    return texts, families


class LicenceModel:
    def __init__(self, other: list[str], epochs: int = 150):
        rng = np.random.default_rng(10)
        self.families = [*TEMPLATES, UNKNOWN]
        self.vocabulary = Vocabulary([t for ts in TEMPLATES.values() for t in ts] + list(OTHERS))
        self.templates = {f: [self._pairs(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.times = {f: [self._times(t) for t in ts] for f, ts in TEMPLATES.items()}
        # Pairs of function words tell nothing.  As no template consists of so many of them that the others could be
        # missing from a confirmed paragraph, a text without any telling pair has no notice.
        plain = np.array([0, *(w in STOP_WORDS for w in self.vocabulary.word)], bool)
        self.telling = np.zeros(self.vocabulary.base**2, bool)
        for t in (t for ts in self.templates.values() for t in ts):
            tells = t[~(plain[t // self.vocabulary.base] & plain[t % self.vocabulary.base])]
            if 1 - len(tells) / len(t) >= ALIKE:
                raise ValueError("a template of function words")
            self.telling[tells] = True
        texts, families = _examples(other, rng)
        rows = [self.vocabulary.features(self.vocabulary.ids_of(t.split())) for t in texts]
        y = np.array([self.families.index(f) for f in families])
        held = rng.random(len(y)) < 0.2
        n, classes = len(self.vocabulary.grams), len(self.families)
        # Sparse rows as entries (example, feature), summed by example one way and by feature the other.
        take = np.array([i for i in np.flatnonzero(~held) if len(rows[i])])
        sizes = np.array([len(rows[i]) for i in take])
        feature = np.concatenate([rows[i] for i in take])
        example, starts = np.repeat(np.arange(len(take)), sizes), np.cumsum(sizes) - sizes
        by_feature = np.argsort(feature, kind="stable")
        present, feature_starts = np.unique(feature[by_feature], return_index=True)
        self.w, self.b, self.temperature = np.zeros((n, classes)), np.zeros(classes), 1.0
        target = np.eye(classes)[y[take]]
        weight = 1 / np.bincount(y[take], minlength=classes)[y[take]]  # every family counts the same
        g = np.full_like(self.w, 1e-6)
        for _ in range(epochs):
            logits = np.add.reduceat(self.w[feature], starts)
            error = (_softmax(logits + self.b) - target) * weight[:, None]
            step = 1e-4 * self.w
            step[present] += np.add.reduceat(error[example[by_feature]], feature_starts)
            g += step**2
            self.w -= 0.5 * step / np.sqrt(g)
            self.b -= 0.5 * error.sum(0)
        logits = np.array([self.w[rows[i]].sum(0) + self.b for i in np.flatnonzero(held)])
        truth = y[held]
        # Calibration: the temperature of least loss, then the threshold that few other texts pass.
        grid = np.geomspace(0.25, 8, 40)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / self.temperature)
        self.accuracy = float((p.argmax(1) == truth).mean())
        alarm = p[truth == classes - 1, :-1].max(1)
        self.threshold = max(0.5, float(np.quantile(alarm, 1 - FALSE_ALARMS)) if len(alarm) else 0.5)

    def _pairs(self, text: str) -> np.ndarray:
        ids = self.vocabulary._ids(words_of(text))
        return np.unique(ids[:-1] * self.vocabulary.base + ids[1:])

    def _times(self, text: str) -> Counter:
        ids = self.vocabulary._ids(words_of(text))
        return Counter((ids[:-1] * self.vocabulary.base + ids[1:]).tolist())

    def classify(self, ids: np.ndarray) -> tuple[str, float, float]:
        """Family, probability, and the largest part of one of the family's templates that these words hold."""
        at = self.vocabulary.features(ids)
        if not len(at):
            return UNKNOWN, 0.0, 0.0
        p = _softmax(((self.w[at].sum(0) + self.b) / self.temperature)[None])[0]
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.threshold:
            return UNKNOWN, float(p[best]), 0.0
        pairs = np.unique(ids[:-1] * self.vocabulary.base + ids[1:])
        # Families that the classifier can hardly tell apart are told apart by their templates.
        close = [k for k in np.flatnonzero(p[:-1] >= min(CLOSE, p[best])) if self.families[k] != UNKNOWN]
        alike = {k: max(np.isin(t, pairs, assume_unique=True).mean() for t in self.templates[self.families[k]]) for k in close}
        best = max(close, key=lambda k: (alike[k], p[k]))
        return (self.families[best] if alike[best] >= ALIKE else UNKNOWN), float(p[best]), float(alike[best])

    def _tells(self, ids: np.ndarray) -> bool:
        return bool(self.telling[ids[:-1] * self.vocabulary.base + ids[1:]].any())

    def _notice(self, ids: np.ndarray) -> tuple[str, float, float, np.ndarray] | None:
        """Family, probability, likeness and places of the word pairs of one notice among these words."""
        found = self.classify(ids)
        if found[0] == UNKNOWN:
            # Several notices compete, or other text does: the classifier reads shorter and shorter parts of these words.
            for size in PARTS:
                best = None
                for i in range(0, len(ids) - size + 1, max(1, size // 4)) if size < len(ids) else ():
                    part = ids[i : i + size]
                    if self._tells(part) and (told := self.classify(part))[0] != UNKNOWN and (best is None or told[1:] > best[1][1:]):
                        best = i, told
                if best:
                    i, found = best
                    return *found, self._confirming(ids[i : i + size], found[0]) + i
            return None
        return *found, self._confirming(ids, found[0])

    def _confirming(self, ids: np.ndarray, family: str) -> np.ndarray:
        """Places of the word pairs of the family's template that confirms these words."""
        pairs = ids[:-1] * self.vocabulary.base + ids[1:]
        # Of the confirmed templates the longest: short ones may be part of it.
        held = [np.isin(t, pairs) for t in self.templates[family]]
        k = max((k for k, h in enumerate(held) if h.mean() >= ALIKE), key=lambda k: held[k].sum())
        return self._places(pairs, self.times[family][k])

    def _places(self, pairs: np.ndarray, times: Counter) -> np.ndarray:
        """Places of a template's pairs where they stand most densely, so that strays and further notices stay out."""
        at = np.flatnonzero(np.isin(pairs, list(times))).tolist()
        best, part = -1e9, at
        for i in range(len(at)):
            seen, taken = Counter(), []
            for k in at[i:]:
                pair = int(pairs[k])
                if seen[pair] < times[pair]:
                    seen[pair] += 1
                    taken.append(k)
                    score = len(taken) - 0.25 * (k - at[i] + 1 - len(taken))
                    if score > best and len(seen) >= ALIKE * len(times):
                        best, part = score, taken[:]
        return np.array(part, np.int64)

    def _scan_paragraph(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, str, float, float]]:
        """(first word, last word, start and end of the window, family, probability, likeness) of each notice of a paragraph."""
        for i in range(0, max(1, len(ids) - (WINDOW - STEP)), STEP):
            while self._tells(ids[i : i + WINDOW]):
                start, found = i, self._notice(ids[i : i + WINDOW])
                if not found:
                    break
                if i + WINDOW < len(ids):  # the notice may go on behind this window
                    again = self._notice(ids[i + found[3][0] : i + found[3][0] + WINDOW])
                    if again and again[0] == found[0] and again[2] >= found[2]:
                        start, found = i + int(found[3][0]), again
                family, p, alike, at = found
                at = at + start
                ids[at], ids[at + 1] = 0, 0
                yield int(at[0]), int(at[-1]) + 1, start, min(len(ids), start + WINDOW), family, p, alike

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """(start, length, family, probability, likeness) of each licence notice, in order; code points of the text.

        A notice goes to the ends of its first and last line, or of the window when these are longer, or to the next notice.
        """
        out: list[tuple[int, int, str, float, float]] = []
        if not text or not self._tells(self.vocabulary.ids_of(text.split())):
            return out
        for paragraph in _paragraphs(text):
            words = [w for _, line in paragraph for w in line.split()]
            ids = self.vocabulary.ids_of(words)
            if not self._tells(ids):
                continue
            # Start and end of each word, and the lines of these.
            spans = [(at + m.start(), at + m.end(), n, n) for n, (at, line) in enumerate(paragraph) for m in re.finditer(r"\S+", line)]
            for i in range(len(spans) - 2, -1, -1):  # words broken at their hyphen
                if spans[i][3] < spans[i + 1][2] and words[i][-1] == "-" and self.vocabulary.ids_of([words[i] + words[i + 1]])[0]:
                    words[i : i + 2] = [words[i] + words[i + 1]]
                    spans[i : i + 2] = [(spans[i][0], spans[i + 1][1], spans[i][2], spans[i + 1][3])]
            ids = self.vocabulary.ids_of(words)
            found, end = sorted(self._scan_paragraph(ids)), 0
            for k, (first, last, low, high, family, p, alike) in enumerate(found):
                low, high = max(low, end), min(high, found[k + 1][0] if k + 1 < len(found) else high)
                while first > low and spans[first - 1][3] == spans[first][2]:
                    first -= 1
                while last + 1 < high and spans[last + 1][2] == spans[last][3]:
                    last += 1
                end = last + 1
                out.append((spans[first][0], spans[last][1] - spans[first][0], family, p, alike))
        return sorted(out, key=lambda x: x[:3])


def _paragraphs(text: str) -> Iterator[list[tuple[int, str]]]:
    """Neighbouring lines up to a blank one, each with its place in the text, without comment marks."""
    at, lines = 0, []
    for line in text.split("\n"):
        skip = _MARKS.match(line).end()
        body = _END_MARKS.sub("", line[skip:])
        if body.strip():
            lines.append((at + skip, body))
        elif lines:
            yield lines
            lines = []
        at += len(line) + 1
    if lines:
        yield lines


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, sample: int = SAMPLE) -> LicenceModel:
    """Trains on the templates and on about ``sample`` paragraphs of ``docs`` without any licence word, chosen by hash."""
    n = docs.count()
    part = min(1.0, sample / max(1, n))
    chosen = docs.select("text").where(F.col("text").isNotNull() & share_of(F.xxhash64("text"), part)).distinct()
    # One paragraph of each chosen document, by hash as well; its first words suffice as an example of other text.
    lines = F.split("text", "\n")
    line = F.element_at(lines, (F.pmod(F.xxhash64("text", F.lit(1)), F.size(lines)) + 1).cast("int"))
    rows = chosen.select(F.array_join(F.slice(F.split(line, r"\s+"), 1, 120), " ").alias("line")).orderBy("line").collect()
    return LicenceModel([r["line"] for r in rows if r["line"].strip() and not _CUE.search(r["line"])])


SPANS = "array<struct<start: int, length: int, family: string, probability: double, likeness: double>>"


def find_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """``docs`` with ``spans``, the licence notices of each whole text in order.

    A null or empty text has none.  Rows are independent: repeated rows repeat,
    null ids are carried, an empty table stays empty (the model is then trained
    on the templates alone), other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start", "length", "family", "probability", "likeness")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s)) for s in shared.value.scan(t)] for t in texts], dtype=object)

    return text_batches(docs).withColumn("spans", scan(F.col("text")))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the families found, their number, the least probability and likeness among them, and where they are."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    s = find_licences(docs)
    return s.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct("spans.family")), ",").alias("families"), F.size("spans").cast("long").alias("n_notices"),
        F.round(F.array_min("spans.probability"), 4).alias("least_probability"), F.round(F.array_min("spans.likeness"), 4).alias("least_likeness"),
        F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["family"].alias("family"))).alias("places"))
