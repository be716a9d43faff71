"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has one score, the mean of the weights that its distinct words hash to and the weights of its look, and ordered thresholds cut the scores into
grades: P(grade <= k) = sigmoid(threshold_k - score). All grades share the weights, so a rating of any grade teaches
all of them. From the fitted law follow a document's expected grade and the chance that it reaches a grade.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, set_aside, whole_text

BITS = 18
SCALE = 80.0  # a text's distinct words share this value
LEAST_WORDS = 200  # shorter texts do not give their words more than longer ones
TEXT_VALUE = 10.0  # of a feature of the whole text
SAMPLE = 6000  # rated documents used to fit, at most; those with the smallest hashed id
RARE = 1 / 300  # of the sample: places in fewer texts than this, at most MOST_RARE, get no weight
MOST_RARE = 20
STEPS, RATE, DECAY = 300, 0.2, 3e-5
GRADES = 3  # 0 toxic, 1 low quality, 2 good
KEEP_GRADE, KEEP_CHANCE = 2, 0.6
WORDS_KEPT = 300_000

_END = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the columns quality and toxic; the worst rating of a document counts, unrated rows do not."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def word_places(word: bytes) -> tuple[int, ...]:
    """Where a word's features hash to: the lower-cased word, its beginning, its ending punctuation, its look."""
    low, mask = word.lower(), (1 << BITS) - 1
    end = _END.search(word)
    look = b"U" if len(word) > 1 and word.isupper() else b"l"
    marks = (b"w" + low, b"p" + low[:5], b"e" + (end[0][:3] if end else b""), b"s" + look)
    return tuple(zlib.crc32(m) & mask for m in marks)


def text_places(words: list[bytes]) -> list[int]:
    """Where the look of a whole text hashes to: bands of four shares of its words."""
    n = max(1, len(words))
    shares = (
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(words)) / n,
        sum(w.isupper() for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1:] < b"\x80" and w[-1:] not in b".,;:?" for w in words) / n,
    )
    band = len(words).bit_length() // 3  # texts of other lengths repeat other shares of their words
    return [zlib.crc32(b"t%d %d %d" % (k, int(10 * s), band if k == 1 else 0)) & ((1 << BITS) - 1) for k, s in enumerate(shares)]


def features(text: str) -> tuple[list[int], list[float]]:
    words = text.encode().split()
    distinct = set(words)
    value: dict[int, float] = {}
    for word in sorted(distinct):
        for place in word_places(word):
            value[place] = value.get(place, 0.0) + SCALE / max(len(distinct), LEAST_WORDS)
    for place in text_places(words):
        value[place] = value.get(place, 0.0) + TEXT_VALUE
    return list(value), list(value.values())


class Ordinal:
    """Weights and ordered thresholds; `fit` on (row, place, value) triples and grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: np.ndarray, places: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int = GRADES) -> "Ordinal":
        """Adam on the mean log-likelihood. Thresholds are a first one and the logarithms of the gaps, so their order holds."""
        n, size = len(grades), 1 << BITS
        common = np.bincount(places, minlength=size)[places] >= min(MOST_RARE, n * RARE)
        rows, places, values = rows[common], places[common], values[common]
        params = np.zeros(size + n_grades - 1)
        share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] + 0.5
        start = np.log(share / (n + 1 - share))
        params[size] = start[0]
        params[size + 1:] = np.log(np.maximum(np.diff(start), 0.05))
        mean, spread = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            cuts = cls._cuts(params[size:])
            score = np.bincount(rows, values * params[places], minlength=n)
            below, above = np.concatenate(([-np.inf], cuts))[grades], np.concatenate((cuts, [np.inf]))[grades]
            lo, hi = _sigmoid(below - score), _sigmoid(above - score)
            chance = np.maximum(hi - lo, 1e-12)
            d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
            slope = np.zeros_like(params)
            slope[:size] = np.bincount(places, values * ((d_hi - d_lo)[rows] / n), minlength=size) + DECAY * params[:size]
            by_cut = np.array([(-d_hi[grades == k].sum() + d_lo[grades == k + 1].sum()) / n for k in range(n_grades - 1)])
            gaps = np.concatenate(([1.0], np.exp(params[size + 1:])))
            slope[size:] = np.cumsum(by_cut[::-1])[::-1] * gaps
            mean = 0.9 * mean + 0.1 * slope
            spread = 0.999 * spread + 0.001 * slope**2
            params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        return cls(params[:size].copy(), cls._cuts(params[size:]))

    @staticmethod
    def _cuts(free: np.ndarray) -> np.ndarray:
        return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))

    def scorer(self):
        """A function from text to score that remembers the weights of words."""
        known: dict[bytes, float] = {}
        weights = self.weights

        def score(text: str) -> float:
            words = text.encode().split()
            if len(known) > WORDS_KEPT:
                known.clear()
            distinct = sorted(set(words))
            for word in distinct:
                if word not in known:
                    known[word] = float(weights[list(word_places(word))].sum())
            mean = sum(map(known.__getitem__, distinct)) / max(len(distinct), LEAST_WORDS)
            return SCALE * mean + TEXT_VALUE * float(weights[text_places(words)].sum())

        return score

    def law(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the chance of at least each grade from 1 on."""
        tails = 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])
        return tails.sum(axis=1), tails


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most `sample` rated documents, those whose hashed ids come first.

    Features are made where the texts are; the driver gets the sample's, whose number is the bound times the words of a
    document. Without any rated document all weights are 0 and every document is equally likely to have any grade.
    """
    chosen = ratings(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = docs.select("doc_id", whole_text(docs).alias("text")).join(F.broadcast(chosen), "doc_id")

    def made(texts: list[str]) -> dict:
        pairs = [features(t) for t in texts]
        return {"places": [p for p, _ in pairs], "values": [v for _, v in pairs]}

    found = map_rows(rated, made, "places array<int>, values array<float>", ["text"], ["doc_id", "grade"]).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    places = found.column("places").combine_chunks()
    if not len(found):
        return Ordinal(np.zeros(1 << BITS), np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1)))
    sizes = np.array([len(p) for p in places])
    return Ordinal.fit(
        np.repeat(np.arange(len(found)), sizes), np.asarray(places.flatten()),
        np.asarray(found.column("values").combine_chunks().flatten(), dtype=np.float64), np.asarray(found.column("grade")),
    )


def grade_documents(docs: DataFrame, model: Ordinal, keep: list[str]) -> DataFrame:
    """The columns `keep`, with score, expected_grade and tail_1, tail_2 (chance of at least that grade) of every row."""
    held = {}  # the scorer of a task

    def graded(texts: list[str]) -> dict:
        if not held:
            held["score"] = model.scorer()
        score = held["score"]
        scores = np.array([score(t) for t in texts], dtype=np.float64)
        expected, tails = model.law(scores)
        return {"score": scores, "expected_grade": expected} | {f"tail_{k + 1}": tails[:, k] for k in range(tails.shape[1])}

    fields = "score double, expected_grade double, " + ", ".join(f"tail_{k} double" for k in range(1, len(model.thresholds) + 1))
    texts = docs.withColumn("_text", whole_text(docs))
    return map_rows(texts, graded, fields, ["_text"], keep)


def accepted() -> Column:
    """Whether a graded document is good with a chance of KEEP_CHANCE or more."""
    return F.col(f"tail_{KEEP_GRADE}") >= KEEP_CHANCE


def select_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, expected_grade, tail_1 and tail_2 of the rows of `docs` (doc_id, text) that the classifier fitted
    on `labels` accepts.

    Null text counts as empty and has score 0, as the average of nothing. Repeated rows are judged alike. Labels without
    a document, with nulls or twice for a document are no error. An empty table gives no rows. Further columns are
    ignored; `keep_accepted` keeps them.
    """
    return grade_documents(docs, fit(docs, labels, sample), ["doc_id"]).where(accepted())


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The accepted rows of `docs`, with their own columns and no others."""
    rows, own = set_aside(docs, {"score", "expected_grade", "tail_1", "tail_2"})
    return grade_documents(rows, fit(docs, labels, sample), rows.columns).where(accepted()).select(*own)
