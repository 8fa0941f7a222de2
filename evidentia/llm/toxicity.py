"""Toxicity: a logistic classifier that identity terms must not move.

Features are the presence of words (lower-cased runs of letters, digits and signs inside them) and of word
starts of 4 to 8 letters, which find inflected and compounded insults. From a sample of at most
``SAMPLE`` labelled rows a class, of at most ``SAMPLE_CHARS`` code points each, Spark counts in how many distinct
texts of either class each feature stands; the ``FEATURES`` most telling are the vocabulary, and so is every
identity term that the sample or its swapped texts hold, telling or not.

Training minimises the log loss plus ``PENALTY`` times the squared change of the score when each
labelled text's identity terms are swapped for others of their group, so that a neutral mention of a
group is not what makes a text toxic. The terms are a parameter; ``IDENTITY_TERMS`` are of four languages.
Labels, lang, source and doc_id are no inputs of a score.

Values: a null text is empty. Rows of one doc_id are scored each by its text; null doc_ids are handed on, not held
out, and have no label. A text that is labelled both ways is not learnt from. Without rows of both classes, or any
telling feature, to learn from every score is 0 (nothing is rejected). An empty table gives an empty result. Other
columns are not read, and handed on by ``keep_clean`` whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, frugal, held_out, small_batches, text_of
from evidentia.llm.quality import labelled_sample

SAMPLE = 8000
SAMPLE_CHARS = 200_000
FEATURES = 4000
#: A feature counts from so many distinct texts on.
LEAST_TEXTS = 5
#: The log odds, less a standard error, from which a feature tells a text toxic.
ODDS = 2.0
#: Features that a task counts before it hands them on.
COUNTED = 400_000
PENALTY = 4.0
THRESHOLD = 0.5

#: Terms that name groups of people; a term is swapped for the next of its line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "european", "american", "arab", "chinese", "indian"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("old", "young"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"\w+(?:['’-]\w+)*")


def swaps(lines: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {t: line[(i + 1) % len(line)] for line in lines for i, t in enumerate(line)}


def word_features(token: str) -> tuple[str, ...]:
    """Of a run between white space: its words and their starts."""
    out: list[str] = []
    for word in _WORD.findall(token):
        out.append(word)
        out += [f"{word[:n]}-" for n in (4, 5, 6, 7, 8) if len(word) > n]
    return tuple(out)


def text_features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in word_features(w)}


def swapped(text: str, swap: dict[str, str]) -> str | None:
    """The text in lower case with its identity terms swapped; None if it has none."""
    low = text.lower()
    out = _WORD.sub(lambda m: swap.get(m.group(), m.group()), low)
    return out if out != low else None


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    _known: dict[str, tuple[float, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str) -> float:
        """Each feature counts once, however often and in whatever words it stands."""
        known, hits = self._known, {}
        for w in set(text.lower().split()):
            found = known.get(w)
            if found is None:
                if len(known) > 300_000:
                    known.clear()
                found = known[w] = tuple(f for f in word_features(w) if f in self.weights)
            for f in found:
                hits[f] = self.weights[f]
        z = self.bias + sum(sorted(hits.values()))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_known": {}}


def _count(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many texts, summed in each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(by[0].keys() | by[1].keys())
            return pa.record_batch([pa.array(names, pa.string()), pa.array([by[1][f] for f in names], pa.int64()), pa.array([by[0][f] for f in names], pa.int64())], ["feature", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                by[y].update(text_features(text))
            if len(by[0]) + len(by[1]) > COUNTED:
                yield counted()
                by[0].clear()
                by[1].clear()
        yield counted()

    return sample.mapInArrow(frugal(run), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rows(sample: DataFrame, vocabulary: dict[str, int], swap: dict[str, str]) -> DataFrame:
    """(pick, y, ids, other): the vocabulary's features of each text, and of the text with identity terms swapped (null if it has none)."""

    def ids(text: str) -> list[int]:
        return sorted(vocabulary[f] for f in text_features(text) if f in vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            other = [swapped(t, swap) for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column("pick"), batch.column("y"), pa.array([ids(t) for t in texts], kind), pa.array([None if o is None else ids(o) for o in other], kind)], ["pick", "y", "ids", "other"])

    return sample.mapInArrow(frugal(run), "pick long, y int, ids array<int>, other array<int>")


class _Sparse:
    """0/1 rows: product with weights, and the transposed product."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def train(rows: list[tuple[int, list[int], list[int] | None]], width: int, penalty: float = PENALTY, ridge: float = 1e-5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample; rows: (label, features, features after the swap)."""
    y = np.array([r[0] for r in rows], float)
    x = _Sparse([r[1] for r in rows], width)
    at = np.array([i for i, r in enumerate(rows) if r[2] is not None], np.int64)
    other = _Sparse([rows[i][2] for i in at], width)
    # classes weigh as they are: a text without telling features must count as clean
    share = np.full(len(y), 1 / max(len(y), 1))
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        p = sigmoid(x.times(w) + b)
        g = share * (p - y)
        gw, gb = x.back(g) + ridge * w, g.sum()
        if len(at):
            q = sigmoid(other.times(w) + b)
            change = 2 * penalty * (p[at] - q) / len(at)
            up, down = change * p[at] * (1 - p[at]), change * q * (1 - q)
            full = np.zeros(x.n)
            full[at] = up
            gw += x.back(full) - other.back(down)
            gb += up.sum() - down.sum()
        grad = np.append(gw, gb)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, penalty: float = PENALTY) -> Model | None:
    """None without rows of both classes or a telling feature; terms: lines of identity terms, each swapped for the next of its line."""
    small_batches(docs.sparkSession)
    swap = swaps(terms)
    sample = labelled_sample(docs, labels, label, per_class, SAMPLE_CHARS)
    sample = cut(sample.groupBy("text").agg(F.min("pick").alias("pick"), F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("text", "pick", "y"))
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    toxic, clean = (F.col("toxic") + 0.5) / (sizes[1] + 1.0), (F.col("clean") + 0.5) / (sizes[0] + 1.0)
    odds = F.log(toxic / clean)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = min(LEAST_TEXTS, max(2, sizes[1] // 4))
    counted = cut(_count(sample))
    table = counted.filter(F.col("toxic") + F.col("clean") >= least).filter(odds - error > ODDS)
    told = odds * F.sqrt(F.col("toxic") + F.col("clean"))
    names = [r["feature"] for r in table.orderBy(told.desc(), "feature").limit(FEATURES).collect()]
    if not names:
        return None
    # a handful of terms, and what they are swapped for
    there = [r["feature"] for r in counted.filter(F.col("feature").isin(*swap)).select("feature").collect()] if swap else []
    names += sorted({f for t in there for f in (t, swap[t])} - {*names})
    vocabulary = {f: i for i, f in enumerate(names)}
    found = [(r["pick"], r["y"], r["ids"], r["other"]) for r in _rows(sample, vocabulary, swap).collect()]
    rows = sorted(found, key=lambda r: (r[0], r[1], r[2], r[3] or []))
    w, b = train([r[1:] for r in rows], len(vocabulary), penalty)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i]}, float(b))


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold."""
    small_batches(docs.sparkSession)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([model.score(t.as_py() or "") < threshold for t in batch.column("text")], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(frugal(run), docs.schema)
