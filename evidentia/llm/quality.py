"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from labelled texts of either class, cut into pieces of ``PIECE`` bytes. A text is
compressed whole, piece by piece, with each of them; the normalised difference (bad - good) / larger of the two
total sizes tells which class' phrases it repeats, alike for short and long texts. A logistic calibration of the
difference alone gives the probability of label 1; nothing else of a text enters its score.

The dictionaries and the calibration are fitted on disjoint parts of a sample: at most ``SAMPLE`` labelled rows a
class, the ones with the least hash, of texts of at most ``SAMPLE_CHARS`` code points, and of these the first
``SAMPLE_BYTES`` bytes a class. All of the sample is used. Scoring sees whole texts of any length. Labels, lang,
source and doc_id are no inputs of a score.

Values: a null text is empty, and has a score like any other. Rows of one doc_id are scored each by its text, null
doc_ids are handed on and not held out; of rows alike in text and label the sample has one. Without rows of both
classes to learn from every score is 0.5. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import frugal, held_out, small_batches, text_of

SAMPLE = 2500
SAMPLE_CHARS = 40_000
SAMPLE_BYTES = 6 << 20
DICTIONARY = 65_536
PIECE = 1024
LEVEL = 3
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> DataFrame:
    """(doc_id, text, y, pick): at most so many labelled rows a class, none held out; pick is a hash in whose order they were chosen."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out())
    rows = rows.withColumn("pick", F.xxhash64("doc_id", "y"))
    chosen = [rows.filter(F.col("y") == y).orderBy("pick", "doc_id").limit(per_class) for y in (0, 1)]
    few = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(few), "doc_id").filter(F.length("text") <= longest).select("doc_id", "text", "y", "pick")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class Model:
    """``bias`` and ``slope`` turn the difference into the log odds of label 1."""

    good: bytes
    bad: bytes
    bias: float = 0.0
    slope: float = 1.0

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """The normalised compressed-size difference of each text: above 0 where the good dictionary fits better."""
        import zstandard

        if not hasattr(self, "_by"):
            self._by = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._by.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        good, bad = (np.array([sum(len(c.compress(p)) for p in pieces(t)) for t in texts], float) for c in self._by)
        return (bad - good) / np.maximum(np.maximum(good, bad), 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * self.differences(texts), -30, 30)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_by"}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """None without enough rows of both classes."""
    small_batches(docs.sparkSession)
    import zstandard

    # within the sample's rows, so many as the parameters allow
    order = Window.partitionBy("y").orderBy("pick", "text").rowsBetween(Window.unboundedPreceding, 0)
    sample = labelled_sample(docs, labels, label, per_class, SAMPLE_CHARS).withColumn("total", F.sum(F.octet_length("text")).over(order))
    rows = sorted({(r.pick, r.text, r.y) for r in sample.filter(F.col("total") <= most_bytes).select("pick", "text", "y").collect()})
    by: dict[int, list[bytes]] = {0: [], 1: []}
    calibrate: list[tuple[bytes, int]] = []
    for i, (_, text, y) in enumerate(rows):
        if i % 3:
            by[y].append(text.encode())
        else:
            calibrate.append((text.encode(), y))
    if min(len(by[0]), len(by[1])) < 8 or len({y for _, y in calibrate}) < 2:
        return None
    dictionaries = []
    for y in (1, 0):
        kept = [p for t in dict.fromkeys(by[y]) for p in pieces(t)]
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, kept)) // 8)), kept).as_bytes())
        except zstandard.ZstdError:
            # too little text to choose from: the text itself, in order, is the dictionary
            dictionaries.append(b"".join(kept)[-DICTIONARY:])
    model = Model(*dictionaries)
    d, y = model.differences([t for t, _ in calibrate]), np.array([y for _, y in calibrate], float)
    unit = d.std() + 1e-9
    bias, slope = logistic(np.column_stack([np.ones(len(d)), d / unit]), y)
    model.bias, model.slope = float(bias), float(slope / unit)
    return model


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            out = np.concatenate([model.score([t.as_py().encode() for t in texts[a : a + 256]]) for a in range(0, len(texts), 256)] or [np.zeros(0)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, score double")
