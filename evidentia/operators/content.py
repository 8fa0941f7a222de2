"""Bodies, windows and vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import DEFAULT
from evidentia.functions import scalars

SEGMENTER = "structured-v1"
_FENCE, _HEADING, _ROW = re.compile(r"\s*```"), re.compile(r"#{1,6}\s+\S"), re.compile(r"\s*\|.*\|\s*$")


def _kind(line: str) -> str:
    if _FENCE.match(line):
        return "code"
    if _HEADING.match(line):
        return "heading"
    if _ROW.match(line):
        return "table"
    return "prose" if line.strip() else "blank"


def parse(body: str) -> list[tuple[str, str]]:
    """(kind, text) blocks: fenced code (an open fence takes the rest), headings, table runs, paragraphs."""
    found: list[tuple[str, list[str]]] = []
    fenced = False
    previous = "blank"
    for line in body.split("\n"):
        if fenced:
            found[-1][1].append(line)
            fenced = not _FENCE.match(line)
            previous = "blank"
            continue
        kind = _kind(line)
        if kind in ("table", "prose") and kind == previous:
            found[-1][1].append(line)
        elif kind != "blank":
            found.append((kind, [line]))
            fenced = kind == "code"
        previous = kind
    tidy = {"heading": str.rstrip, "prose": str.strip}
    return [(kind, tidy.get(kind, str)("\n".join(lines))) for kind, lines in found]


def _size(text: str) -> int:
    return len(text.split())


def _windows(text: str, budget: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]


def _pieces(paragraph: str, budget: int) -> Iterator[str]:
    if _size(paragraph) <= budget:
        yield paragraph
        return
    for sentence in filter(None, re.split(r"(?<=[.!?])\s+", paragraph)):
        if _size(sentence) <= budget:
            yield sentence
        else:
            yield from _windows(sentence, budget)


def segment(body: str | None, budget: int = DEFAULT.window_tokens) -> list[str]:
    """Windows of at most ``budget`` words: prose packed by section, each window led by its heading; code and tables whole if they fit."""
    out: list[str] = []
    waiting: list[str] = []
    heading = ""

    def led(window: str) -> str:
        return f"{heading}\n\n{window}" if heading else window

    def emit() -> None:
        room = max(1, budget - (_size(heading) + 1 if heading else 0))
        current: list[str] = []
        used = 0
        for piece in (p for w in waiting for p in _pieces(w, room)):
            n = _size(piece)
            if current and used + n > room:
                out.append(led("\n\n".join(current)))
                current, used = [], 0
            current.append(piece)
            used += n
        if current:
            out.append(led("\n\n".join(current)))
        waiting.clear()

    for kind, text in parse(body or ""):
        if kind == "prose":
            waiting.append(text)
            continue
        emit()
        if kind == "heading":
            heading = text
        elif _size(text) + (_size(heading) + 1 if heading else 0) <= budget:
            out.append(led(text))
        else:
            out.extend(_windows(text, budget))
    emit()
    return out


def segmented(bodies: DataFrame, budget: int = DEFAULT.window_tokens, segmenter: Callable[[str | None, int], list[str]] = segment) -> DataFrame:
    """(node_id, ordinal, text, token_count) of (node_id, body), by a segmenter that may be replaced."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda b: segmenter(b, budget))

    rows = bodies.select("node_id", F.posexplode(split("body")).alias("ordinal", "text"))
    return rows.withColumn("token_count", scalars.token_count(F.col("text")))


def segmenter_table(segmenter: Callable[[str | None, int], list[str]] = segment, budget: int = DEFAULT.window_tokens):
    """The segmenter as a table function (ordinal, text) for SQL: ``spark.udtf.register(name, segmenter_table())``, then LATERAL name(body)."""
    from pyspark.sql.functions import udtf

    class Segments:
        def eval(self, body: str):
            yield from enumerate(segmenter(body, budget))

    return udtf(Segments, returnType="ordinal int, text string")


def hard_windows(bodies: DataFrame, budget: int) -> DataFrame:
    """(node_id, ordinal, text): plain windows of ``budget`` words, without Python; a row holds its own window only."""
    words = F.regexp_extract_all("body", F.lit(r"\S+"), 0)
    rows = bodies.select("node_id", words.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / budget).cast("int"))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("_w", i * budget + 1, budget), " "))
    return rows.select("node_id", F.posexplode(windows).alias("ordinal", "text"))


def put_bodies(log: DataFrame) -> DataFrame:
    """(node_id, body, body_hash, segmenter): the latest body of each node; blank ones are skipped."""
    kept = log.filter(F.trim("body") != "").groupBy("node_id").agg(F.max_by("body", "seq").alias("body"))
    return kept.withColumn("body_hash", scalars.sha256(F.col("body"))).withColumn("segmenter", F.lit(SEGMENTER))


def to_embed(content: DataFrame, force: bool = False) -> DataFrame:
    """Contents whose embedded hash isn't their body's."""
    return content if force else content.filter(~F.col("embedded_hash").eqNullSafe(F.col("body_hash")))


def replace_chunks(chunks: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The chunk table with the touched nodes' chunks replaced."""
    return chunks.join(touched.select("node_id"), "node_id", "left_anti").unionByName(fresh)


def hash_embedding(text: str, size: int = 64) -> list[float]:
    """Deterministic stand-in for a model: signed word hashes, of unit length."""
    import zlib

    v = np.zeros(size)
    for word in text.lower().split():
        h = zlib.crc32(word.encode())
        v[h % size] += 1 if h >> 31 else -1
    length = np.linalg.norm(v)
    return (v / length if length else v).astype(np.float32).tolist()


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None, retries: int = 1) -> DataFrame:
    """Adds ``vec`` by an injected batch embedder, which is tried again once; a batch of another size fails the task."""

    @F.pandas_udf("array<float>")
    def vectors(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        for attempt in range(retries + 1):
            try:
                found = embed(texts) if embed else [hash_embedding(t) for t in texts]
                break
            except (ConnectionError, TimeoutError):
                if attempt == retries:
                    raise
        if len(found) != len(texts):
            raise ValueError("the embedder answered another number of vectors")
        return pd.Series(found)

    return chunks.withColumn("vec", vectors("text"))


def mean_vectors(chunks: DataFrame, key: str = "node_id", vec: str = "vec") -> DataFrame:
    """(key, vec): the unweighted mean of each key's vectors, place by place; vectors of a key have one length.

    Sums are taken in each batch, then of each key's sums as they come by in the key's order: no task holds a key's rows.
    """
    rows = chunks.filter(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("s"), F.lit(1).cast("long").alias("n"))
    kind = f"k {rows.schema['k'].dataType.simpleString()}, s array<double>, n long"
    merged = rows.mapInArrow(_summed, kind).repartition("k").sortWithinPartitions("k").mapInArrow(_summed_in_order, kind)
    return merged.select(F.col("k").alias(key), F.transform("s", lambda x: x / F.col("n")).alias("vec"))


def _sums(batch: pa.RecordBatch) -> tuple[list, list[np.ndarray], np.ndarray]:
    """A batch's keys in order of appearance, the sums of their vectors, and how many there are."""
    place: dict = {}
    at = np.array([place.setdefault(k, len(place)) for k in batch.column("k").to_pylist()], np.int64)
    counts = np.bincount(at, batch.column("n").to_numpy(), len(place)).astype(np.int64)
    vectors, flat = batch.column("s"), batch.column("s").flatten().to_numpy(zero_copy_only=False)
    size = len(flat) // max(len(at), 1)
    if size and size * len(at) == len(flat) and all(len(v) == size for v in vectors):
        sums = np.zeros((len(place), size))
        np.add.at(sums, at, flat.reshape(-1, size))
        return list(place), list(sums), counts
    out: list = [0.0] * len(place)
    for i, v in zip(at, vectors, strict=True):
        out[i] = out[i] + np.array(v.as_py(), float)
    return list(place), out, counts


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys, sums, n = _sums(batch)
            yield pa.record_batch([pa.array(keys, batch.schema.field("k").type), pa.array([x.tolist() for x in sums], pa.list_(pa.float64())), pa.array(n)], ["k", "s", "n"])


def _summed_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys stand together: only the last one of a batch may go on in the next."""
    open_: list | None = None
    kind = None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("k").type
        keys, sums, n = _sums(batch)
        done = [[k, s, int(c)] for k, s, c in zip(keys, sums, n, strict=True)]
        if open_ is not None:
            if done[0][0] == open_[0]:
                done[0][1], done[0][2] = done[0][1] + open_[1], done[0][2] + open_[2]
            else:
                done.insert(0, open_)
        open_ = done.pop()
        if done:
            yield _sum_batch(done, kind)
    if open_ is not None:
        yield _sum_batch([open_], kind)


def _sum_batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())], ["k", "s", "n"])


def union_chunks(survivor: DataFrame, alias: DataFrame) -> DataFrame:
    """An alias' chunks behind the survivor's: (into, ordinal, text ...); alias rows name ``into``."""
    last = survivor.groupBy(F.col("node_id").alias("into")).agg(F.max("ordinal").alias("_last"))
    moved = alias.join(last, "into", "left").withColumn("ordinal", (F.col("ordinal") + F.coalesce(F.col("_last") + 1, F.lit(0))).cast("int")).drop("_last", "node_id")
    return survivor.unionByName(moved.withColumnRenamed("into", "node_id"), allowMissingColumns=True)


def longer_body(content: DataFrame, owner: Column) -> DataFrame:
    """(owner, body): of merged nodes' bodies the longest, on a tie the survivor's; rows carry ``is_survivor``."""
    return content.groupBy(owner.alias("node_id")).agg(F.max_by("body", F.struct(F.length("body"), F.col("is_survivor").cast("int"))).alias("body"))
