"""Hybrid retrieval: a lexical and a dense arm, weighted reciprocal-rank fusion, a relevance floor, memories, expansion.

The lexical score is documented here, since any scoring of full matches will do: a chunk matches if it
holds every query token; its score is the sum over query tokens of tf / (tf + 1), with ties in chunk id.
Scopes are applied below both rankings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators import confidence, traverse
from evidentia.operators.iterate import checkpointed


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def top(df: DataFrame, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first k rows and their rank: each task keeps its k best, and only those meet."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def lexical(chunks: DataFrame, query: str, k: int = DEFAULT.candidates) -> DataFrame:
    """(id, node_id, ordinal, text, rnk) of the k best chunks that hold all the query's tokens; chunks are visible ones."""
    asked = F.array_distinct(tokens(F.lit(query)))
    found = chunks.withColumn("_t", tokens(F.col("text"))).filter((F.size(asked) > 0) & (F.size(F.array_except(asked, F.col("_t"))) == 0))
    tf = lambda w: F.size(F.filter("_t", lambda x: x == w))
    score = F.aggregate(asked, F.lit(0.0), lambda s, w: s + tf(w) / (tf(w) + 1.0))
    scored = found.withColumn("score", score).drop("_t")
    return top(scored, [F.desc("score"), F.asc("id")], k, "rnk").select("id", "node_id", "ordinal", "text", "rnk", "score")


def dense(chunks: DataFrame, vector: list[float], k: int = DEFAULT.candidates) -> DataFrame:
    """(id, node_id, ordinal, text, cos, rnk) of the k chunks of the highest cosine."""
    scored = chunks.filter("vec is not null").withColumn("cos", scalars.cosine(F.col("vec"), scalars.vector(vector)))
    return top(scored, [F.desc("cos"), F.asc("id")], k, "rnk").select("id", "node_id", "ordinal", "text", "cos", "rnk")


def fuse(lex: DataFrame, den: DataFrame, k: int = DEFAULT.rrf_k, lex_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """(id, node_id, ordinal, text, rrf, cos, lex): the sum of weight / (k + rank) over both arms."""
    arms = lex.select("id", "node_id", "ordinal", "text", "rnk", F.lit(None).cast("double").alias("cos"), F.lit(True).alias("lex"), F.lit(lex_weight).alias("w"))
    arms = arms.unionByName(den.select("id", "node_id", "ordinal", "text", "rnk", "cos", F.lit(False).alias("lex"), F.lit(dense_weight).alias("w")))
    return arms.groupBy("id", "node_id", "ordinal", "text").agg(F.sum(F.col("w") / (F.lit(k) + F.col("rnk"))).alias("rrf"), F.max("cos").alias("cos"), F.bool_or("lex").alias("lex"))


def lexical_only(lex: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """The fused form of one arm; the arm's weight is not applied here."""
    return lex.select("id", "node_id", "ordinal", "text", (1.0 / (F.lit(k) + F.col("rnk"))).alias("rrf"), F.lit(None).cast("double").alias("cos"), F.lit(True).alias("lex"))


def gate(fused: DataFrame, floor: float = DEFAULT.relevance_floor) -> DataFrame:
    return fused.filter(F.col("lex") | F.coalesce(F.col("cos") >= floor, F.lit(False)))


def memories(fused: DataFrame, spans: int = DEFAULT.spans) -> DataFrame:
    """(node_id, score, relevance, spans): the sum of a node's spans, its best cosine, and its best spans."""
    span = F.struct((-F.col("rrf")).alias("r"), F.col("ordinal"), F.col("text"))
    best = F.slice(F.sort_array(F.collect_list(span)), 1, spans)
    folded = fused.groupBy("node_id").agg(F.sum("rrf").alias("score"), F.max(F.coalesce("cos", F.lit(0.0))).alias("relevance"), best.alias("_s"))
    return folded.withColumn("spans", F.transform("_s", lambda s: F.struct(s["ordinal"].alias("ordinal"), s["text"].alias("text")))).drop("_s")


def identified(found: DataFrame, nodes: DataFrame, corroborated: DataFrame) -> DataFrame:
    """Adds type, key and confidence: corroborated, else the node's own undecayed reliability."""
    named = found.join(nodes.select(F.col("id").alias("node_id"), "type", "key", "reliability"), "node_id")
    named = named.join(corroborated.select(F.col("node").alias("node_id"), "confidence"), "node_id", "left")
    return named.withColumn("confidence", F.coalesce("confidence", "reliability")).withColumn("relevance", F.round("relevance", 4)).drop("reliability")


def search(chunks: DataFrame, nodes: DataFrame, query: str, scopes: list[str], vector: list[float] | None = None, embed: Callable[[str], list[float]] | None = None, limit: int = DEFAULT.limit, candidates: int = DEFAULT.candidates, rrf_k: int = DEFAULT.rrf_k, spans: int = DEFAULT.spans, floor: float = DEFAULT.relevance_floor, lex_weight: float = DEFAULT.lexical_weight, dense_weight: float = DEFAULT.dense_weight) -> DataFrame:
    """The memories that answer a query, best first; an embedder that fails leaves the lexical arm alone."""
    if vector is None and embed is not None:
        try:
            vector = embed(query)
        except (ConnectionError, TimeoutError, OSError):
            vector = None
    seen = chunks.join(schema.visible(nodes, scopes).select(F.col("id").alias("node_id")), "node_id", "left_semi")
    lex = lexical(seen, query, candidates)
    fused = lexical_only(lex, rrf_k) if vector is None else fuse(lex, dense(seen, vector, candidates), rrf_k, lex_weight, dense_weight)
    return memories(gate(fused, floor), spans).orderBy(F.desc("score"), "node_id").limit(limit)


@dataclass
class Answer:
    """``status`` found or not_found; the memories with type, key and confidence, best first; what they lead to, by confidence."""

    status: str
    memories: DataFrame
    expanded: DataFrame


def answer(chunks: DataFrame, nodes: DataFrame, log: DataFrame, query: str, scopes: list[str], as_of: Column, expand: bool = True, depth: int = DEFAULT.expand_depth, **options) -> Answer:
    """``search`` as an asker gets it: each memory named and weighed, and expanded over the edges that the log (with reward) folds to.

    Corroboration and expansion read only the events of the few memories, and of what is reached from them.
    """
    found = checkpointed(search(chunks, nodes, query, scopes, **options))
    # as many rows as the search's limit
    few = found.select(F.col("node_id").alias("node"))
    weighed = confidence.corroboration_of_log(log, as_of, nodes, scopes, F.broadcast(few))
    memories = identified(found, nodes, weighed).orderBy(F.desc("score"), "node_id")
    seeds = few.select(F.col("node").alias("seed"))
    reached = traverse.reach_log(seeds, log, as_of, depth if expand and scopes else 0, nodes, scopes)
    return Answer("not_found" if found.isEmpty() else "found", memories, traverse.ordered(traverse.strongest(reached, seeds)))


def key_search(nodes: DataFrame, terms: list[str], scopes: list[str], limit: int = DEFAULT.limit, owner: str | None = None) -> DataFrame:
    """(id, type, key, score): visible nodes whose key contains a term (and, delimited, the owner), by key."""
    if not terms:
        return nodes.limit(0).select("id", "type", "key", F.lit(1.0).alias("score"))
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | F.col("key").ilike(scalars.like_escaped(t))
    found = schema.visible(nodes, scopes).filter(any_term)
    if owner is not None:
        found = found.filter(scalars.delimited(F.col("key"), owner))
    return found.orderBy("key", "id").limit(limit).select("id", "type", "key", F.lit(1.0).alias("score"))


def key_gate(hits: DataFrame, terms: list[str]) -> DataFrame:
    """Hits whose key has at least half of the terms as delimited words; applied after the limit."""
    if not terms:
        return hits
    matched = sum((scalars.delimited(F.col("key"), t).cast("int") for t in terms), F.lit(0))
    return hits.filter(matched >= (len(terms) + 1) // 2)


def merge_hits(first: DataFrame, second: DataFrame, limit: int = DEFAULT.limit) -> DataFrame:
    """Content hits by score, then key hits that aren't among them."""
    more = second.join(first.select("id"), "id", "left_anti")
    both = first.withColumn("arm", F.lit(0)).unionByName(more.withColumn("arm", F.lit(1)))
    return both.orderBy("arm", F.desc("score"), "key", "id").limit(limit)


def centroids(chunks: DataFrame, lists: int = 64, sample: int = 10_000, rounds: int = 10) -> list[list[float]]:
    """Directions that the vectors lie around: spherical k-means of at most ``sample`` vectors, the ones with the least hash of their id."""
    rows = chunks.filter("vec is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    x = np.array([r.vec for r in rows], float).reshape(len(rows), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds):
        own = (x @ c.T).argmax(1) if len(x) else []
        c = np.array([m / max(np.linalg.norm(m), 1e-12) if (m := x[own == i].sum(0)).any() else c[i] for i in range(len(c))])
    return c.tolist()


def indexed(chunks: DataFrame, around: list[list[float]]) -> DataFrame:
    """Every chunk that has a vector with ``bucket``, the centroid it is closest to; to be written partitioned by it."""
    c = np.array(around, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), float).reshape(batch.num_rows, -1)
            own = (x @ c.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(own, pa.int32())], [*batch.schema.names, "bucket"])

    rows = chunks.filter("vec is not null").drop("bucket")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, bucket int")


def dense_by_index(index: DataFrame, vector: list[float], around: list[list[float]], k: int = DEFAULT.candidates, probes: int = 16) -> DataFrame:
    """As ``dense``, from the buckets of the ``probes`` centroids closest to the vector only: approximate."""
    near = np.argsort(-(np.array(around, float) @ np.array(vector, float)), kind="stable")[:probes]
    return dense(index.filter(F.col("bucket").isin([int(i) for i in near])), vector, k)


def postings(chunks: DataFrame) -> DataFrame:
    """(token, id, tf): an inverted index, to be written partitioned or bucketed by token."""
    return chunks.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def lexical_by_postings(index: DataFrame, chunks: DataFrame, query: str, k: int = DEFAULT.candidates) -> DataFrame:
    """As ``lexical``, from an inverted index: only the query's tokens are read, and only the best chunks' texts."""
    asked = index.sparkSession.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("token"))
    words = [r["token"] for r in asked.collect()]
    found = index.filter(F.col("token").isin(*words)).groupBy("id").agg(F.count("*").alias("_n"), F.sum(F.col("tf") / (F.col("tf") + 1.0)).alias("score"))
    seen = found.filter(F.col("_n") == len(words)).join(chunks.select("id"), "id", "left_semi")
    best = top(seen.select("id", "score"), [F.desc("score"), F.asc("id")], k, "rnk")
    return chunks.join(F.broadcast(best), "id").select("id", "node_id", "ordinal", "text", "rnk", "score")
