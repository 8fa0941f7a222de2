"""The embedding loop: bodies to windows, vectors, chunks and node vectors; entity keys to vectors; namespace stamps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import content, evidence
from evidentia.operators.iterate import checkpointed

Embed = Callable[[list[str]], list[list[float]]]
STAMP = "namespace string, model string, dim int, status string, seq long"


@dataclass
class Embedded:
    """chunks: the whole table with the touched nodes' chunks replaced; vectors: (node_id, vec, embed_model) of touched nodes; content: with its hashes stamped; outcomes: (node_id, outcome, n)."""

    chunks: DataFrame
    vectors: DataFrame
    content: DataFrame
    outcomes: DataFrame
    stamps: DataFrame


def without_chunks(bodies: DataFrame, chunks: DataFrame) -> DataFrame:
    return bodies.join(chunks.select("node_id"), "node_id", "left_anti")


def with_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return nodes.join(chunks.select(F.col("node_id").alias("id")), "id", "left_semi")


def stamp(spark: SparkSession, namespace: str, dim: int, model: str | None = None, seq: int = 0) -> DataFrame:
    """One row of the stamps' log; a namespace begins as pending."""
    return spark.createDataFrame([(namespace, model or namespace, dim, "pending", seq)], STAMP)


def namespaces(log: DataFrame) -> DataFrame:
    """(namespace, model, dim, status): the latest stamp of each, by name."""
    return evidence.latest(log, ["namespace"]).orderBy("namespace")


def embed_bodies(bodies: DataFrame, chunks: DataFrame, wanted: DataFrame | None = None, embed: Embed | None = None, namespace: str = "hash-64", force: bool = False, segmenter: Callable[[str | None, int], list[str]] = content.segment) -> Embedded:
    """Segments and embeds the bodies (node_id, body, body_hash, embedded_hash) whose hash isn't the embedded one.

    wanted: (node_id) asked for, all if None. A body without windows counts as no_content and is not stamped; an
    asked node without a body is no_content too. An embedder that fails, or answers another number of vectors,
    fails the pass, and nothing of it is to be written.
    """
    asked = bodies if wanted is None else bodies.join(wanted.select("node_id").distinct(), "node_id", "left_semi")
    todo = content.to_embed(asked, force)
    windows = content.segmented(todo.select("node_id", "body"), segmenter=segmenter)
    fresh = checkpointed(content.embedded(windows, embed).withColumn("id", F.xxhash64("node_id", "ordinal")))
    touched = checkpointed(fresh.groupBy("node_id").agg(F.count("*").alias("n")))
    vectors = content.mean_vectors(fresh).withColumn("embed_model", F.lit(namespace))
    done = touched.select("node_id", F.lit(True).alias("_done"))
    stamped = bodies.join(done, "node_id", "left").withColumn("embedded_hash", F.when(F.col("_done"), F.col("body_hash")).otherwise(F.col("embedded_hash"))).drop("_done")
    every = asked.select("node_id", F.lit(True).alias("_body")) if wanted is None else wanted.select("node_id").distinct().join(asked.select("node_id", F.lit(True).alias("_body")), "node_id", "left")
    state = every.join(todo.select("node_id", F.lit(True).alias("_todo")), "node_id", "left").join(touched, "node_id", "left")
    outcome = F.when(F.col("_body").isNull(), "no_content").when(F.col("_todo").isNull(), "unchanged").when(F.col("n").isNull(), "no_content").otherwise("embedded")
    outcomes = state.select("node_id", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))
    one = fresh.select(F.size("vec").alias("dim")).limit(1)
    stamps = one.select(F.lit(namespace).alias("namespace"), F.lit(namespace).alias("model"), F.col("dim").cast("int").alias("dim"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("seq"))
    return Embedded(content.replace_chunks(chunks, fresh.select(*[c for c in chunks.columns if c in fresh.columns]), touched), vectors, stamped, outcomes, stamps)


def unembedded(nodes: DataFrame, limit: int = 200) -> DataFrame:
    """(id, key) of the first entities, by id, that have no vector."""
    return nodes.filter("type = 'entity' and vec is null").orderBy("id").limit(limit).select("id", "key")


def embed_keys(nodes: DataFrame, embed: Embed | None = None, namespace: str = "hash-64", limit: int = 200) -> DataFrame:
    """(id, vec, embed_model) of a batch of entities without a vector; empty when none is left. Another number of vectors is an error."""
    batch = unembedded(nodes, limit).withColumnRenamed("key", "text")
    return content.embedded(batch, embed).select("id", "vec", F.lit(namespace).alias("embed_model"))


def with_vectors(nodes: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """The nodes with the given vectors put in place of theirs."""
    put = vectors.select(F.col(key).alias("id"), F.col("vec").cast("array<float>").alias("_v"), F.col("embed_model").alias("_m"))
    own = F.col("embed_model") if "embed_model" in nodes.columns else F.lit(None).cast("string")
    return nodes.join(put, "id", "left").withColumn("embed_model", F.coalesce("_m", own)).withColumn("vec", F.coalesce("_v", "vec")).drop("_v", "_m")
