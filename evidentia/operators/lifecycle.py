"""Strength, evaporation and counts of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import DEFAULT
from evidentia.functions import scalars


def with_strength(edges: DataFrame, as_of: Column, per_day: float = DEFAULT.decay_per_day, s: float = DEFAULT.saturation) -> DataFrame:
    return edges.withColumn("strength", scalars.strength(F.col("reliability"), F.col("seen_count"), F.col("last_seen"), as_of, per_day, s))


def evaporated(edges: DataFrame, as_of: Column, floor: float = DEFAULT.gc_floor) -> Column:
    return (F.col("reward") < 0) | (F.col("strength") < floor)


def survivors(edges: DataFrame, as_of: Column, floor: float = DEFAULT.gc_floor) -> DataFrame:
    """The edges after a collection: neither refuted nor weaker than the floor."""
    return with_strength(edges, as_of).filter(~evaporated(edges, as_of, floor)).drop("strength")


def reaped(edges: DataFrame, as_of: Column, floor: float = DEFAULT.gc_floor) -> DataFrame:
    """One row: how many edges there were, go and stay."""
    gone = evaporated(edges, as_of, floor).cast("long")
    return with_strength(edges, as_of).agg(F.count("*").alias("edges"), F.coalesce(F.sum(gone), F.lit(0)).alias("reaped"), F.coalesce(F.sum(1 - gone), F.lit(0)).alias("kept"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a self-loop counts once."""
    return edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def out_degrees(edges: DataFrame, top: int) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(top)


def inventory(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sizes and the latest change."""
    return nodes.agg(F.count("*").alias("nodes"), F.max("created_at").alias("freshest")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are never a source."""
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def collisions(nodes: DataFrame) -> DataFrame:
    """Keys that differ in case only: (type, folded, n, variants)."""
    return nodes.groupBy("type", F.lower("key").alias("folded")).agg(F.count_distinct("key").alias("n"), F.sort_array(F.collect_set("key")).alias("variants")).filter("n > 1")
