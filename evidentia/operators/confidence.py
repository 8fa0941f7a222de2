"""Combining confidences: chains, noisy-or, and typed combination by origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators import evidence

FLOOR = 1e-12


def chain(reliability: Column) -> Column:
    """Aggregate: the product along a path, in log space."""
    return F.exp(F.sum(F.log(F.greatest(reliability, F.lit(FLOOR)))))


def noisy_or(p: Column) -> Column:
    """Aggregate: at least one of independent supports holds; 0 for none."""
    return F.coalesce(1 - F.product(1 - p), F.lit(0.0))


def combine_typed(confidence: Column, kind: Column) -> Column:
    """Aggregate: all generated kinds together support as their strongest; the others each for themselves."""
    generated = kind.isin(*schema.GENERATED)
    external = F.coalesce(F.product(F.when(~generated, 1 - confidence)), F.lit(1.0))
    strongest = F.coalesce(F.max(F.when(generated, confidence)), F.lit(0.0))
    return 1 - external * (1 - strongest)


def combine_groups(paths: DataFrame, key: str, group: str, confidence: str) -> DataFrame:
    """(key, confidence): the strongest of each group, then noisy-or over groups."""
    strongest = paths.groupBy(key, group).agg(F.max(confidence).alias("_c"))
    return strongest.groupBy(key).agg(noisy_or(F.col("_c")).alias("confidence"))


def corroboration(edges: DataFrame, provenance: DataFrame, as_of: Column, nodes: DataFrame | None = None, scopes: list[str] | None = None, per_day: float = DEFAULT.decay_per_day) -> DataFrame:
    """(node, confidence) of every node with incoming assertions that are neither refuted nor structural.

    provenance: (src, dst, type, scope) with origin and provenance, or with the witness of both. Of each origin only its strongest assertion counts, with that assertion's kind. With scopes, the edge
    and its source node must both be visible. Nodes without assertions are absent.
    """
    used = edges.filter((F.col("reward") >= 0) & ~F.col("type").isin(*schema.STRUCTURAL))
    if scopes is not None:
        seen = schema.visible(nodes, scopes).select(F.col("id").alias("src"))
        used = schema.visible(used, scopes).join(seen, "src", "left_semi")
    used = used.withColumn("_c", F.col("reliability") * scalars.decay(F.col("last_seen"), as_of, per_day)).drop("origin", "provenance")
    who = F.col("witness") if "witness" in provenance.columns else F.coalesce("origin", "provenance")
    assertions = used.join(provenance.select("src", "dst", "type", "scope", who.alias("witness")), ["src", "dst", "type", "scope"])
    by_origin = assertions.groupBy("dst", "witness").agg(F.max("_c").alias("_c"), F.max_by("kind", F.struct(F.col("_c"), F.col("kind"))).alias("kind"))
    return by_origin.groupBy(F.col("dst").alias("node")).agg(combine_typed(F.col("_c"), F.col("kind")).alias("confidence"))


def corroboration_of_log(events: DataFrame, as_of: Column, nodes: DataFrame | None = None, scopes: list[str] | None = None, ids: DataFrame | None = None, per_day: float = DEFAULT.decay_per_day) -> DataFrame:
    """``corroboration`` from the log (with reward) itself: the fold and the assertions share one aggregation.

    ids: (node), whose corroboration alone is asked for; other nodes' events are left out before the fold.
    """
    if ids is not None:
        events = events.join(ids.select(F.col("node").alias("dst")), "dst", "left_semi")
    seen = evidence.witnesses(events.drop("reward"))
    edges = evidence.fold_edges(events.drop("reward"), events if "reward" in events.columns else None, seen)
    return corroboration(edges, seen.drop("first"), as_of, nodes, scopes, per_day)


def corroboration_of(node: int, table: DataFrame) -> float:
    row = table.filter(F.col("node") == node).select("confidence").first()
    return row[0] if row else 0.0


def independence_groups(paths: DataFrame) -> DataFrame:
    """(path, group): paths that share an interior node, directly or through others, form a group named by its least path.

    paths: (path, node). Each path is joined with the least path of each of its nodes; the components of these
    edges are found until nothing changes, however long a chain of paths is.
    """
    from evidentia.operators.iterate import checkpointed, components

    paths = checkpointed(paths.select("path", "node").filter("path is not null").distinct())
    least = paths.filter("node is not null").groupBy("node").agg(F.min("path").alias("least"))
    roots = components(paths.join(least, "node").select(F.col("path").alias("u"), F.col("least").alias("v")))
    named = paths.select("path").distinct().join(roots, F.col("path") == F.col("node"), "left")
    return named.select("path", F.coalesce("root", "path").alias("group"))
