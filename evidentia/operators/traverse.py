"""Bounded max-product traversal by level-synchronous relaxation.

Work grows with the edges reached, never with the number of paths. A level joins the frontier (nodes
reached or improved in the level before) with the edges and keeps the best confidence of each node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators import evidence
from evidentia.operators.iterate import checkpointed

#: Levels that one lazy plan holds; deeper walks are checkpointed at each level.
LAZY_DEPTH = 4
#: Nodes (a long each) that a level looks up by broadcast; more are looked up by an exchange.
FRONTIER = 100_000


def hops(edges: DataFrame, as_of: Column, nodes: DataFrame | None = None, scopes: list[str] | None = None, per_day: float = DEFAULT.decay_per_day) -> DataFrame:
    """(src, dst, factor) of the edges that may be walked; with scopes, edge and destination must be visible (the start is not checked)."""
    used = edges.filter("reward >= 0")
    if scopes is not None:
        seen = schema.visible(nodes, scopes).select(F.col("id").alias("dst"))
        used = schema.visible(used, scopes).join(seen, "dst", "left_semi")
    return used.select("src", "dst", (F.col("reliability") * scalars.decay(F.col("last_seen"), as_of, per_day)).alias("factor"))


def _level(state: DataFrame, best: DataFrame, level: int) -> DataFrame:
    """The state after a level: candidates merged in, ``fresh`` where a node is new or better."""
    old = state.select("seed", "id", "confidence", "depth")
    merged = old.join(best, ["seed", "id"], "full_outer")
    fresh = F.col("candidate").isNotNull() & (F.col("confidence").isNull() | (F.col("candidate") > F.col("confidence")))
    return merged.select("seed", "id", F.when(fresh, F.col("candidate")).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("depth", F.lit(level)).alias("depth"), fresh.alias("fresh"))


def _seeds(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.col("seed"), F.col("seed").alias("id"), F.lit(1.0).alias("confidence"), F.lit(0).alias("depth"), F.lit(True).alias("fresh"))


def reach(seeds: DataFrame, hop: DataFrame, depth: int) -> DataFrame:
    """(seed, id, confidence, depth): for each seed the best product over walks of up to ``depth`` edges, and the level first reached; the seed itself is left out."""
    state = _seeds(seeds)
    for level in range(1, depth + 1):
        frontier = state.filter("fresh").select("seed", F.col("id").alias("src"), "confidence")
        best = frontier.join(hop, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.max(F.col("confidence") * F.col("factor")).alias("candidate"))
        state = _level(state, best, level)
        if level % LAZY_DEPTH == 0 and level < depth:
            state = checkpointed(state)
    return state.filter("seed <> id").select("seed", "id", "confidence", "depth")


def reach_log(seeds: DataFrame, log: DataFrame, as_of: Column, depth: int, nodes: DataFrame | None = None, scopes: list[str] | None = None) -> DataFrame:
    """As ``reach`` over the folded log (with reward), but each level folds only the events of the nodes that it walks from.

    The source is in an edge's key, so the filter commutes with the fold: a level costs a scan, and the edges it reaches.
    """
    state = checkpointed(_seeds(seeds))
    for level in range(1, depth + 1):
        frontier = state.filter("fresh").select("seed", F.col("id").alias("src"), "confidence")
        starts = frontier.select("src").distinct()
        n = starts.count()
        if not n:
            break
        # read once, for the fold and the rewards: the events of the edges that the level reaches
        some = log.join(F.broadcast(starts) if n <= FRONTIER else starts, "src", "left_semi")
        some = checkpointed(some.hint("rebalance"))
        hop = hops(evidence.fold_edges(some.drop("reward"), some), as_of, nodes, scopes)
        best = frontier.join(hop, "src").groupBy("seed", F.col("dst").alias("id")).agg(F.max(F.col("confidence") * F.col("factor")).alias("candidate"))
        state = _level(state, best, level)
        state = checkpointed(state) if level < depth else state
    return state.filter("seed <> id").select("seed", "id", "confidence", "depth")


@dataclass
class Walk:
    hits: DataFrame
    truncated: bool


def walk(seeds: DataFrame, hop: DataFrame, depth: int, edge_budget: int = DEFAULT.edge_budget) -> Walk:
    """As ``reach``, but a level whose edges exceed what is left of the budget is not walked, and the result is marked truncated."""
    state, spent, truncated = _seeds(seeds), 0, False
    for level in range(1, depth + 1):
        frontier = state.filter("fresh").select("seed", F.col("id").alias("src"), "confidence")
        fetched = checkpointed(frontier.join(hop, "src").select("seed", F.col("dst").alias("id"), (F.col("confidence") * F.col("factor")).alias("candidate")))
        spent += fetched.count()
        if spent > edge_budget:
            truncated = True
            break
        state = checkpointed(_level(state, fetched.groupBy("seed", "id").agg(F.max("candidate").alias("candidate")), level))
        if state.filter("fresh").isEmpty():
            break
    return Walk(state.filter("seed <> id").select("seed", "id", "confidence", "depth"), truncated)


def ordered(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("confidence"), "id")


def expand(memories: DataFrame, hop: DataFrame, depth: int = DEFAULT.expand_depth) -> DataFrame:
    """(id, confidence, depth): what the memories (``seed``) lead to, each by its strongest reach, without the memories."""
    return strongest(reach(memories, hop, depth), memories)


def strongest(reached: DataFrame, memories: DataFrame) -> DataFrame:
    found = reached.join(memories.select(F.col("seed").alias("id")), "id", "left_anti")
    return found.groupBy("id").agg(F.max("confidence").alias("confidence"), F.max_by("depth", F.struct("confidence", -F.col("depth"))).alias("depth"))


def neighbours(start: DataFrame, edges: DataFrame, nodes: DataFrame, as_of: Column, depth: int, scopes: list[str]) -> DataFrame:
    """What an asker may see around the start; no scopes, nothing."""
    return reach(start, hops(edges, as_of, nodes, scopes), depth) if scopes else reach(start, hops(edges, as_of).limit(0), 1)
