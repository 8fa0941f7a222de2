"""Enrichment scheduling: novelty, priority, passes, claims and their reconciliation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators.iterate import checkpointed


def novel(hash_: str, model: str, policy: int) -> Column:
    """No fresh watermark of this content, model and policy (columns of a left join)."""
    known = (F.col("state") == "fresh") & (F.col("content_hash") == F.col(hash_)) & (F.col("model") == model) & (F.col("policy_version") == policy)
    return ~F.coalesce(known, F.lit(False))


def candidates(content: DataFrame, nodes: DataFrame, watermarks: DataFrame, model: str, policy: int) -> DataFrame:
    """Contents (node_id, body) of visible zones that changed since they were enriched."""
    zone = nodes.filter(~F.col("kind").isin(*schema.GENERATED)).select(F.col("id").alias("node_id"))
    hashed = content.filter(F.length("body") > 0).withColumn("body_hash", scalars.sha256(F.col("body")))
    marks = watermarks.select("node_id", "content_hash", "policy_version", "model", "state")
    return hashed.join(zone, "node_id", "left_semi").join(marks, "node_id", "left").filter(novel("body_hash", model, policy)).select("node_id", "body", "body_hash")


def priorities(found: DataFrame, degree: DataFrame, corroborated: DataFrame, demand: Column | None = None, threshold: float = DEFAULT.enrich_threshold, w_central: float = DEFAULT.weight_central, w_critical: float = DEFAULT.weight_criticality, w_demand: float = DEFAULT.weight_demand, k: float = DEFAULT.centrality_k) -> DataFrame:
    """Adds central, criticality, score and worth_it; a node without corroboration is wholly critical."""
    joined = found.join(degree.withColumnRenamed("node", "node_id"), "node_id", "left").join(corroborated.withColumnRenamed("node", "node_id"), "node_id", "left")
    central = scalars.centrality(F.coalesce("degree", F.lit(0)), k)
    critical = 1 - F.coalesce("confidence", F.lit(0.0))
    scored = joined.withColumn("central", central).withColumn("criticality", critical)
    score = F.col("central") * w_central + F.col("criticality") * w_critical + (demand if demand is not None else F.lit(0.0)) * w_demand
    return scored.withColumn("score", score).withColumn("worth_it", F.col("score") >= threshold).drop("degree", "confidence")


def queue(scored: DataFrame, limit: int = DEFAULT.per_pass) -> DataFrame:
    return scored.filter("worth_it").orderBy(F.desc("score"), "node_id").limit(limit)


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the value at the lower nearest rank, trunc(p * (n - 1))."""
    return F.when(F.size(values) > 0, F.element_at(values, F.floor(F.lit(p) * (F.size(values) - 1)).cast("int") + 1))


def pass_summary(scored: DataFrame) -> DataFrame:
    """One row over all candidates: counts, and the scores' least, p50, p90, p99 and greatest.

    Ranks come from counts of distinct scores, so no task holds all scores.
    """
    total = scored.agg(F.count("*").alias("candidate_count"), F.coalesce(F.sum(F.col("worth_it").cast("long")), F.lit(0)).alias("worth_it_count"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    # how many candidates have a score up to each distinct one; the ranks asked for fall on one of them
    counts = scored.filter("score is not null").groupBy("score").agg(F.count("*").alias("n"))
    placed = ranked_counts(counts)
    ps = placed.join(F.broadcast(counts.agg(F.sum("n").alias("_n"))))
    at = [F.min(F.when(F.col("upto") >= F.floor(F.lit(p) * (F.col("_n") - 1)) + 1, F.col("score"))).alias(f"score_p{round(p * 100)}") for p in (0.5, 0.9, 0.99)]
    return total.join(F.broadcast(ps.agg(*at))).select("candidate_count", "worth_it_count", "score_min", "score_p50", "score_p90", "score_p99", "score_max")


def ranked_counts(counts: DataFrame) -> DataFrame:
    """Adds ``upto``: the sum of n over scores up to each, by ranges of score whose sums are added first."""
    wide = counts.withColumn("_b", F.floor(F.col("score") * 256))
    before = wide.groupBy("_b").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy("score"))
    return wide.withColumn("_i", inside).join(F.broadcast(before.select("_b", "_before")), "_b").select("score", "n", (F.col("_i") + F.col("_before")).alias("upto"))


def next_generation(passes: DataFrame) -> DataFrame:
    return passes.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).alias("generation"))


def leasable(nodes: DataFrame, as_of: Column) -> DataFrame:
    """Nodes that nobody holds, or whose lease has run out."""
    return nodes.filter(F.col("lease_until").isNull() | (F.col("lease_until") < as_of))


def extract(passages: DataFrame, model: Callable[[list[str]], list[str]], chars: int = DEFAULT.passage_chars) -> DataFrame:
    """(node_id, answer) of an injected model over each body's first characters."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return pd.Series(model([t[:chars] for t in s]))

    return passages.select("node_id", ask("body").alias("answer"))


def claim_edges(answers: DataFrame) -> DataFrame:
    """(node_id, subject, predicate, object, provenance, origin, reliability, kind) of the answers' complete claims."""
    rows = answers.select("node_id", F.explode(scalars.claims(F.col("answer"))).alias("c"))
    rows = rows.select("node_id", scalars.entity_key(F.col("c.s")).alias("subject"), scalars.predicate_key(F.col("c.p")).alias("predicate"), scalars.entity_key(F.col("c.o")).alias("object"))
    rows = rows.filter("subject <> '' and predicate <> '' and object <> ''").distinct()
    name = F.concat(F.lit("enrich:node:"), F.col("node_id").cast("string"))
    origin = F.concat(F.lit("enrich:origin:node:"), F.col("node_id").cast("string"))
    return rows.withColumn("provenance", name).withColumn("origin", origin).withColumn("reliability", F.lit(DEFAULT.claim_reliability)).withColumn("kind", F.lit("claim"))


def reconcile(evidence: DataFrame, kept: DataFrame, sources: DataFrame) -> DataFrame:
    """The log without rows of re-read sources (provenance) whose edge wasn't found again; folding it drops orphaned edges and recounts."""
    key = ["src", "dst", "type", "scope", "provenance"]
    again = evidence.join(sources.select("provenance"), "provenance", "left_semi")
    stale = again.join(kept.select(*key), key, "left_anti").select(*key).distinct()
    return evidence.join(stale, key, "left_anti")


def outcome(kind: Column, body: Column, is_novel: Column) -> Column:
    return F.when(kind.isin(*schema.GENERATED), "generated_zone").when(body.isNull() | (F.trim(body) == ""), "no_body").when(~is_novel, "watermarked").otherwise("enrich")


def record(watermarks: DataFrame, done: DataFrame) -> DataFrame:
    """The latest watermark of each node; ``done`` has the next generation."""
    both = watermarks.unionByName(done, allowMissingColumns=True)
    return both.groupBy("node_id").agg(F.max_by(F.struct(*[c for c in both.columns if c != "node_id"]), "generation").alias("w")).select("node_id", "w.*")


def run_pass(content: DataFrame, nodes: DataFrame, watermarks: DataFrame, degree: DataFrame, corroborated: DataFrame, model: Callable[[list[str]], list[str]], name: str, policy: int, generation: int, as_of: Column, limit: int = DEFAULT.per_pass) -> dict[str, DataFrame]:
    """One pass over a snapshot: its summary, the queue's decisions, the claims found, and the watermarks after it.

    nodes carry ``lease_until``; a queued node that somebody holds is 'locked' and left for a later pass.
    """
    found = candidates(content, nodes, watermarks, name, policy)
    scored = priorities(found, degree, corroborated)
    chosen = queue(scored, limit)
    free = leasable(nodes, as_of).select(F.col("id").alias("node_id"), F.lit(True).alias("_free"))
    decided = checkpointed(chosen.join(free, "node_id", "left").withColumn("decision", F.when(F.col("_free"), "enriched").otherwise("locked")).withColumn("generation", F.lit(generation)).drop("_free"))
    work = decided.filter("decision = 'enriched'")
    done = work.select("node_id", F.col("body_hash").alias("content_hash"), F.lit(policy).alias("policy_version"), F.lit(name).alias("model"), F.lit("fresh").alias("state"), "generation")
    return {"summary": pass_summary(scored), "decisions": decided.drop("body"), "claims": claim_edges(extract(work, model)), "watermarks": record(watermarks, done)}
