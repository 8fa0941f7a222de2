"""The evidence log and its folds: upserts and reinforcement as pure functions of append-only rows.

``seq`` is the order of arrival; events of one number are ordered by time and then by their values. Every fold is one aggregation with partial sums over the edge's
natural key; none needs the rows of a key together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.operators.iterate import checkpointed

EDGE_KEY = ("src", "dst", "type", "scope")


def witness() -> Column:
    """Who an event counts for: its origin, or itself."""
    return F.coalesce("origin", "provenance")


def classified(events: DataFrame) -> DataFrame:
    """Adds ``outcome``: duplicate (the edge has the provenance already), existing_origin, or new_origin.

    A duplicate's origin is not recorded, so it makes no later event's origin an existing one.
    """
    by_provenance = Window.partitionBy(*EDGE_KEY, "provenance").orderBy("seq", "ts")
    by_origin = Window.partitionBy(*EDGE_KEY, witness(), F.col("_p") == 1).orderBy("seq", "ts")
    ranked = events.withColumn("_p", F.row_number().over(by_provenance)).withColumn("_o", F.row_number().over(by_origin))
    outcome = F.when(F.col("_p") > 1, "duplicate").when(F.col("_o") > 1, "existing_origin").otherwise("new_origin")
    return ranked.withColumn("outcome", outcome).drop("_p", "_o")


def witnesses(events: DataFrame) -> DataFrame:
    """(src, dst, type, scope, witness, first): each edge's witnesses with the first event of each.

    A provenance counts once, by its first event: a later one of the same provenance is no witness, whatever its origin.
    """
    kept = [c for c in ("weight", "reliability", "kind") if c in events.columns]
    # of a merged log, what the surviving edge had comes before what was moved to it
    moved = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("moved",) if c in events.columns]
    once = events.groupBy(*EDGE_KEY, "provenance").agg(F.min(F.struct(*moved, "seq", "ts", "origin", *kept)).alias("first"))
    return once.groupBy(*EDGE_KEY, F.coalesce("first.origin", "provenance").alias("witness")).agg(F.min("first").alias("first"))


def fold_edges(events: DataFrame, rewards: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The edges that the log amounts to.

    The first event fixes weight, reliability and kind; ``seen_count`` is the number of witnesses,
    ``last_seen`` the time of the latest first event of a witness: repeats refresh nothing. rewards:
    (src, dst, type, scope, reward, seq), the latest holds. seen: ``witnesses(events)``, where a plan has them already.
    """
    kept = [c for c in ("weight", "reliability", "kind") if c in events.columns]
    per_witness = witnesses(events) if seen is None else seen
    edges = per_witness.groupBy(*EDGE_KEY).agg(F.min("first").alias("_f"), F.count("*").cast("int").alias("seen_count"), F.max("first.ts").alias("last_seen"))
    edges = edges.select(*EDGE_KEY, *[F.col(f"_f.{c}").alias(c) for c in kept], "seen_count", "last_seen")
    if rewards is None:
        return edges.withColumn("reward", F.lit(0.0))
    latest = rewards.groupBy(*EDGE_KEY).agg(F.max(F.struct("seq", "reward"))["reward"].alias("reward"))
    return edges.join(latest, list(EDGE_KEY), "left").withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def provenances(events: DataFrame) -> DataFrame:
    """One row for each edge and provenance, with its first event's origin."""
    return events.groupBy(*EDGE_KEY, "provenance").agg(F.min(F.struct("seq", "ts", "origin"))["origin"].alias("origin"))


def close_aliases(aliases: DataFrame) -> DataFrame:
    """(type, alias_key, canonical_key) with chains followed to their end by pointer doubling; a cycle ends at its least key.

    A round doubles the steps taken, so rounds are logarithmic in the longest chain; each is checkpointed.
    """
    current = aliases.select("type", "alias_key", "canonical_key", F.col("canonical_key").alias("low"))
    last = None
    while True:
        ahead = current.select("type", F.col("alias_key").alias("canonical_key"), F.col("canonical_key").alias("_next"), F.col("low").alias("_low"))
        current = checkpointed(current.join(ahead, ["type", "canonical_key"], "left"))
        # rows that lead on, and the least keys seen: a chain's rows become fewer, only cycles' stay
        now = current.agg(F.count("_next"), F.sum(F.xxhash64("alias_key", F.least("low", "_low")).cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == last:
            return current.select("type", "alias_key", F.coalesce("_low", "canonical_key").alias("canonical_key"))
        last = now
        current = current.select("type", "alias_key", F.coalesce("_next", "canonical_key").alias("canonical_key"), F.least("low", "_low").alias("low"))


def latest_aliases(log: DataFrame) -> DataFrame:
    """The last record of each (type, alias_key)."""
    return log.groupBy("type", "alias_key").agg(F.max_by("canonical_key", "seq").alias("canonical_key"))


def upsert_nodes(log: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(type, key, scope, updated_at): the first writer's scope stays; aliases name their canonical key."""
    if aliases is not None:
        known = aliases.withColumnRenamed("alias_key", "key")
        log = log.join(known, ["type", "key"], "left").withColumn("key", F.coalesce("canonical_key", "key"))
    return log.groupBy("type", "key").agg(F.min_by("scope", "seq").alias("scope"), F.max("ts").alias("updated_at"))


def insert_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted nodes and dead letters; rows without a key are all distinct."""
    checked = nodes.withColumn("reason", schema.node_reason(F.col("type"), F.col("scope"), F.col("reliability"), F.col("kind")))
    return checked.filter("reason is null").drop("reason"), dead_letters(checked.filter("reason is not null"))


def checked_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``reason``: why the write contract rejects an edge, or null."""
    ends = nodes.select(F.col("id"), F.col("scope").alias("_s"))
    joined = edges.join(ends.select(F.col("id").alias("src"), F.col("_s").alias("_src")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.col("_s").alias("_dst")), "dst", "left")
    origin = F.col("origin") if "origin" in edges.columns else F.lit(None).cast("string")
    reason = schema.edge_reason(F.col("type"), F.col("scope"), F.col("reliability"), F.col("provenance"), origin, F.col("kind"), F.col("_src"), F.col("_dst"))
    return joined.withColumn("reason", reason).drop("_src", "_dst")


def dead_letters(rejected: DataFrame) -> DataFrame:
    """(payload, reason): the whole row as JSON."""
    return rejected.select(F.to_json(F.struct(*[c for c in rejected.columns if c != "reason"])).alias("payload"), "reason")


def only_new(rows: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """One row for each key that isn't known yet."""
    rows = rows.dropDuplicates(keys)
    return rows if known is None else rows.join(known.select(*keys), keys, "left_anti")


def outbox(changes: DataFrame, offset: int = 0) -> DataFrame:
    """Numbers (change, target_key, payload, idem_key, order) without gaps from ``offset`` + 1, one row for each idem_key.

    Ranks come from the sizes of range partitions of the order, not from one sorted task.
    """
    once = changes.groupBy("idem_key").agg(F.min_by(F.struct("change", "target_key", "payload", "order"), "order").alias("c")).select("idem_key", "c.*")
    return ranked(once, ["order", "idem_key"], "seq", offset).drop("order")


def ranked(df: DataFrame, order: list[str], name: str, offset: int = 0) -> DataFrame:
    """A gapless total rank: a bucket's rank from the sizes of the buckets before it, then a rank inside the bucket.

    Buckets are quantile ranges of the first column, a number; a number that fills several of them is cut by the
    second column's first characters, so that no task ranks all rows of one number.
    """
    cuts = df.agg(F.percentile_approx(order[0], [i / 64 for i in range(1, 64)], 1000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>"), lambda c: c <= F.col(order[0]))).cast("string")
    often = sorted({c for c in cuts if cuts.count(c) > 1})
    if often and len(order) > 1:
        # '' comes before any sign: rows of the number itself come before the rest of its range
        same = F.col(order[0]).isin(*often)
        bucket = F.concat(F.lpad(bucket, 2, "0"), F.when(same, F.concat(F.lit("a"), F.substring(F.col(order[1]).cast("string"), 1, 12))).otherwise("b"))
    else:
        bucket = F.lpad(bucket, 2, "0")
    placed = df.withColumn("_b", F.coalesce(bucket, F.lit("")))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_b").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return placed.withColumn("_r", inside).join(sizes, "_b").withColumn(name, (F.col("_r") + F.col("_before") + offset).cast("long")).drop("_b", "_r", "_before")


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last row (by ``seq``) of each key: namespaces, watermarks, aliases and the like."""
    rest = [c for c in log.columns if c not in keys and c != "seq"]
    return log.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def recent(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)
