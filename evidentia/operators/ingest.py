"""The ingest boundary: normalise, deduplicate, validate at event grain, and fold into the tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.functions import scalars
from evidentia.operators import evidence


def normalised(events: DataFrame) -> DataFrame:
    """NFC texts, defaults, the event's time in UTC, and ``reason`` for events that cannot be taken."""
    out = events.withColumn("provenance", scalars.nfc("provenance")).withColumn("origin", F.coalesce(scalars.nfc("origin"), scalars.nfc("provenance")))
    out = out.withColumn("ts", scalars.utc_timestamp(F.col("occurred_at")))
    complete = F.forall("entities", lambda e: e["type"].isNotNull() & e["key"].isNotNull())
    linked = F.forall("relations", lambda r: r["from"].isNotNull() & r["to"].isNotNull() & r["type"].isNotNull())
    typed = F.forall("entities", lambda e: e["type"].rlike(schema.TYPE_FORMAT) & e["type"].isin(*schema.NODE_TYPES) & F.coalesce(e["scope"], F.lit("private")).isin(*schema.SCOPES))
    formed = F.forall("relations", lambda r: r["type"].rlike(schema.TYPE_FORMAT))
    keys = F.transform("entities", lambda e: e["key"])
    clear = F.size(F.array_distinct(keys)) == F.size(F.array_distinct(F.transform("entities", lambda e: F.struct(e["type"], e["key"]))))
    rules = [(F.trim("provenance") != "", "invalid_provenance"), (F.col("ts").isNotNull(), "bad_timestamp"), (F.coalesce(complete, F.lit(True)), "invalid_entity"), (F.coalesce(linked, F.lit(True)), "invalid_relation"), (F.coalesce(typed, F.lit(True)), "invalid_entity_contract"), (F.coalesce(formed, F.lit(True)), "invalid_relation_contract"), (F.coalesce(clear, F.lit(True)), "ambiguous_key")]
    return out.withColumn("reason", schema.first_reason(rules))


@dataclass
class Ingested:
    """What a batch amounts to; ``outcomes`` has one row for each event."""

    outcomes: DataFrame
    nodes: DataFrame
    evidence: DataFrame
    bodies: DataFrame
    dead: DataFrame


def firsts(events: DataFrame) -> DataFrame:
    """(provenance, seq): the first event of each provenance, the only one that is written."""
    return events.groupBy("provenance").agg(F.min("seq").alias("seq"))


def ingest(events: DataFrame, seen: DataFrame | None = None) -> Ingested:
    """Outcome written, duplicate (its provenance was written before) or quarantined of each event, and the written ones' rows.

    A rejected event leaves nothing behind. Relations whose ends the event doesn't declare are dropped; a
    relation's scope is the narrower of its ends' declared scopes.
    """
    checked = normalised(events)
    good = checked.filter("reason is null")
    first = firsts(good).withColumnRenamed("seq", "_first")
    marked = good.join(first, "provenance")
    if seen is not None:
        marked = marked.join(seen.select("provenance").distinct().withColumn("_old", F.lit(True)), "provenance", "left")
    else:
        marked = marked.withColumn("_old", F.lit(None).cast("boolean"))
    status = F.when(F.col("_old") | (F.col("seq") > F.col("_first")), "duplicate").otherwise("written")
    marked = marked.withColumn("outcome", status)
    written = marked.filter("outcome = 'written'")
    outcomes = marked.select("seq", "provenance", "outcome", "reason").unionByName(checked.filter("reason is not null").select("seq", "provenance", F.lit("quarantined").alias("outcome"), "reason"))
    e = written.select("seq", "ts", F.explode("entities").alias("e"))
    entities = e.select("seq", "ts", F.col("e.type").alias("type"), scalars.nfc("e.key").alias("key"), F.coalesce("e.scope", F.lit("private")).alias("scope"), F.coalesce(scalars.nfc("e.content"), F.lit("")).alias("body"))
    r = written.select("seq", "ts", "provenance", "origin", F.explode("relations").alias("r")).select("seq", "ts", "provenance", "origin", scalars.nfc("r.from").alias("_f"), scalars.nfc("r.to").alias("_t"), F.col("r.type").alias("type"))
    end = lambda at, t, k, s: entities.select("seq", F.col("key").alias(at), F.col("type").alias(t), F.col("key").alias(k), F.col("scope").alias(s)).distinct()
    joined = r.join(end("_f", "src_type", "src_key", "_a"), ["seq", "_f"]).join(end("_t", "dst_type", "dst_key", "_b"), ["seq", "_t"])
    rows = joined.select("src_type", "src_key", "dst_type", "dst_key", "type", schema.narrowest(F.col("_a"), F.col("_b")).alias("scope"), "provenance", "origin", "seq", "ts", F.lit(1.0).alias("weight"), F.lit(1.0).alias("reliability"), F.lit("observation").alias("kind"))
    dead = evidence.dead_letters(checked.filter("reason is not null").select(*events.columns, "reason"))
    return Ingested(outcomes, evidence.upsert_nodes(entities), rows, entities.filter(F.trim("body") != "").select("type", "key", "body", "seq"), dead)
