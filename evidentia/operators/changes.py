"""What an operation tells the change feed: rows (change, target_key, payload, idem_key, order), to be numbered by ``evidence.outbox``.

Each kind is derived from the rows that the operation writes, so it is there exactly when they are; a repeated
row has the same idem_key and is told once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import evidence


def _rows(df: DataFrame, change: Column | str, target: Column, payload: Column, idem: Column, order: Column) -> DataFrame:
    kind = F.lit(change) if isinstance(change, str) else change
    return df.select(kind.alias("change"), target.alias("target_key"), F.to_json(payload).alias("payload"), idem.alias("idem_key"), order.cast("long").alias("order"))


def _named(prefix: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in columns])


def node_added(nodes: DataFrame, order: str = "id") -> DataFrame:
    """Of inserted nodes (id, type)."""
    return _rows(nodes, "node_added", _named("node", "id"), F.struct("id", "type"), _named("node", "id"), F.col(order))


def content_added(bodies: DataFrame, order: str = "seq") -> DataFrame:
    """Of put bodies (node_id, seq), changed or not; one row a node however often its body came."""
    return _rows(bodies, "content_added", _named("node", "node_id"), F.struct("node_id"), _named("content", "node_id"), F.col(order))


def edge_reinforced(events: DataFrame) -> DataFrame:
    """Of events that brought an edge a new witness: the count it then had is in the payload."""
    from pyspark.sql import Window

    new = evidence.classified(events).filter("outcome = 'new_origin'")
    seen = F.row_number().over(Window.partitionBy(*evidence.EDGE_KEY).orderBy("seq", "ts"))
    edge = F.concat_ws(":", F.lit("edge"), *[F.col(c).cast("string") for c in evidence.EDGE_KEY])
    counted = new.withColumn("seen_count", seen)
    return _rows(counted, "edge_reinforced", edge, F.struct("src", "dst", "type", "scope", "seen_count"), F.concat_ws(":", edge, "provenance"), F.col("seq"))


def merges(outcomes: DataFrame, order: str = "seq") -> DataFrame:
    """Of merge requests with their outcome (into_id, alias_id, outcome, seq): merged and refused ones are told, the others did nothing."""
    told = outcomes.filter(F.col("outcome").isin("merged", "refused_cross_scope"))
    merged = F.col("outcome") == "merged"
    kind = F.when(merged, "node_merged").otherwise("merge_refused")
    payload = F.struct(F.col("into_id").alias("into"), F.col("alias_id").alias("from"), F.when(~merged, "cross_scope").alias("reason"))
    idem = F.concat(F.when(merged, "merge:").otherwise("merge_refused:"), F.col("alias_id").cast("string"), F.lit("->"), F.col("into_id").cast("string"))
    return _rows(told, kind, _named("node", "into_id"), payload, idem, F.col(order))
