"""Change feed, fences, leases, stalls: set forms over logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.config import DEFAULT


def gaps(outbox: DataFrame, after: int = 0) -> DataFrame:
    """(first_missing, last_missing) runs of sequence numbers beyond the cursor that never came.

    The number before each row is looked up by ranges of ``seq``, so no task orders the whole feed; one row for each
    65,536 numbers is ordered as one, and joined by whatever way its size allows.
    """
    rows = outbox.filter(F.col("seq") > after).select("seq", F.floor(F.col("seq") / 65_536).alias("_b"))
    before = F.lag("seq").over(Window.partitionBy("_b").orderBy("seq"))
    edges = rows.groupBy("_b").agg(F.max("seq").alias("_last")).select("_b", F.coalesce(F.lag("_last").over(Window.orderBy("_b")), F.lit(after)).alias("_carry"))
    seen = rows.withColumn("_p", before).join(edges, "_b").withColumn("_p", F.coalesce("_p", "_carry"))
    return seen.filter("seq - _p > 1").select((F.col("_p") + 1).alias("first_missing"), (F.col("seq") - 1).alias("last_missing"))


def in_order(outbox: DataFrame, after: int = 0) -> DataFrame:
    """The changes beyond the cursor in their order."""
    return outbox.filter(F.col("seq") > after).orderBy("seq")


def lanes(outbox: DataFrame) -> DataFrame:
    """Adds ``lane_seq``: each target's changes in their order; targets are independent."""
    return outbox.withColumn("lane_seq", F.row_number().over(Window.partitionBy("target_key").orderBy("seq")))


def unmatched(outbox: DataFrame, subscribed: list[str]) -> DataFrame:
    """(change, n) of kinds that nobody handles."""
    return outbox.filter(~F.col("change").isin(*subscribed)).groupBy("change").agg(F.count("*").alias("n"))


def stalled(nodes: DataFrame, as_of: Column, seconds: int = DEFAULT.stall_seconds) -> DataFrame:
    """Coordination nodes that nobody claimed for too long."""
    return nodes.filter((F.col("kind") == "coordination") & F.col("claimed_by").isNull() & (F.timestamp_diff("SECOND", F.col("created_at"), as_of) > seconds))


def fenced(claims: DataFrame) -> DataFrame:
    """Adds ``won``: a claim (id, token, seq) holds if its token is above all earlier ones of its id."""
    earlier = F.max("token").over(Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return claims.withColumn("won", F.col("token") > F.coalesce(earlier, F.lit(0)))


def fences(claims: DataFrame) -> DataFrame:
    return claims.groupBy("id").agg(F.greatest(F.max("token"), F.lit(0)).alias("fence"))


def renewals(log: DataFrame) -> DataFrame:
    """(id, holder, fence, lease_until, renewed, refused): leases after claims and renewals in order.

    log: (id, seq, op, holder, token, observed, until), all but id and seq possibly null; op is 'claim' or
    'renew'. A renewal holds only if holder, fence and the observed lease are the current ones. The log of
    one id is folded where it lies, in batches.
    """
    import pyarrow as pa

    def fold(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["seq"])
        holder, fence, until, renewed, refused = None, 0, None, 0, 0
        for r in rows:
            if r["op"] == "claim" and r["token"] is not None and r["token"] > fence:
                holder, fence, until = r["holder"], r["token"], r["until"]
            elif r["op"] == "renew" and (r["holder"], r["token"], r["observed"]) == (holder, fence, until):
                until, renewed = r["until"], renewed + 1
            else:
                refused += 1
        return pa.table({"id": pa.array([rows[0]["id"]], pa.int64()), "holder": pa.array([holder], pa.string()), "fence": pa.array([fence], pa.int64()), "lease_until": pa.array([until], pa.int64()), "renewed": pa.array([renewed], pa.int64()), "refused": pa.array([refused], pa.int64())})

    return log.select("id", "seq", "op", "holder", "token", "observed", "until").groupBy("id").applyInArrow(fold, "id long, holder string, fence long, lease_until long, renewed long, refused long")


def admitted(events: DataFrame, limit: int = DEFAULT.queue_limit) -> DataFrame:
    """Adds ``admitted``: the first ``limit`` events by seq fit a bounded queue, the rest are turned away."""
    last = events.select("seq").orderBy("seq").limit(limit).agg(F.max("seq").alias("_last"))
    return events.join(F.broadcast(last)).withColumn("admitted", F.col("seq") <= F.col("_last")).drop("_last")
