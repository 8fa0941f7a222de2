"""Mixing sources to target weights by Poisson replication.

A source with target weight w and size n gets the mean rate w * budget / n. Each document inverts the
Poisson distribution of its source's rate at a uniform number that a hash of the seed and its doc_id
gives: its count is the number of cumulative probabilities that do not exceed it. So a run can be
repeated, any part of it alone, and expected sizes meet the weights without a look at other documents.
Documents are exploded by their count and dealt out by a hash of (seed, doc_id, replica), in whose
order each partition is written: a global shuffle with one exchange.

All of it is DataFrame operations. A source is never gathered in one task: its size is a sum with
partial sums, and the rates reach the documents as a broadcast if their tables take at most
``BROADCAST_BYTES``, else by a join in which large sources are cut into shares.

Values: a null source counts as the source ''; a null size as 0; a source whose size or weight is 0 gets
the rate 0 (no rows). Rows with one doc_id share their count; a null doc_id is hashed as 'null'. The
column ``replica`` (from 1) replaces one of that name; all other columns are handed on, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut

SEED = "mix-1"
#: Bytes of the sources' tables up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
#: Rows of a source's share beyond that; sources of more rows are at most ``MANY`` (a name and a number each).
SHARE = 1 << 20
MANY = 100_000
#: A larger rate is drawn as the sum of so many Poisson numbers that each has at most this mean.
MAX_MEAN = 256.0


def uniform(*parts: Column) -> Column:
    """In [0, 1), from 52 bits of the MD5 of the parts joined by ':'."""
    digest = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """The cumulative probabilities for 0, 1, ... up to so far beyond the mean that 1 is reached in double precision."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), F.array(p0).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = 0.7, size: str = "n_chars") -> DataFrame:
    """(mix_source, mix_rate): each source's mean number of copies of a document.

    Without weights, a source's weight is its size to the power ``temperature``; with them, sources that
    they don't name get 0. The weights' sum is scaled to 1; the budget is ``epochs`` times all sizes.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.sum(F.coalesce(F.col(size), F.lit(0)).cast("double")).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("mix_source")).cast("double"), F.lit(0.0)))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.col("weight") / F.col("all_weight") * F.col("all_size") * F.lit(float(epochs)) / F.col("size")
    rate = F.when((F.col("size") > 0) & (F.col("weight") > 0), share).otherwise(0.0)
    # one row of totals beside one row for each source
    return sizes.join(F.broadcast(total)).select("mix_source", rate.alias("mix_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = 0.7, size: str = "n_chars", seed: str = SEED) -> DataFrame:
    """The documents' columns and ``replica``: each document as often as its Poisson number tells, in shuffled order."""
    table = rates(docs, weights, epochs, temperature, size)
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / MAX_MEAN)).cast("int"))
    table = cut(table.withColumn("cdf", poisson_table(F.col("mix_rate") / F.col("draws"))).select(F.col("mix_source").alias("source"), "draws", "cdf"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the documents as one value: no name of theirs can clash with one of these
    columns = [c for c in docs.columns if c != "replica"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), name.alias("name"), F.coalesce("source", F.lit("")).alias("source"))
    bytes_ = table.agg(F.coalesce(F.sum(F.lit(16) + F.octet_length("source") + 8 * F.size("cdf")), F.lit(0))).first()[0]
    if bytes_ <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(table), "source")
    else:
        # large sources are cut into shares of about as many rows
        shares = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
        salted = table.join(shares, "source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        many = F.broadcast(shares.filter("shares > 1").limit(MANY))
        keyed = keyed.join(many, "source", "left")
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.coalesce("shares", F.lit(1)).cast("long")).cast("int")).drop("shares")
        joined = keyed.join(salted.drop("shares"), ["source", "salt"])
    draw = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(seed), F.col("name"), j.cast("string"))))
    joined = joined.withColumn("u", uniform(F.lit(seed), F.col("name"), F.lit("0")))
    one = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    more = F.aggregate(F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0), lambda a, j: a + draw(j))
    count = one + F.when(F.col("draws") > 1, more).otherwise(0)
    copies = joined.withColumn("n", count).filter("n > 0").select("row", "name", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("replica"))
    # by the row, too: many rows may have no doc_id
    key = F.xxhash64(F.lit(seed), F.col("name"), F.col("replica"), F.when(F.col("name") == "null", F.xxhash64("row.text")) if "text" in columns else F.lit(0))
    dealt = copies.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    return dealt.select("row.*", "replica")


#: DuckDB SQL of ``mix`` with its defaults.
SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS s, sum(CAST(coalesce(n_chars, 0) AS DOUBLE)) AS size FROM documents GROUP BY 1),
total AS (SELECT sum(size) AS all_size, sum(pow(size, 0.7)) AS all_weight FROM sizes),
rate AS (
  SELECT s, CASE WHEN size > 0 THEN pow(size, 0.7) / all_weight * all_size * 1.0 / size ELSE 0.0 END AS r FROM sizes, total),
cdf AS (
  SELECT s, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM rate
  UNION ALL
  SELECT s, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE k + 1 <= ceil(r + 12 * sqrt(r) + 40)),
tables AS (SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda c: c <= CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n
  FROM documents d JOIN tables ON coalesce(source, '') = s)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS replica FROM drawn WHERE n > 0
"""
