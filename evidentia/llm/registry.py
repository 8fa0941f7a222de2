"""The corpus operators' queries: each applies its operator to whole tables and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, byte_repeats, lm, media, mixing, pages, quality, simhash, sketches, toxicity
from evidentia.llm.common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by how much more they are like the conversations than like the documents; six digits."""
    scored = lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"))
    return scored.withColumns({c: F.round(c, 6) for c in ("target_loss", "background_loss", "score")})


def _classified(spark: SparkSession, sf_dir: str, kind, label: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kind.scores(docs, kind.fit(docs, labels, label)).withColumn("predicted", (F.col("score") >= kind.THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, "quality")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, "toxic")


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op10_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_main_text, op3_cross_entropy_difference, op4_quality, op5_bpe_round_trip, op6_toxicity, op7_simhash_classes, op8_sketches, op9_media, op10_byte_repeats)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {"op1_mix": mixing.SQL, "op3_cross_entropy_difference": lm.SQL, "op8_sketches": sketches.SQL, "op10_byte_repeats": byte_repeats.SQL}
