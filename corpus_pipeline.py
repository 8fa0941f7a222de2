"""A corpus pipeline of the llm operators: each stage takes all that the one before kept.

Values, in every stage: null texts count as empty and are kept as such (a null source counts as '' in the
mixture); rows without doc_id are never near copies and come before all others where order counts; several rows
of one doc_id each count with their own text, rows alike in doc_id and text go down to one; empty tables give
empty results; columns besides those of documents are handed on, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import bpe, byte_repeats, mixing, simhash, toxicity
from evidentia.llm.common import drop_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier learns from the labels of the documents that are there."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a Jaccard coefficient of 0.8 or more) the smallest doc_id stays."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller doc_id has are cut out of the texts."""
    return byte_repeats.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, in shuffled order."""
    return mixing.mix(docs).drop("replica")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids (their number and digest) and the digest of what they decode to."""
    # executors hold what the stages before have touched, too
    return bpe.round_trip(docs, share=0.16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("byte_repeats", cut_repeats),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages' classifier, components and byte passages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
