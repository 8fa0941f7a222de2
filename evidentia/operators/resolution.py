"""Entity resolution: propose, confirm, choose survivors, merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators.iterate import checkpointed, components


#: Entities of a tile's side.
TILE = 4096
#: Rows of a tile whose products are held at once.
STRIP = 512
#: Products of a tile that cost about as much as one pair that a join brings together.
CHEAPER = 50


def scored_pairs(entities: DataFrame, cosine: float = DEFAULT.pair_cosine, best: int | None = None, jaccard: float | None = None) -> DataFrame:
    """(type, scope, left_id, left_key, right_id, right_key, cosine) of entities (id, type, scope, key, vec) of one type and scope.

    A (type, scope) is cut into blocks of about ``TILE`` entities, and each two blocks are one task's matrix
    product; with ``best`` a tile gives no more than its so many closest pairs, with ``jaccard`` only those whose
    keys share enough words, and how many as ``lex`` (keys without words share none).
    """
    kind = {f.name: f.dataType.simpleString() for f in entities.schema}
    vec = F.col("vec") if kind["vec"] in ("array<float>", "array<double>") else F.col("vec").cast("array<double>")
    words = [] if jaccard is None else [F.coalesce(scalars.word_set(F.col("key")), F.array().cast("array<string>")).alias("_w")]
    rows = entities.filter("vec is not null").select("type", "scope", "id", "key", vec.alias("vec"), *words)
    sizes = rows.groupBy("type", "scope").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_blocks"))
    rows = rows.join(sizes, ["type", "scope"]).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks").cast("long")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("type", "scope", "id", "key", "vec", *["_w" for _ in words], "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    schema = f"type {kind['type']}, scope {kind['scope']}, left_id {kind['id']}, left_key {kind['key']}, right_id {kind['id']}, right_key {kind['key']}, cosine double" + ("" if jaccard is None else ", lex double")

    def closest(pairs: pa.Table) -> pa.Table:
        if best is None or len(pairs) <= best:
            return pairs
        ranked = pairs.append_column("_r", pa.array(np.round(pairs.column("cosine").to_numpy(), 12)))
        return pairs.take(pc.sort_indices(ranked, [("_r", "descending"), ("left_id", "ascending"), ("right_id", "ascending")])[:best])

    def tile(t: pa.Table) -> pa.Table:
        sides = [t.filter(pc.equal(t.column("_own"), t.column(c)[0])) for c in ("_i", "_j")]
        one = t.column("_i")[0] == t.column("_j")[0]
        unit, sets = [], []
        for s in sides:
            v = s.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(s), -1)
            length = np.linalg.norm(v, axis=1, keepdims=True)
            unit.append(np.divide(v, length, out=np.zeros_like(v), where=length > 0))
            if jaccard is not None:
                # one number for each set of words
                found: dict[tuple, int] = {}
                sets.append((np.array([found.setdefault(tuple(sorted(w)), len(found)) for w in s.column("_w").to_pylist()], np.int64), [frozenset(x) for x in found]))

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            (left, of), (right, at) = sets
            met, where = np.unique(left[a] * len(at) + right[b], return_inverse=True)
            x, y = ([side[i] for i in part.tolist()] for side, part in ((of, met // max(1, len(at))), (at, met % max(1, len(at)))))
            return np.array([len(p & q) / max(1, len(p | q)) for p, q in zip(x, y, strict=True)], float)[where]

        pieces = []
        for start in range(0, max(1, len(sides[0])), STRIP):
            near = unit[0][start : start + STRIP] @ unit[1].T
            a, b = np.nonzero(near >= cosine)
            value, a = near[a, b], a + start
            if one:
                # each pair is met twice here, and each entity meets itself
                keep = (a < b) & pc.not_equal(sides[0].column("id").take(pa.array(a)), sides[1].column("id").take(pa.array(b))).to_numpy()
                a, b, value = a[keep], b[keep], value[keep]
            lex = None if jaccard is None else alike(a, b)
            if lex is not None:
                keep = lex >= jaccard
                a, b, value, lex = a[keep], b[keep], value[keep], lex[keep]
            found = pa.table({f"{p}_{c}": s.column(c).take(pa.array(i)) for p, s, i in (("a", sides[0], a), ("b", sides[1], b)) for c in ("id", "key")} | {"cosine": pa.array(value)})
            turned = pc.greater(found.column("a_id"), found.column("b_id"))
            pick = lambda x, y, c: pc.if_else(turned, found.column(f"{x}_{c}"), found.column(f"{y}_{c}"))  # noqa: E731, B023
            out = {"type": pa.array([t.column("type")[0].as_py()] * len(found), t.schema.field("type").type), "scope": pa.array([t.column("scope")[0].as_py()] * len(found), t.schema.field("scope").type)}
            out |= {"left_id": pick("b", "a", "id"), "left_key": pick("b", "a", "key"), "right_id": pick("a", "b", "id"), "right_key": pick("a", "b", "key"), "cosine": found.column("cosine")} | ({} if lex is None else {"lex": pa.array(lex)})
            pieces.append(closest(pa.table(out)))
        return closest(pa.concat_tables(pieces))

    return rows.groupBy("type", "scope", "_i", "_j").applyInArrow(tile, schema)


def without_known(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs that no alias joins, in either direction."""
    known = aliases.select("type", F.least("alias_key", "canonical_key").alias("_x"), F.greatest("alias_key", "canonical_key").alias("_y"))
    asked = pairs.withColumn("_x", F.least("left_key", "right_key")).withColumn("_y", F.greatest("left_key", "right_key"))
    return asked.join(known, ["type", "_x", "_y"], "left_anti").drop("_x", "_y")


def with_jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lex", scalars.jaccard(scalars.word_set(F.col("left_key")), scalars.word_set(F.col("right_key"))))


def propose(entities: DataFrame, aliases: DataFrame | None = None, cosine: float = DEFAULT.pair_cosine, jaccard: float = DEFAULT.pair_jaccard, max_pairs: int | None = DEFAULT.max_pairs) -> DataFrame:
    """Candidate pairs: the closest ``max_pairs`` by cosine, of these the ones whose keys share enough words.

    Without ``max_pairs`` and with a jaccard above 0 a pair shares one of its keys' rarer words: pairs are blocked by
    these where that is less work than all pairs' products in tiles. Neither way loses one.
    """
    if max_pairs is None and jaccard > 0:
        return _blocked(entities, aliases, cosine, jaccard)
    # known pairs go before the limit, so that a tile can't choose its best without them
    pairs = scored_pairs(entities, cosine, max_pairs if aliases is None else None)
    if aliases is not None:
        pairs = without_known(pairs, aliases)
    if max_pairs is not None:
        pairs = pairs.orderBy(F.round("cosine", 12).desc(), "left_id", "right_id").limit(max_pairs)
    return with_jaccard(pairs).filter(F.col("lex") >= jaccard)


def _blocked(entities: DataFrame, aliases: DataFrame | None, cosine: float, jaccard: float) -> DataFrame:
    words = entities.withColumn("_w", scalars.word_set(F.col("key")))
    # of a key's words, all but the last ceil(jaccard * n) - 1 rarest-first ones are enough to meet a partner
    rare = words.select("id", "type", "scope", F.size("_w").alias("_n"), F.explode("_w").alias("w"))
    counts = rare.groupBy("w").agg(F.count("*").alias("_c"))
    kept = rare.join(counts, "w").groupBy("id", "type", "scope", "_n").agg(F.sort_array(F.collect_list(F.struct("_c", "w"))).alias("_l"))
    prefix = F.slice("_l", 1, F.greatest(F.lit(1), F.col("_n") - F.ceil(F.col("_n") * F.lit(jaccard)).cast("int") + 1))
    blocks = kept.select("id", "type", "scope", F.explode(prefix).alias("p")).select("id", "type", "scope", "p.w")
    # as many pairs as words bring together, against all that there are
    pairs_in = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()[0]
    if pairs_in(blocks, "type", "scope", "w") * CHEAPER > pairs_in(entities, "type", "scope"):
        pairs = scored_pairs(entities, cosine, None, jaccard)
        if aliases is not None:
            pairs = without_known(pairs, aliases)
        return pairs
    a = blocks.select("type", "scope", "w", F.col("id").alias("left_id"))
    b = blocks.select("type", "scope", "w", F.col("id").alias("right_id"))
    meet = a.join(b, ["type", "scope", "w"]).filter("left_id < right_id").select("type", "scope", "left_id", "right_id").distinct()
    left = entities.select(F.col("id").alias("left_id"), F.col("key").alias("left_key"), F.col("vec").alias("_a"))
    right = entities.select(F.col("id").alias("right_id"), F.col("key").alias("right_key"), F.col("vec").alias("_b"))
    pairs = meet.join(left, "left_id").join(right, "right_id").withColumn("cosine", scalars.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b").filter(F.col("cosine") >= cosine)
    if aliases is not None:
        pairs = without_known(pairs, aliases)
    return with_jaccard(pairs).filter(F.col("lex") >= jaccard)


def survivors(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """Adds ``into`` and ``alias``: the higher degree survives, on a tie the lower id."""
    d = lambda side: degree.select(F.col("node").alias(f"{side}_id"), F.col("degree").alias(f"_{side}"))
    both = pairs.join(d("left"), "left_id", "left").join(d("right"), "right_id", "left")
    left, right = F.coalesce("_left", F.lit(0)), F.coalesce("_right", F.lit(0))
    first = (left > right) | ((left == right) & (F.col("left_id") < F.col("right_id")))
    return both.withColumn("into", F.when(first, F.col("left_id")).otherwise(F.col("right_id"))).withColumn("alias", F.when(first, F.col("right_id")).otherwise(F.col("left_id"))).drop("_left", "_right")


def merge_outcome(alias_exists: Column, same: Column, into_exists: Column, same_scope: Column) -> Column:
    """In this order: noop_no_alias, noop_same, renamed (there is no canonical node), refused_cross_scope, merged."""
    return F.when(~alias_exists, "noop_no_alias").when(same, "noop_same").when(~into_exists, "renamed").when(~same_scope, "refused_cross_scope").otherwise("merged")


def outcomes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``outcome`` to (type, alias_key, into_key)."""
    ends = lambda key, s: nodes.select("type", F.col("key").alias(key), F.col("scope").alias(s))
    both = requests.join(ends("alias_key", "_a"), ["type", "alias_key"], "left").join(ends("into_key", "_i"), ["type", "into_key"], "left")
    return both.withColumn("outcome", merge_outcome(F.col("_a").isNotNull(), F.col("alias_key") == F.col("into_key"), F.col("_i").isNotNull(), F.col("_a") == F.col("_i"))).drop("_a", "_i")


def roots(pairs: DataFrame) -> DataFrame:
    """(id, root) of all ids in confirmed pairs (into, alias): components, each named by its least id, however long a chain is."""
    return components(pairs.select(F.col("into").alias("u"), F.col("alias").alias("v"))).withColumnRenamed("node", "id")


def merge_evidence(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """The log with merged endpoints replaced and self-loops dropped; folding it again unions provenances and recounts witnesses.

    ``moved`` tells events whose edge was another one before: where edges meet, weight, reliability, kind and a
    shared provenance's origin are the surviving edge's.
    """
    evidence = evidence.withColumn("moved", F.coalesce(F.col("moved"), F.lit(False)) if "moved" in evidence.columns else F.lit(False))
    for end in ("src", "dst"):
        m = mapping.select(F.col("id").alias(end), F.col("root").alias("_r"))
        evidence = evidence.join(m, end, "left").withColumn("moved", F.col("moved") | F.coalesce(F.col("_r") != F.col(end), F.lit(False))).withColumn(end, F.coalesce("_r", end)).drop("_r")
    return evidence.filter("src <> dst")


def confirmed_by(pairs: DataFrame, generate: Callable[[str, str], str], model: str) -> DataFrame:
    """Adds ``same`` by a model's answer to (left_key, right_key), asked once a pair in batches: only a JSON object whose "same" is true is a yes; any doubt, other answer or failed call is a no."""
    import json

    def asked(a: str, b: str) -> bool:
        try:
            raw = generate(model, f"First: {a}\nSecond: {b}\nAre these one and the same entity? Answer as JSON with the field same.")
            found = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
        except (ValueError, TypeError, AttributeError, OSError, RuntimeError):
            return False
        return isinstance(found, dict) and found.get("same") is True

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([asked(x, y) for x, y in zip(a, b, strict=True)])

    return checkpointed(pairs.withColumn("same", same("left_key", "right_key")))


def summary(audit: DataFrame) -> DataFrame:
    """One row of proposed, confirmed and merged pairs of an audit (decision)."""
    is_ = lambda *d: F.sum(F.col("decision").isin(*d).cast("long"))
    return audit.agg(F.count("*").alias("proposed"), F.coalesce(is_("confirmed", "merged"), F.lit(0)).alias("confirmed"), F.coalesce(is_("merged"), F.lit(0)).alias("merged"))


def run_pass(entities: DataFrame, degree: DataFrame, confirm: Column, aliases: DataFrame | None = None, **thresholds: float) -> tuple[DataFrame, DataFrame]:
    """(audit, mapping): proposed pairs with their decision by an injected predicate over the pair's columns (null: no), and where merged ids go."""
    audit = survivors(propose(entities, aliases, **thresholds), degree)
    audit = checkpointed(audit.withColumn("decision", F.when(F.coalesce(confirm, F.lit(False)), "merged").otherwise("not_confirmed")))
    return audit, roots(audit.filter("decision = 'merged'"))
