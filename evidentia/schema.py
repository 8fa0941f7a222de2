"""Vocabularies, table schemas and the write contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
SCHEMA_VERSION = 5
SCOPES = ("private", "group", "public")
NODE_TYPES = ("self", "agent", "user", "source", "article", "concept", "entity", "event", "file", "dir", "task", "ticket", "anchor")
KINDS = ("observation", "claim", "hypothesis", "coordination", "lease", "derived", "presentation", "durable_fact")
GENERATED = ("claim", "hypothesis", "derived")
STRUCTURAL = ("links_to", "child_of")
TYPE_FORMAT = "^[a-z][a-z0-9_]*$"

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType())}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n.rstrip("_"), _SIMPLE[k] if isinstance(k, str) else k) for n, k in fields.items()])


EVENT = _struct(source="string", provenance="string", origin="string", occurred_at="string", entities=T.ArrayType(_struct(type="string", key="string", scope="string", content="string")), relations=T.ArrayType(_struct(from_="string", to="string", type="string")), seq="long")
NODE = _struct(id="long", type="string", key="string", scope="string", kind="string", reliability="double", created_at="timestamp")
EVIDENCE = _struct(src="long", dst="long", type="string", scope="string", provenance="string", origin="string", seq="long", ts="timestamp", weight="double", reliability="double", kind="string")
EDGE = _struct(src="long", dst="long", type="string", scope="string", weight="double", reliability="double", kind="string", seen_count="int", last_seen="timestamp", reward="double")
CHUNK = _struct(id="long", node_id="long", ordinal="int", text="string", vec="floats", token_count="int")
OUTBOX = _struct(seq="long", change="string", target_key="string", payload="string", idem_key="string")
DEAD_LETTER = _struct(payload="string", reason="string")
STAGNANT = _struct(reason="string", ref="string", detail="string")
ANSWER = _struct(status="string", answer="string", confidence="double", tier="string", citations=T.ArrayType(_struct(source="string", ref="string", confidence="double")))


def scope_rank(scope: Column) -> Column:
    """0 for private, 1 for group, 2 for public, null for anything else."""
    at = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), scope)
    return F.when(at > 0, (at - 1).cast("int"))


def narrowest(*scopes: Column) -> Column:
    """The scope of the least rank."""
    return F.element_at(F.array(*[F.lit(s) for s in SCOPES]), F.least(*[scope_rank(s) for s in scopes]) + 1)


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that is violated (null counts as violated), or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for ok, reason in rules])


def node_reason(type_: Column, scope: Column, reliability: Column, kind: Column) -> Column:
    return first_reason([
        (type_.rlike(TYPE_FORMAT), "invalid_type_format"),
        (type_.isin(*NODE_TYPES), "unknown_type"),
        (scope.isin(*SCOPES), "invalid_scope"),
        (reliability.isNull() | reliability.between(0, 1), "invalid_reliability"),
        (kind.isin(*KINDS), "invalid_kind"),
    ])


def edge_reason(type_: Column, scope: Column, reliability: Column, provenance: Column, origin: Column, kind: Column, src_scope: Column, dst_scope: Column) -> Column:
    """First failure in the order type, scope, reliability, provenance, origin, kind, endpoints, visibility; a missing endpoint has a null scope."""
    return first_reason([
        (type_.rlike(TYPE_FORMAT), "invalid_type_format"),
        (scope.isin(*SCOPES), "invalid_scope"),
        (reliability.isNull() | reliability.between(0, 1), "invalid_reliability"),
        (F.trim(provenance) != "", "invalid_provenance"),
        (origin.isNull() | (F.trim(origin) != ""), "invalid_origin"),
        (kind.isin(*KINDS), "invalid_evidence_kind"),
        (src_scope.isNotNull(), "unknown_endpoint"),
        (dst_scope.isNotNull(), "unknown_endpoint"),
        (scope_rank(scope) <= F.least(scope_rank(src_scope), scope_rank(dst_scope)), "visibility_violation"),
    ])


def visible(df: DataFrame, scopes: list[str], *columns: str) -> DataFrame:
    """Rows whose scope columns are all granted; no grant, no rows."""
    if not scopes:
        return df.limit(0)
    return df.filter(reduce(Column.__and__, [F.col(c).isin(*scopes) for c in columns or ("scope",)]))
