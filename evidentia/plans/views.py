"""The driver's tables as the engine's tables.

One SQL text serves Spark and DuckDB: ``{t}`` stands for a table. Ids are a class times 10^9 plus the
table's key. Only what a query needs is read: every view is a plain projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2002-01-01 00:00:00"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _scope(key: str) -> str:
    return f"CASE WHEN {key} % 5 = 0 THEN 'private' WHEN {key} % 5 = 1 THEN 'group' ELSE 'public' END"


def _rank(key: str) -> str:
    return f"CASE WHEN {key} % 5 = 0 THEN 0 WHEN {key} % 5 = 1 THEN 1 ELSE 2 END"


def _edge_scope(a: str, b: str) -> str:
    low = f"LEAST({_rank(a)}, {_rank(b)})"
    return f"CASE WHEN {low} = 0 THEN 'private' WHEN {low} = 1 THEN 'group' ELSE 'public' END"


def _node(table: str, number: int, key: str, type_: str, name: str, kind: str = "'observation'", created: str = "TIMESTAMP '1995-01-01 00:00:00'") -> str:
    return f"SELECT CAST({number}000000000 + {key} AS BIGINT) AS id, '{type_}' AS type, {name} AS key, {_scope(key)} AS scope, {kind} AS kind, CAST(0.5 AS DOUBLE) + ({key} % 50) / CAST(100.0 AS DOUBLE) AS reliability, CAST({created} AS TIMESTAMP) AS created_at FROM {{{table}}}"


NODES = {
    "region": _node("region", 1, "r_regionkey", "concept", "r_name"),
    "nation": _node("nation", 2, "n_nationkey", "concept", "n_name"),
    "customer": _node("customer", 3, "c_custkey", "user", "c_name"),
    "supplier": _node("supplier", 4, "s_suppkey", "source", "s_name"),
    "part": _node("part", 5, "p_partkey", "entity", "p_name", "CASE WHEN p_partkey % 7 = 0 THEN 'claim' ELSE 'observation' END"),
    "orders": _node("orders", 6, "o_orderkey", "ticket", "'order ' || CAST(o_orderkey AS VARCHAR(20))", "CASE WHEN o_orderkey % 11 = 0 THEN 'coordination' ELSE 'observation' END", "o_orderdate"),
}


def _evidence(table: str, src: tuple[int, str], dst: tuple[int, str], type_: str, provenance: str, origin: str, seq: str, ts: str, reliability: str = "CAST(0.9 AS DOUBLE)", kind: str = "'observation'", reward: str = "CAST(0 AS DOUBLE)", where: str = "") -> str:
    return f"SELECT CAST({src[0]}000000000 + {src[1]} AS BIGINT) AS src, CAST({dst[0]}000000000 + {dst[1]} AS BIGINT) AS dst, '{type_}' AS type, {_edge_scope(src[1], dst[1])} AS scope, {provenance} AS provenance, {origin} AS origin, CAST({seq} AS BIGINT) AS seq, CAST({ts} AS TIMESTAMP) AS ts, CAST(1 AS DOUBLE) AS weight, {reliability} AS reliability, {kind} AS kind, {reward} AS reward FROM {{{table}}} {where}"


_T0 = "TIMESTAMP '1995-01-01 00:00:00'"
EVIDENCE = {
    "supplies": _evidence("lineitem", (4, "l_suppkey"), (5, "l_partkey"), "supplies", "'li:' || CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20))", "'ord:' || CAST(l_orderkey AS VARCHAR(20))", "l_orderkey * 10 + l_linenumber", "l_shipdate", "1 - l_discount", "CASE WHEN l_linestatus = 'O' THEN 'claim' ELSE 'observation' END", "CASE WHEN l_returnflag = 'R' THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"),
    "reacts": _evidence("events", (3, "user_id"), (7, "LENGTH(event_type)"), "reacts", "'ev:' || CAST(event_id % 4000 AS VARCHAR(20))", "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'day:' || CAST(CAST(ts AS DATE) AS VARCHAR(20)) END", "event_id", "ts", "CAST(0.5 AS DOUBLE) + (event_id % 50) / CAST(100.0 AS DOUBLE)", "CASE WHEN event_id % 3 = 0 THEN 'claim' ELSE 'observation' END"),
    "owns": _evidence("orders", (3, "o_custkey"), (6, "o_orderkey"), "owns", "'o:' || CAST(o_orderkey AS VARCHAR(20))", "'o:' || CAST(o_orderkey AS VARCHAR(20))", "o_orderkey", "o_orderdate"),
    "mentions": _evidence("lineitem", (6, "l_orderkey"), (5, "l_partkey"), "mentions", "'m:' || CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20))", "'m:' || CAST(l_orderkey AS VARCHAR(20))", "l_orderkey * 10 + l_linenumber", "l_shipdate", "1 - l_tax"),
    "supplied_by": _evidence("lineitem", (5, "l_partkey"), (4, "l_suppkey"), "supplied_by", "'s:' || CAST(l_orderkey AS VARCHAR(20)) || ':' || CAST(l_linenumber AS VARCHAR(20))", "'s:' || CAST(l_orderkey AS VARCHAR(20))", "l_orderkey * 10 + l_linenumber", "l_shipdate", "1 - l_discount"),
    "customer_of": _evidence("customer", (3, "c_custkey"), (2, "c_nationkey"), "child_of", "'c:' || CAST(c_custkey AS VARCHAR(20))", "'c:' || CAST(c_custkey AS VARCHAR(20))", "c_custkey", _T0),
    "supplier_of": _evidence("supplier", (4, "s_suppkey"), (2, "s_nationkey"), "child_of", "'p:' || CAST(s_suppkey AS VARCHAR(20))", "'p:' || CAST(s_suppkey AS VARCHAR(20))", "s_suppkey", _T0),
    "nation_of": _evidence("nation", (2, "n_nationkey"), (1, "n_regionkey"), "child_of", "'n:' || CAST(n_nationkey AS VARCHAR(20))", "'n:' || CAST(n_nationkey AS VARCHAR(20))", "n_nationkey", _T0),
}

OUTBOX = "SELECT CAST(event_id AS BIGINT) AS seq, event_type AS change, CAST(user_id AS VARCHAR(20)) AS target_key, props AS payload, CAST(event_id AS VARCHAR(20)) AS idem_key FROM {events} WHERE event_id % 97 <> 0 AND event_id % 1000 NOT IN (7, 8, 9)"
#: A claim log on tasks: tokens rise with time, but some writers come late.
CLAIMS = "SELECT CAST(user_id AS BIGINT) AS id, CAST(event_id AS BIGINT) AS seq, CAST(event_id + (event_id * 7919) % 400 AS BIGINT) AS token FROM {events}"
#: Chunks: whole documents as one window each, with the vector of the same number where there is one.
CHUNKS = f"SELECT d.doc_id AS id, d.doc_id AS node_id, CAST(0 AS INTEGER) AS ordinal, d.text AS text, e.embedding AS vec, {_scope('d.doc_id')} AS scope, d.source AS source, d.lang AS lang FROM {{documents}} d LEFT JOIN {{embeddings}} e ON d.doc_id = e.vec_id"
#: Chunks of a node: every vector of a label, as many small memories.
VECTORS = f"SELECT vec_id AS id, CAST(vec_id % 100 AS BIGINT) AS node_id, embedding AS vec, label, CASE WHEN label % 2 = 0 THEN 'concept' ELSE 'entity' END AS type, {_scope('label')} AS scope FROM {{embeddings}}"


def union(parts: dict[str, str], names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(parts[n] for n in names)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})
