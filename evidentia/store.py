"""A warehouse of the engine's tables: appended logs and whole snapshots as Parquet, with schema versions.

A log is appended to; a snapshot is written whole under the next number, and readers take the greatest number that
was written to its end. So a write that fails, or an executor that is lost, leaves the snapshot before as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schema

_VERSION = "version int, tables array<string>, seq long"
_NODE = T.StructType([*schema.NODE.fields, T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("embed_model", T.StringType())])
_CONTENT = "node_id long, body string, body_hash string, segmenter string, embedded_hash string"
_STAMPS = "namespace string, model string, dim int, status string, seq long"

#: Of each schema version, the tables that it adds.
MIGRATIONS: tuple[tuple[int, dict[str, T.StructType | str]], ...] = (
    (1, {"node": _NODE, "evidence": T.StructType([*schema.EVIDENCE.fields, T.StructField("reward", T.DoubleType()), T.StructField("moved", T.BooleanType())])}),
    (2, {"outbox": schema.OUTBOX, "dead_letter": schema.DEAD_LETTER, "stagnant": schema.STAGNANT}),
    (3, {"content": _CONTENT, "chunk": schema.CHUNK}),
    (4, {"node_alias": "type string, alias_key string, canonical_key string, seq long", "schema_meta": _STAMPS}),
    (5, {"claim": "id long, seq long, op string, holder string, token long, observed long, until long", "audit": "kind string, payload string, seq long"}),
)


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._kinds = {name: kind for _, tables in MIGRATIONS for name, kind in tables.items()}

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> list[int]:
        """The snapshots of a table that were written to their end."""
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return []
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("n=") and fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])]
        return sorted(done)

    def read(self, name: str) -> DataFrame:
        """The latest snapshot and what was appended to it since; an empty table of the known schema where nothing was written."""
        numbers = self._numbers(name)
        if not numbers:
            return self.spark.createDataFrame([], self._kinds[name])
        return self.spark.read.schema(self.spark.createDataFrame([], self._kinds[name]).schema if name in self._kinds else None).parquet(f"{self.path}/{name}/n={numbers[-1]}")

    def append(self, name: str, rows: DataFrame) -> None:
        number = (self._numbers(name) or [0])[-1]
        self._typed(name, rows).write.mode("append").parquet(f"{self.path}/{name}/n={number}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """A new snapshot; rows may read the one before."""
        number = (self._numbers(name) or [0])[-1] + 1
        self._typed(name, rows).write.mode("overwrite").parquet(f"{self.path}/{name}/n={number}")

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in self._kinds:
            return rows
        kind = self.spark.createDataFrame([], self._kinds[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def version(self) -> int:
        if not self._numbers("schema_version"):
            return 0
        log = self.spark.read.parquet(f"{self.path}/schema_version/n={self._numbers('schema_version')[-1]}")
        return log.agg(F.max_by("version", "seq")).first()[0]

    def _stamp(self, version: int) -> None:
        seq = 0 if not self._numbers("schema_version") else self.spark.read.parquet(f"{self.path}/schema_version/n=0").agg(F.max("seq")).first()[0] + 1
        names = [n for v, tables in MIGRATIONS if v <= version for n in tables]
        self.append("schema_version", self.spark.createDataFrame([(version, names, seq)], _VERSION).coalesce(1))

    def migrate(self, to: int = schema.SCHEMA_VERSION) -> list[int]:
        """Adds the tables of the versions up to ``to`` that aren't there; the versions that were applied. Again, nothing is done."""
        applied = [v for v, _ in MIGRATIONS if self.version() < v <= to]
        for v, tables in MIGRATIONS:
            if v in applied:
                for name in tables:
                    if not self._numbers(name):
                        self.append(name, self.spark.createDataFrame([], self._kinds[name]))
        if applied:
            self._stamp(applied[-1])
        return applied

    def rollback(self, to: int) -> list[int]:
        """Drops the tables of the versions above ``to``, the latest first; the versions that were undone."""
        undone = [v for v, _ in reversed(MIGRATIONS) if to < v <= self.version()]
        for v, tables in reversed(MIGRATIONS):
            if v in undone:
                for name in tables:
                    self.drop(name)
        if undone:
            self._stamp(to)
        return undone
