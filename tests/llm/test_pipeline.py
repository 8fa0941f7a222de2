import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] <= before and counts[1] < counts[0] and counts[2] == counts[1]


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, DATA)
    whole = entry.queries()["pipeline"](spark, DATA)
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


@pytest.mark.parametrize("name", ["op3_cross_entropy_difference", "op8_sketches", "op10_byte_repeats"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in entry.queries()[name](spark, DATA).select(*names).collect()) == want


def test_mixing_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op1_mix"]).fetchdf()
    got = entry.queries()["op1_mix"](spark, DATA).toPandas()
    key = lambda df: sorted(zip(df.doc_id, df.replica, df.text, strict=True))
    assert key(got) == key(want)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, labels=(), clash=()):
    path = str(tmp_path)
    df = spark.createDataFrame(rows, DOCS)
    for name in clash:
        df = df.withColumn(name, F.lit("mine"))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_of_odd_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a text of its own that stands alone here", "en", "s", 40), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a row without an id", "en", "t", 19), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (4, "another text of the same id, quite another one", None, "t", 46), (5, long + " more", "en", "t", len(long) + 5)]
    clash = ("replica", "row", "_gone", "_id", "_block", "mix_u", "mix_key", "digest", "score", "cell", "label")
    path = folder(spark, tmp_path, rows, clash=clash)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, path)
        kept = docs.collect()
        assert [c for c in docs.columns if c != "replica"] == [*DOCS.replace(" long", "").replace(" string", "").split(", "), *clash[1:]], name
        assert all(r[c] == "mine" for r in kept for c in clash[1:]), name
        if name == "simhash":
            # null and empty texts are one class; alike rows go down to one, and the near copy with the larger id goes
            assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept) == sorted([(1, 40), (2, 0), (0, 19), (4, len(long)), (4, 46)])
    out = p.run(spark, path)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r.doc_id for r in out.collect()} <= {None, 1, 2, 4}


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert p.run(spark, folder(spark, tmp_path, [])).count() == 0


def test_pipeline_drops_what_its_labels_call_toxic(spark, tmp_path):
    rows = [(i, f"{'you vile rotten fools' if i % 2 else 'calm clear weather today'} number{i} and more{i * 7} of{i * 11}", "en", "s", 50) for i in range(1, 120)]
    path = folder(spark, tmp_path, rows, [(i, 1, i % 2) for i in range(1, 120)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert {r.doc_id % 2 for r in p.STAGES[0][1](spark, docs, path).collect()} == {0}
