import __spark_entry__ as entry
import pytest

DATA = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["node", "confidence"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, name):
    import duckdb

    from evidentia.plans.views import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def test_hits_of_all_parts_and_orders(spark):
    from evidentia.plans.registry import Tables

    t = Tables(spark, DATA)
    ids = [r.id for r in t.nodes("part", "orders").select("id").collect()]
    assert max(ids) >= 6_000_000_000
    got = {r.id for r in entry.queries()["hit_union"](spark, DATA).collect()}
    assert len(got) == 20 and any(i >= 6_000_000_000 for i in got)


def _alike(spark, folder, name, **tables):
    """The query's and its SQL's rows over tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = entry.queries()[name](spark, str(folder)).toPandas(), con.execute(entry.oracle_sql()[name]).fetchdf()
    return (sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None))) for df in (got, want))


def test_titles_of_letters_without_a_plain_capital(spark, tmp_path):
    import pandas as pd

    texts = ["ßheit, | x", "ŉ b", "ﬁne day", "ᾳ b", "ǆ b", "a\x0bb c", "a__b c", " a b", "　a b c", "", "x", "100% #1", "_ _"]
    got, want = _alike(spark, tmp_path, "canonical_titles", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert got == want


def test_customers_in_few_jobs(spark, tmp_path):
    import pandas as pd

    keys = [k for k in range(1, 60_000) if k % 7000 > 2]
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few-jobs", "sync")
    try:
        got, want = _alike(spark, tmp_path, "sync_report", customer=pd.DataFrame({"c_custkey": keys}))
        jobs = before.getJobIdsForGroup("few-jobs")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 60 pages
    assert got == want and len(jobs) < 60


@pytest.mark.parametrize("name", ["er_jaccard", "er_survivor"])
def test_pairs_of_few_words_are_products_of_tiles(spark, tmp_path, monkeypatch, name):
    import numpy as np
    import pandas as pd
    from evidentia.operators import resolution

    asked, plain = [], resolution.scored_pairs
    monkeypatch.setattr(resolution, "TILE", 100)
    monkeypatch.setattr(resolution, "STRIP", 16)
    monkeypatch.setattr(resolution, "scored_pairs", lambda *a: asked.append(a) or plain(*a))
    chance = np.random.default_rng(5)
    rows = pd.DataFrame({"vec_id": range(400), "label": chance.integers(0, 30, 400).astype("int32"), "embedding": list(chance.normal(size=(400, 8)).astype("float32"))})
    got, want = _alike(spark, tmp_path, name, embeddings=rows)
    assert got == want and len(got) > 1000 and asked


def test_pairs_by_rare_words_and_by_tiles_are_the_same(spark, monkeypatch):
    from evidentia.operators import resolution

    keys = ["red car", "Red  car!", "blue car", "", None, "a", "red car two", "blue van", "red"]
    df = spark.createDataFrame([(i, "t", "public", k, [1.0, float(i % 3)] if i != 8 else None) for i, k in enumerate(keys * 3)], "id long, type string, scope string, key string, vec array<double>")
    found = []
    for cheaper in (0, 1e9):
        monkeypatch.setattr(resolution, "CHEAPER", cheaper)
        found.append(sorted((r.left_id, r.right_id, r.left_key, r.right_key, round(r.cosine, 9), r.lex) for r in resolution.propose(df, None, 0.3, 0.5, None).collect()))
    assert found[0] == found[1] and len(found[0]) > 20
