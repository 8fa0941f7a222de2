import hashlib
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from evidentia.llm import byte_repeats as m


def brute(rows, k=50):
    first = {}
    coded = [(d if d is not None else -(1 << 63), (t or "").encode()) for d, t in rows]
    for d, b in coded:
        for i in range(len(b) - k + 1):
            first[b[i : i + k]] = min(first.get(b[i : i + k], d), d)
    out = {}
    for d, b in coded:
        covered = [False] * len(b)
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < d:
                covered[i : i + k] = [True] * k
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out[None if d == -(1 << 63) else d] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows(seed, n=50):
    rnd = random.Random(seed)
    word = lambda a, b: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(a, b)))
    pool = [word(30, 200) for _ in range(6)]
    made = []
    for d in range(n):
        parts = [rnd.choice([lambda: rnd.choice(pool), lambda: word(1, 90), lambda: "ab" * rnd.randint(1, 60)])() for _ in range(rnd.randint(0, 6))]
        made.append((d * 7 % n, "".join(parts) if d % 17 else None))
    return made


def got(spark, data, block, k=50):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_removed", F.lit("mine"))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in m.remove_repeats(df, k, block).collect()}


def test_equals_brute_force_in_one_block_and_many(spark):
    for seed, block in ((1, 1 << 20), (2, 700)):
        data = rows(seed)
        assert got(spark, data, block) == brute(data)


@pytest.mark.parametrize("k", [24, 31, 64, 100, 200])
def test_passages_of_other_lengths_equal_brute_force(spark, k):
    data = rows(k, 30)
    assert got(spark, data, 900, k) == brute(data, k)


def test_only_supported_lengths_are_taken(spark):
    for k in (0, 23, 201):
        with pytest.raises(ValueError, match="24 to 200"):
            m.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), k)


def test_hot_phrases_equal_brute_force():
    # in one process, so that the bounds can be lowered: the same functions that the plan runs
    rnd = random.Random(11)
    phrase = "a phrase that very many documents hold, "
    data = [(i, "".join(rnd.choice([phrase, phrase, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(1, 30)))]) for _ in range(6))) for i in range(60)]
    for hot, counted in ((3, 1), (10, 2), (1 << 40, 1)):
        old = m.HOT, m._COUNTED
        m.HOT, m._COUNTED = hot, counted
        try:
            parts = 4
            blocks = [pa.table({"_id": [d for d, _ in data[i::3]], "text": [t for _, t in data[i::3]], "doc_id": [d for d, _ in data[i::3]], "_block": [i] * len(data[i::3])}) for i in range(3)]
            by = lambda tables, c: [t for t in (pa.concat_tables(tables).filter(pc.equal(pa.concat_tables(tables).column(c), p)) for p in range(parts)) if len(t)]  # noqa: E731, B023
            bits = [m._repeated_keys(t) for t in by([m._find_keys(50, parts)(b) for b in blocks], "part")]
            of = lambda tables, i: pa.concat_tables(tables).filter(pc.equal(pa.concat_tables(tables).column("block"), i))
            sent = [m._send_strings(50, parts)(b, of(bits, i)) for i, b in enumerate(blocks)]
            masks = [m._index_strings(50)(t) for t in by(sent, "part")]
            found = {}
            for i, b in enumerate(blocks):
                both = pa.concat_tables([of(x, i).append_column("kind", pa.array([kind] * len(of(x, i)))) for kind, x in enumerate((bits, masks))])
                found |= {r["doc_id"]: tuple(r.values())[1:] for r in m._apply(50, parts)(b, both).to_pylist()}
        finally:
            m.HOT, m._COUNTED = old
        assert found == brute(data)


def test_null_id_is_least_and_equal_ids_spare_each_other(spark):
    text = "x" + "repeat this passage of text, please. " * 3
    data = [(None, text), (4, text), (9, text[:49]), (9, "")]
    found = got(spark, [data[0], data[1]], 1 << 20)
    assert found[None][1] == 0 and found[4][1] == len(text)
    df = spark.createDataFrame([(4, text), (4, text)], "doc_id long, text string")
    assert [r.n_removed for r in m.remove_repeats(df).collect()] == [0, 0]


def test_empty_table(spark):
    assert m.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cleaned_keeps_columns_and_code_points(spark):
    text = "é" * 60 + " tail one"
    data = [(1, text, "a", 69, "z"), (2, "ü" + text[:40] + "#two", "b", 45, None), (3, None, None, None, "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, kind string")
    for name in ("_id", "_block", "row", "_text"):
        df = df.withColumn(name, F.lit("mine"))
    cut = m.cleaned(df)
    out = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == df.columns and all(r._id == r._block == r.row == "mine" for r in out.values())
    assert out[1].text == text and out[3].text == "" and out[2].kind is None and out[2].source == "b"
    assert out[2].text.startswith("ü") and out[2].text.endswith("#two") and out[2].n_chars == len(out[2].text) < 45


def test_column_wise_index_orders_suffixes():
    rnd = random.Random(3)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(8, 14))).encode() for _ in range(40)]
    owner, common = m.collection_bwt(strings, 8)
    order = [(strings[o // m._STARTS][o % m._STARTS :]) for o in owner if o >= 0]
    groups = {}
    at = 0
    for o, c in zip(owner, common, strict=True):
        at += c < 8
        if o >= 0:
            groups.setdefault(at, set()).add(strings[o // m._STARTS][o % m._STARTS :][:8])
    assert [s[:8] for s in order] == sorted(s[:8] for s in order)
    assert all(len(g) == 1 for g in groups.values()) and len({*map(frozenset, groups.values())}) == len(groups)
