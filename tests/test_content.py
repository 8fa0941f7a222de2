from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import scalars
from evidentia.operators import content, enrichment, evaluation, ingest, retrieval, routing


def test_segments():
    assert content.segment("") == [] and content.segment(None) == []
    assert content.segment("# Title only") == []
    assert content.segment("# T\n\none two\n\nthree") == ["# T\n\none two\n\nthree"]
    assert content.segment("# A\n\nx\n\n## B\n\ny") == ["# A\n\nx", "## B\n\ny"]
    body = "# T\n\ntext\n\n```\ncode here\n```\n\n| a | b |\n| 1 | 2 |"
    assert content.segment(body) == ["# T\n\ntext", "# T\n\n```\ncode here\n```", "# T\n\n| a | b |\n| 1 | 2 |"]
    assert content.segment("```\nopen\n# not a heading") == ["```\nopen\n# not a heading"]
    long = " ".join(f"w{i}" for i in range(25))
    assert [len(w.split()) for w in content.segment(long, 10)] == [10, 10, 5]
    assert content.segment("One two. Three four. Five six.", 4) == ["One two.\n\nThree four.", "Five six."]
    assert all(len(w.split()) <= 12 for w in content.segment("# H h\n\n" + "a b c. " * 40, 12))


def test_text_functions(spark):
    df = spark.createDataFrame([("Café", "2026-01-01 00:00:00", "2026-01-01T12:00:00+02:00")], "k string, naive string, aware string")
    r = df.select(scalars.nfc("k").alias("k"), scalars.utc_timestamp(F.col("naive")).alias("n"), F.date_format(scalars.utc_timestamp(F.col("aware")), "HH:mm").alias("a")).first()
    assert (r.k, r.n, r.a) == ("Café", None, "10:00")
    r = spark.range(1).select(scalars.query_terms(F.lit("How do I cook the Mushroom risotto, mushroom?")).alias("t"), scalars.predicate_key(F.lit(" Is  Part-Of! ")).alias("p"), scalars.predicate_key(F.lit("9x")).alias("q"), scalars.delimited(F.lit("docs/storage_engine.md"), "storage").alias("d"), scalars.delimited(F.lit("Award"), "war").alias("e")).first()
    assert (r.t, r.p, r.q, r.d, r.e) == (["cook", "mushroom", "risotto"], "is_part_of", "", True, False)


def test_verdicts(spark):
    texts = ['{"answer": "a", "confidence": 0.5}', 'so {"answer": "a", "confidence": "high"}', '{"answer": 3, "confidence": 1}', "none", '{"answer": "b", "confidence": 1} ok']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.verdict(F.col("t")).alias("v")).collect()
    assert [r.v and (r.v.answer, r.v.confidence) for r in rows] == [("a", 0.5), None, None, None, ("b", 1.0)]


def test_wiki_markup():
    assert scalars.wiki_title("100% (song)") == "100% (song)" and scalars.wiki_title("%21%21%21_(album)#x") == "!!! (album)"
    assert scalars.wiki_links("[[mars|x]] [[File:a.png]] [[earth#moon]]") == ["Mars", "Earth"]
    assert scalars.wiki_plain("{{a{{b}}c}}'''Mars''' is [[planet|a planet]]<ref>x</ref>.\n== Head ==\n[[Category:x]]") == "Mars is a planet.\nHead"


def test_wiki_prose_without_markup():
    plain = scalars.wiki_plain
    assert plain("a<!-- x [[y]] -->b <ref name=q/>c<ref>{{cite|z}}</ref>d") == "ab cd"
    assert plain("before {| class=x\n| cell {{t|}}\n|} after") == "before after"
    assert plain("{{a|{{b|[[c]]}}|d}}[[File:x.png|thumb|a [[link]] here]]end") == "end"
    assert plain("an open {{bracket and ''quotes''") == "an open {{bracket and quotes"
    assert plain("[[a|]] [[b|c]] [[d]] <b>e</b>  f") == "a c d e f"
    assert plain("x\n\n\n\ny\n=== Head ===\nz = 1") == "x\n\ny\nHead\nz = 1"
    assert plain("") == "" and plain("a }} b ]] c |} d") == "a }} b ]] c |} d"
    assert scalars.wiki_links("[[a]] [[b|c]] [[open [[ :d]] [[Help:e]] [[]]") == ["A", "B", ":d"]


def test_mean_vectors_of_hot_and_null_keys(spark):
    rows = [(i % 3 or None if i % 3 else None, [float(i), 1.0]) for i in range(300)] + [(7, None), (8, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "node_id long, vec array<float>").repartition(5)
    want = {}
    for k, v in rows:
        if v:
            want.setdefault(k, []).append(v)
    got = {r.node_id: r.vec for r in content.mean_vectors(df).collect()}
    assert got == {k: [pytest.approx(sum(x) / len(v)) for x in zip(*v, strict=True)] for k, v in want.items()}
    moved = {r.id: r.vec for r in evaluation.centred(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "id long, vec array<float>")).collect()}
    assert moved == {1: [-1.0, -2.0], 2: [1.0, 2.0]}


def test_answer_names_weighs_and_expands(spark):
    nodes = spark.createDataFrame([(1, "concept", "Mars", "public", 0.7), (2, "concept", "Phobos", "public", 0.6), (3, "concept", "Secret", "private", 0.9)], "id long, type string, key string, scope string, reliability double")
    chunks = _chunks(spark, [(1, 1, "Mars is the fourth planet", None)])
    log = "src long, dst long, type string, scope string, provenance string, origin string, seq long, ts timestamp, weight double, reliability double, kind string, reward double"
    now = datetime(2024, 1, 1)
    rows = [(2, 1, "about", "public", "p", None, 1, now, 1.0, 0.8, "observation", 0.0), (1, 2, "has", "public", "q", None, 2, now, 1.0, 0.5, "observation", 0.0), (2, 3, "hides", "private", "r", None, 3, now, 1.0, 0.9, "observation", 0.0)]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = retrieval.answer(chunks, nodes, spark.createDataFrame(rows, log), "fourth planet", ["public"], at)
    assert got.status == "found" and [(r.key, r.confidence) for r in got.memories.collect()] == [("Mars", pytest.approx(0.8))]
    assert [(r.id, r.confidence) for r in got.expanded.collect()] == [(2, pytest.approx(0.5))]
    none = retrieval.answer(chunks, nodes, spark.createDataFrame(rows, log), "zebra", ["public"], at)
    assert none.status == "not_found" and none.memories.count() == none.expanded.count() == 0
    assert retrieval.answer(chunks, nodes, spark.createDataFrame(rows, log), "fourth", ["public"], at, expand=False).expanded.count() == 0


def _chunks(spark, rows):
    return spark.createDataFrame([(i, n, 0, t, v) for i, n, t, v in rows], "id long, node_id long, ordinal int, text string, vec array<float>")


def hot(i):
    return [1.0 if j == i else 0.0 for j in range(8)]


def test_search_contracts(spark):
    nodes = spark.createDataFrame([(1, "concept", "Mars", "public", 0.7), (2, "concept", "Secret", "private", 0.7)], "id long, type string, key string, scope string, reliability double")
    chunks = _chunks(spark, [(1, 1, "Mars is the fourth planet from the sun", hot(1)), (2, 2, "the fourth planet is secret", hot(1))])
    found = retrieval.search(chunks, nodes, "fourth planet", ["public"]).collect()
    assert [(r.node_id, r.spans[0].ordinal) for r in found] == [(1, 0)]
    assert retrieval.search(chunks, nodes, "fourth planet", []).count() == 0
    assert retrieval.search(chunks, nodes, "nothing", ["public"], vector=hot(5)).count() == 0
    assert [r.node_id for r in retrieval.search(chunks, nodes, "nothing", ["public"], vector=hot(1)).collect()] == [1]
    assert retrieval.search(chunks, nodes, "nothing", ["public"], vector=hot(1), floor=1.01).count() == 0


def test_lexical_weight_protects_exact_hits(spark):
    nodes = spark.createDataFrame([(1, "concept", "Magnet", "public", 0.7), (2, "concept", "Lex", "public", 0.7)], "id long, type string, key string, scope string, reliability double")
    chunks = _chunks(spark, [*[(i, 1, f"other words {i}", hot(1)) for i in range(1, 5)], (9, 2, "exact keyword", hot(2))])
    first = lambda w: retrieval.search(chunks, nodes, "keyword", ["public"], vector=hot(1), lex_weight=w, dense_weight=1.0).first().node_id
    assert first(1.0) == 1 and first(5.0) == 2


def test_bands_and_ranks(spark):
    scored = spark.createDataFrame([(0.3, False), (0.4, False), (0.8, True), (0.9, True)], "score double, correct boolean")
    assert routing.derive_band(scored, 0.9).first().handle == 0.8
    assert routing.derive_band(scored.limit(0), 0.9).first().handle == 1.0
    table = spark.createDataFrame([(i, i / 10, i > 3) for i in range(11)], "node_id long, score double, worth_it boolean")
    r = enrichment.pass_summary(table).first()
    assert (r.candidate_count, r.worth_it_count, r.score_p50, r.score_p90, r.score_p99) == (11, 7, 0.5, 0.9, 0.9)
    empty = enrichment.pass_summary(table.limit(0)).first()
    assert empty.candidate_count == 0 and empty.score_p50 is None
    r = spark.range(1).select(evaluation.latency_rank(F.array(F.lit(1), F.lit(2), F.lit(3)), 0.99).alias("p")).first()
    assert r.p == 3


def test_latency_ranks_count_equal_values(spark):
    rows = [("a", float(i % 7)) for i in range(100)] + [("b", 1.0), ("c", None)]
    got = {r.k: r.v for r in evaluation.latency_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", 0.95).collect()}
    assert got == {"a": sorted(v for k, v in rows if k == "a")[95], "b": 1.0}


def test_stated_sets_meet_all_rows_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, hot(i % 8)) for i in range(30)], "id long, vec array<double>")
    key = lambda df: sorted((r.query_id, r.chunk_id, r.cos) for r in df.collect())
    whole = key(evaluation.similarities(rows, rows.filter("id < 10")))
    monkeypatch.setattr(evaluation, "BLOCK", 3)
    assert key(evaluation.similarities(rows, rows.filter("id < 10"))) == whole and len(whole) == 300


def test_index_finds_nine_of_ten_neighbours(spark):
    # directions with neighbours, as embeddings of texts have; on vectors spread evenly only all probes find all
    rnd = np.random.default_rng(3)
    middle = rnd.normal(size=(40, 32))
    vectors = middle[rnd.integers(0, 40, 1500)] + 0.6 * rnd.normal(size=(1500, 32))
    table = spark.createDataFrame([(i, i, 0, "", v.tolist()) for i, v in enumerate(vectors)] + [(-1, -1, 0, "", None)], "id long, node_id long, ordinal int, text string, vec array<double>")
    around = retrieval.centroids(table, 24, sample=600)
    index = retrieval.indexed(table.withColumn("bucket", F.lit("mine")), around).persist()
    assert index.count() == 1500 and len(around) == 24
    hits = 0
    for i in range(0, 1500, 150):
        vector = vectors[i].tolist()
        want = {r.id for r in retrieval.dense(table, vector, 10).collect()}
        hits += len(want & {r.id for r in retrieval.dense_by_index(index, vector, around, 10, 6).collect()})
        if not i:
            assert {r.id for r in retrieval.dense_by_index(index, vector, around, 10, 24).collect()} == want
    index.unpersist()
    assert hits >= 90


def test_ingest_outcomes(spark):
    def e(seq, provenance, at="2026-01-01T00:00:00Z", relations=(), origin=None, scope="public"):
        return ("t", provenance, origin, at, [("file", "/a/f.txt", scope, "f"), ("dir", "/a", "private", "a")], list(relations), seq)

    link = [("/a/f.txt", "/a", "contained_in")]
    from evidentia import schema

    events = spark.createDataFrame([e(1, "p1", relations=link), e(2, "p1", relations=link), e(3, "p2", "2026-01-01 00:00:00"), e(4, "", relations=link), e(5, "p3", relations=[("/a/f.txt", "/a", "Bad Type")]), e(6, "p4", relations=[("/a/f.txt", "/nowhere", "contained_in")])], schema.EVENT)
    got = ingest.ingest(events)
    assert {r.seq: (r.outcome, r.reason) for r in got.outcomes.collect()} == {1: ("written", None), 2: ("duplicate", None), 3: ("quarantined", "bad_timestamp"), 4: ("quarantined", "invalid_provenance"), 5: ("quarantined", "invalid_relation_contract"), 6: ("written", None)}
    assert got.nodes.count() == 2 and got.dead.count() == 3
    assert [(r.src_key, r.dst_key, r.scope) for r in got.evidence.collect()] == [("/a/f.txt", "/a", "private")]


def test_panel(spark):
    calls = []

    def generate(model, prompt):
        calls.append(model)
        return "noise" if model == "j" and calls.count("j") == 1 else '{"answer": "yes", "confidence": 0.9}'

    v = routing.deliberate("q", "g", ["a", "b"], "j", generate, lambda t: [1.0, 0.0])
    assert (v.answer, v.confidence, v.disagreement, calls.count("j")) == ("yes", 0.9, 0.0, 2)
    with pytest.raises(routing.BudgetExceeded):
        routing.ensure("x" * 50, 3)
    with pytest.raises(ValueError):
        routing.deliberate("q", "g", ["a"], "j", lambda m, p: "no", lambda t: [1.0])


def test_answers_are_typed(spark):
    nodes = spark.createDataFrame([(1, "ticket", "order 17", "public", 0.7)], "id long, type string, key string, scope string, reliability double")
    chunks = _chunks(spark, [(1, 1, "order seventeen", hot(1))])
    assert routing.ask(spark, "where are my items", nodes, chunks, "tier_tools").status == "not_found"
    assert routing.ask(spark, "order", nodes, chunks, "tier_tools").status == "found"
    assert routing.ask(spark, "zebra", nodes, chunks, "tier_tools").status == "not_found"
    failed = routing.ask(spark, "order", nodes, chunks, "escalate", escalate=lambda q, g: (_ for _ in ()).throw(ValueError("x")))
    assert (failed.status, failed.confidence) == ("error", 0.0)


def test_postings_agree_with_the_scan(spark):
    chunks = _chunks(spark, [(i, i, t, None) for i, t in enumerate(["mars is red", "red red mars", "only mars", "red planet mars mars", ""])])
    index = retrieval.postings(chunks)
    key = lambda df: sorted((r.rnk, r.id, round(r.score, 9)) for r in df.collect())
    assert key(retrieval.lexical_by_postings(index, chunks, "red mars", 2)) == key(retrieval.lexical(chunks, "red mars", 2))
    assert retrieval.lexical_by_postings(index, chunks, "", 2).count() == 0


def test_enrichment_pass_reaches_a_fix_point(spark):
    content_ = spark.createDataFrame([(i, f"body {i}") for i in range(8)], "node_id long, body string")
    nodes = spark.createDataFrame([(i, "claim" if i == 7 else "observation", None) for i in range(8)], "id long, kind string, lease_until timestamp")
    marks = spark.createDataFrame([], "node_id long, content_hash string, policy_version int, model string, state string, generation int")
    none = spark.createDataFrame([], "node long, degree long"), spark.createDataFrame([], "node long, confidence double")
    answer = lambda texts: ['{"claims": [{"s": "Mars", "p": "is part of", "o": "Space"}]}' for _ in texts]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = enrichment.run_pass(content_, nodes, marks, *none, answer, "m", 1, 1, at)
    assert (got["summary"].first().candidate_count, got["decisions"].count(), got["claims"].count(), got["watermarks"].count()) == (7, 5, 5, 5)
    again = enrichment.run_pass(content_, nodes, got["watermarks"], *none, answer, "m", 1, 2, at)
    assert again["decisions"].count() == 2 and again["watermarks"].count() == 7
    last = enrichment.run_pass(content_, nodes, again["watermarks"], *none, answer, "m", 1, 3, at)
    assert last["decisions"].count() == 0


def test_band_from_labelled_messages(spark):
    band, scored = routing.evaluated(spark, lambda texts: [content.hash_embedding(t) for t in texts])
    assert scored.count() == 10 and 0 < band.first().handle <= 1
