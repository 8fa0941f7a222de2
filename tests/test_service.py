"""The store, the facades and the loops over them."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia import cli, ports, service
from evidentia.operators import changes, content, embedding, evidence, resolution
from evidentia.store import Store

NODE = "id long, type string, key string, scope string, kind string, reliability double, created_at timestamp"
LOG = "src long, dst long, type string, scope string, provenance string, origin string, seq long, ts timestamp, weight double, reliability double, kind string"
NOW = datetime(2024, 1, 1)


def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


class Hashes(ports.Model):
    def embed(self, texts):
        return [content.hash_embedding(t) for t in texts]

    def complete(self, request):
        return {}


class Down(Hashes):
    def embed(self, texts):
        raise ConnectionError


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    assert made.version() == 0 and made.migrate() == [1, 2, 3, 4, 5] and made.migrate() == []
    return made


@pytest.fixture
def filled(spark, store):
    graph = service.Graph(store)
    nodes = [(1, "concept", "Mars", "public", "observation", 0.7, NOW), (2, "concept", "Phobos", "public", "observation", 0.6, NOW), (3, "ticket", "order 17 of ann", "group", "observation", 0.9, NOW), (4, "bad type", "x", "public", "observation", 0.5, NOW)]
    assert graph.add_nodes(spark.createDataFrame(nodes, NODE)) == 3
    events = [(2, 1, "about", "public", "p", "A", 1, NOW, 1.0, 0.8, "observation"), (2, 1, "about", "public", "q", "A", 2, NOW, 1.0, 0.8, "observation"), (1, 2, "has", "public", "r", None, 3, NOW, 1.0, 0.5, "observation"), (1, 9, "has", "public", "s", None, 4, NOW, 1.0, 0.5, "observation")]
    assert graph.add_edges(spark.createDataFrame(events, LOG)) == 3
    graph.put_bodies(spark.createDataFrame([(1, "Mars is the fourth planet", 1), (2, "Phobos is a moon", 2), (2, " ", 3)], "node_id long, body string, seq long"))
    return store


def test_migrations_add_and_drop_tables(store):
    assert store.read("chunk").count() == 0 and store.version() == 5
    assert store.rollback(2) == [5, 4, 3] and store.version() == 2
    assert store.migrate() == [3, 4, 5] and store.version() == 5


def test_snapshots_replace_and_logs_grow(spark, store):
    row = lambda n: spark.createDataFrame([(n, None, None, None)], "node_id long, body string, body_hash string, embedded_hash string")
    store.replace("content", row(1))
    store.append("content", row(2))
    assert {r.node_id for r in store.read("content").collect()} == {1, 2}
    store.replace("content", store.read("content").filter("node_id = 2"))
    assert {r.node_id for r in store.read("content").collect()} == {2}


def test_changes_are_told_once_and_in_order(filled):
    rows = filled.read("outbox").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.change, r.idem_key.split(":")[0]) for r in rows] == [("node_added", "node")] * 3 + [("edge_reinforced", "edge")] * 2 + [("content_added", "content")] * 2
    assert {r.reason for r in filled.read("dead_letter").collect()} == {"invalid_type_format", "unknown_endpoint"}


def test_merges_are_told(spark):
    asked = spark.createDataFrame([(1, 2, "merged", 1), (3, 4, "refused_cross_scope", 2), (5, 5, "noop_same", 3)], "into_id long, alias_id long, outcome string, seq long")
    got = {r.change: (r.idem_key, json.loads(r.payload)) for r in changes.merges(asked).collect()}
    assert got == {"node_merged": ("merge:2->1", {"into": 1, "from": 2}), "merge_refused": ("merge_refused:4->3", {"into": 3, "from": 4, "reason": "cross_scope"})}


def test_reinforcement_is_told_with_its_count(spark):
    rows = [(1, 2, "t", "public", p, o, i, NOW, 1.0, 0.5, "observation") for i, (p, o) in enumerate([("a", "X"), ("b", "X"), ("c", "Y"), ("a", "Z")])]
    got = changes.edge_reinforced(spark.createDataFrame(rows, LOG)).orderBy("order").collect()
    assert [json.loads(r.payload)["seen_count"] for r in got] == [1, 2]


def test_bodies_are_embedded_once(spark, filled):
    worker = service.EmbedWorker(filled, Hashes())
    told = filled.read("outbox").filter("change = 'content_added'")
    worker(told)
    chunks = filled.read("chunk").collect()
    assert {(r.node_id, r.ordinal, r.text) for r in chunks} == {(1, 0, "Mars is the fourth planet"), (2, 0, "Phobos is a moon")} and all(len(r.vec) == 64 for r in chunks)
    assert all(r.embedded_hash == r.body_hash for r in filled.read("content").collect())
    mars = filled.read("node").filter("id = 1").first()
    assert mars.vec == pytest.approx(content.hash_embedding("Mars is the fourth planet")) and mars.embed_model == "hash-64"
    assert worker.handle({}) == {"unchanged": 2}
    wanted = spark.createDataFrame([(1,), (3,)], "node_id long")
    assert worker.handle({"wanted": wanted}) == {"unchanged": 1, "no_content": 1}
    assert worker.handle({"wanted": wanted, "force": True}) == {"embedded": 1, "no_content": 1}
    assert filled.read("chunk").count() == 2
    service.Graph(filled).put_bodies(spark.createDataFrame([(2, "Phobos turns", 9)], "node_id long, body string, seq long"))
    assert worker.handle({}) == {"embedded": 1, "unchanged": 1}
    assert {r.text for r in filled.read("chunk").collect()} == {"Mars is the fourth planet", "Phobos turns"}
    assert embedding.without_chunks(spark.createDataFrame([(1,), (7,)], "node_id long"), filled.read("chunk")).count() == 1
    assert [r.id for r in embedding.with_chunks(filled.read("node"), filled.read("chunk")).orderBy("id").collect()] == [1, 2]


def test_a_failed_embedder_leaves_everything_as_it_was(filled):
    with pytest.raises(Exception, match="ConnectionError"):
        service.EmbedWorker(filled, Down()).handle({})
    assert filled.read("chunk").count() == 0 and all(r.embedded_hash is None for r in filled.read("content").collect())


def test_segmenters_can_be_replaced(spark):
    bodies = spark.createDataFrame([(1, "a|b", "h", None)], "node_id long, body string, body_hash string, embedded_hash string")
    chunks = spark.createDataFrame([], "id long, node_id long, ordinal int, text string, vec array<float>, token_count int")
    done = embedding.embed_bodies(bodies, chunks, segmenter=lambda b, n: b.split("|"))
    assert [(r.ordinal, r.text) for r in done.chunks.orderBy("ordinal").collect()] == [(0, "a"), (1, "b")]
    spark.udtf.register("windows", content.segmenter_table(budget=2))
    spark.createDataFrame([("one two three",)], "body string").createOrReplaceTempView("some_bodies")
    assert [(r.ordinal, r.text) for r in spark.sql("SELECT w.ordinal, w.text FROM some_bodies, LATERAL windows(body) w").collect()] == [(0, "one two"), (1, "three")]


def test_entity_keys_are_embedded_in_batches(spark):
    rows = [(i, "entity" if i else "concept", f"key {i}", None) for i in range(5)]
    nodes = spark.createDataFrame(rows, "id long, type string, key string, vec array<float>")
    first = embedding.embed_keys(nodes, limit=3)
    assert {r.id for r in first.collect()} == {1, 2, 3}
    nodes = embedding.with_vectors(nodes, first)
    assert {r.id for r in embedding.unembedded(nodes).collect()} == {4}
    nodes = embedding.with_vectors(nodes, embedding.embed_keys(nodes))
    assert embedding.embed_keys(nodes).count() == 0 and nodes.filter("vec is not null").count() == 4
    with pytest.raises(Exception, match="another number"):
        embedding.embed_keys(spark.createDataFrame(rows, "id long, type string, key string, vec array<float>"), lambda texts: [[1.0]]).collect()


def test_doubt_is_a_no(spark):
    replies = {"a": '{"same": true}', "b": '{"same": "true"}', "c": "yes", "d": '{"same": false}', "e": 'so: {"same": true} indeed', "g": "[true]"}

    def generate(model, prompt):
        key = prompt.split("First: ")[1][0]
        if key == "f":
            raise ConnectionError
        return replies[key]

    pairs = spark.createDataFrame([(k, "z") for k in "abcdefg"], "left_key string, right_key string")
    assert {r.left_key for r in resolution.confirmed_by(pairs, generate, "m").filter("same").collect()} == {"a", "e"}


def test_namespaces_keep_their_latest_stamp(spark):
    log = embedding.stamp(spark, "b", 64).union(embedding.stamp(spark, "a", 8, "old", 1)).union(embedding.stamp(spark, "a", 16, "new", 2))
    assert [tuple(r) for r in embedding.namespaces(log).select("namespace", "model", "dim", "status").collect()] == [("a", "new", 16, "pending"), ("b", "b", 64, "pending")]


def test_core_asks_routes_and_searches(filled):
    service.EmbedWorker(filled, Hashes()).handle({})
    core = service.Core(filled, connectors=["wiki"], panel=["m1", "m2"])
    assert core.route("hello there")[0] == "tier0" and core.route("find mars")[0] == "tier_tools" and core.route("why so")[0] == "escalate"
    assert core.ask("hello there").status == "found" and core.ask("find my order").status == "not_found"
    found = core.ask("find mars")
    assert (found.status, found.tier, [c["ref"] for c in found.citations]) == ("found", "tier_tools", ["Mars"])
    assert core.ask("find my order", ["group"], "ann").citations[0]["ref"] == "order 17 of ann"
    assert [h["key"] for h in core.search("fourth planet")] == ["Mars"] and core.search("fourth planet", ["private"]) == []
    state = core.status()
    assert (state["nodes"], state["edges"], state["capabilities"]) == (3, 2, ["wiki", "panel:2-models"])
    assert [(n["namespace"], n["dim"], n["status"]) for n in state["namespaces"]] == [("hash-64", 64, "pending")]
    whole = core.answer("fourth planet", as_of=at())
    assert [(r.key, r.confidence) for r in whole.memories.collect()] == [("Mars", pytest.approx(0.8))] and [r.id for r in whole.expanded.collect()] == [2]


def test_core_routes_by_its_model_and_does_without(filled):
    core = service.Core(filled, Hashes(), handle=0.3)
    tier, intent, score = core.route("hello hi hey")
    assert (tier, intent) == ("tier0", "greeting") and score > 0.3
    assert service.Core(filled, Down()).route("hello")[0] == "tier0"
    own = service.Core(filled, retriever=lambda q, scopes, limit, owner: filled.spark.createDataFrame([(5, "file", f"{q}/{owner}", 1.0)], "id long, type string, key string, score double"))
    assert own.search("x")[0]["key"] == "x/None" and own.ask("find x").citations[0]["ref"] == "find x/None" and own.ask("find my x", viewer="ann").citations[0]["ref"] == "find my x/ann"

    class Loud(ports.Skill):
        def render(self, answer, context):
            return answer["answer"].upper()

    assert service.Core(filled, skill=Loud()).ask("hello").answer.isupper()


def test_graph_claims_walks_and_collects(spark, filled):
    graph = service.Graph(filled)
    assert [(r.id, r.depth) for r in graph.traverse(2, 2, ["public"], at()).collect()] == [(1, 1)]
    assert graph.traverse(2, 2, [], at()).count() == 0
    log = spark.createDataFrame([(1, 1, "claim", "w", 4, None, 10), (1, 2, "renew", "w", 4, 10, 20)], "id long, seq long, op string, holder string, token long, observed long, until long")
    assert graph.claim(log).first().lease_until == 20 and graph.read_fences().first().fence == 4
    gone = graph.collect_garbage(F.lit("2030-01-01 00:00:00").cast("timestamp")).first()
    assert (gone["edges"], gone["reaped"], gone["kept"]) == (2, 2, 0) and filled.read("evidence").count() == 0


def test_resolution_is_audited_and_told(spark, store):
    graph = service.Graph(store)
    rows = [(1, "entity", "big red planet", "public", "observation", 0.5, NOW), (2, "entity", "red planet", "public", "observation", 0.5, NOW), (3, "entity", "blue sea", "public", "observation", 0.5, NOW)]
    graph.add_nodes(spark.createDataFrame(rows, NODE))
    graph.add_edges(spark.createDataFrame([(2, 3, "near", "public", "p", None, 1, NOW, 1.0, 0.5, "observation"), (1, 3, "near", "public", "q", None, 2, NOW, 1.0, 0.9, "observation")], LOG))
    store.replace("node", embedding.with_vectors(store.read("node"), embedding.embed_keys(store.read("node"))))
    degree = spark.createDataFrame([(1, 5)], "node long, degree long")
    done = graph.resolve(degree, F.lit(True), cosine=0.7, jaccard=0.5).first()
    assert (done.proposed, done.confirmed, done.merged) == (1, 1, 1)
    assert sorted(r.id for r in store.read("node").collect()) == [1, 3]
    edge = evidence.fold_edges(store.read("evidence").drop("reward")).collect()
    assert [(e.src, e.dst, e.seen_count, e.reliability) for e in edge] == [(1, 3, 2, 0.9)]
    assert [r.kind for r in store.read("audit").orderBy("seq").collect()] == ["entity_resolution", "entity_resolution_pass"]
    assert store.read("outbox").filter("change = 'node_merged'").first().idem_key == "merge:2->1"


def test_models_answer_whole_batches_within_a_ceiling():
    class Echo(Hashes):
        def complete(self, request):
            return {"text": f"{request['model']}:{request['prompt']}"}

    models = service.Models(Echo(), ceiling=4)
    assert models.embed(["a", "b"])["dim"] == 64 and models.embed([]) == {"vectors": [], "namespace": "hash-64", "dim": 0}
    assert models.generate("m", "short") == "m:short"
    with pytest.raises(ValueError, match="exceed"):
        models.generate("m", "x" * 40)

    class Short(Hashes):
        def embed(self, texts):
            return [[1.0]]

    with pytest.raises(ValueError, match="other vectors"):
        service.Models(Short()).embed(["a", "b"])


def test_timer_goes_on_after_a_failure():
    calls = []

    def job():
        calls.append(1)
        raise ValueError("once more")

    timer = service.Timer(0.01, job).start()
    for _ in range(300):
        if timer.runs >= 2:
            break
        time.sleep(0.01)
    timer.stop()
    assert len(calls) >= 2 and timer.errors


def test_command_line(spark, filled, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda name: spark)
    service.EmbedWorker(filled).handle({})
    run = lambda *args: (cli.main(["--warehouse", filled.path, *args]), capsys.readouterr().out)
    assert json.loads(run("status")[1])["nodes"] == 3
    assert json.loads(run("search", "fourth planet")[1])["key"] == "Mars"
    code, out = run("ask", "find mars")
    assert code == 0 and json.loads(out)["tier"] == "tier_tools"
    assert json.loads(run("ask", "hello")[1])["tier"] == "tier0"
    assert json.loads(run("migrate")[1]) == []
