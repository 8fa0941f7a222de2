"""Numeric contracts of the graph operators."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.operators import confidence, coordination, evidence, lifecycle, resolution, traverse

NOW = datetime(2024, 1, 1)


def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


EDGE = "src long, dst long, type string, scope string, weight double, reliability double, kind string, seen_count int, last_seen timestamp, reward double"
LOG = "src long, dst long, type string, scope string, provenance string, origin string, seq long, ts timestamp, weight double, reliability double, kind string"


def edge(src, dst, reliability=0.9, scope="public", seen=1, age=0, reward=0.0, type_="mentions", kind="observation"):
    return (src, dst, type_, scope, 1.0, reliability, kind, seen, NOW - timedelta(days=age), reward)


def event(src, dst, seq, provenance, origin=None, reliability=0.8, kind="observation", type_="mentions", scope="public"):
    return (src, dst, type_, scope, provenance, origin, seq, NOW, 1.0, reliability, kind)


def corroborated(spark, events, nodes=None, scopes=None):
    log = spark.createDataFrame(events, LOG)
    found = confidence.corroboration(evidence.fold_edges(log), evidence.provenances(log), at(), nodes, scopes)
    return {r.node: r.confidence for r in found.collect()}


def test_reinforcement_counts_origins(spark):
    log = spark.createDataFrame([event(1, 2, 1, "ev-1", "doc-A"), event(1, 2, 2, "ev-2", "doc-A"), event(1, 2, 3, "ev-3", "doc-B"), event(1, 2, 4, "ev-3", "doc-C")], LOG)
    assert [r.outcome for r in evidence.classified(log).orderBy("seq").collect()] == ["new_origin", "existing_origin", "new_origin", "duplicate"]
    # a duplicate's origin is never recorded
    assert evidence.fold_edges(log).first().seen_count == 2
    log = spark.createDataFrame([event(1, 2, 1, "p1", "A"), event(1, 2, 2, "p1", "B"), event(1, 2, 3, "p2", "B")], LOG)
    assert [r.outcome for r in evidence.classified(log).orderBy("seq").collect()] == ["new_origin", "duplicate", "new_origin"]


def test_fold_matches_sequential_rules(spark):
    rnd = random.Random(4)
    events = [(rnd.randint(1, 3), rnd.randint(4, 6), "mentions", "public", f"p{rnd.randint(0, 60)}", rnd.choice([None, f"o{rnd.randint(0, 9)}"]), i, NOW + timedelta(hours=i), 1.0, rnd.random(), "observation") for i in range(400)]
    state = {}
    for e in events:
        key = e[:4]
        s = state.setdefault(key, {"rel": e[9], "seen": set(), "last": None, "from": set()})
        if e[4] in s["from"]:
            continue
        s["from"].add(e[4])
        who = e[5] or e[4]
        if who not in s["seen"]:
            s["seen"].add(who)
            s["last"] = e[7]
    got = {(r.src, r.dst, r.type, r.scope): (r.reliability, r.seen_count, r.last_seen) for r in evidence.fold_edges(spark.createDataFrame(events, LOG)).collect()}
    assert got == {k: (s["rel"], len(s["seen"]), s["last"]) for k, s in state.items()}


def test_corroboration_contracts(spark):
    assert corroborated(spark, [event(1, 9, 1, "a"), event(2, 9, 2, "b")])[9] == pytest.approx(0.96)
    assert corroborated(spark, [event(i, 9, i, f"p{i}", kind="claim") for i in (1, 2, 3)])[9] == pytest.approx(0.8)
    assert corroborated(spark, [event(1, 9, 1, "a", "doc"), event(2, 9, 2, "b", "doc")])[9] == pytest.approx(0.8)
    assert corroborated(spark, [event(1, 9, 1, "a", type_="links_to"), event(2, 9, 2, "b", type_="child_of")]) == {}


def test_corroboration_hides_what_the_asker_may_not_see(spark):
    nodes = spark.createDataFrame([(1, "group"), (9, "public")], "id long, scope string")
    assert corroborated(spark, [event(1, 9, 1, "a")], nodes, ["public"]) == {}
    assert corroborated(spark, [event(1, 9, 1, "a")], nodes, ["public", "group"])[9] == pytest.approx(0.8)


def reach(spark, edges, start, depth, nodes=None, scopes=None):
    hop = traverse.hops(spark.createDataFrame(edges, EDGE), at(), nodes, scopes)
    found = traverse.reach(spark.createDataFrame([(start,)], "seed long"), hop, depth)
    return {r.id: (round(r.confidence, 9), r.depth) for r in found.collect()}


def test_traversal_contracts(spark):
    edges = [edge(1, 2, 0.1), edge(1, 3, 0.9), edge(3, 2, 0.9)]
    assert reach(spark, edges, 1, 2) == {2: (0.81, 1), 3: (0.9, 1)}
    nodes = spark.createDataFrame([(1, "public"), (2, "public"), (3, "private")], "id long, scope string")
    triangle = [edge(1, 2, 0.5), edge(2, 3, 0.5), edge(1, 3, 0.9, scope="private")]
    assert reach(spark, triangle, 1, 2)[3] == (0.9, 1)
    assert set(reach(spark, triangle, 1, 2, nodes, ["public"])) == {2}


def test_traversal_equals_brute_force(spark):
    rnd = random.Random(7)
    for _ in range(3):
        pairs = {(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(11)}
        edges = {(a, b): rnd.uniform(0.1, 0.95) for a, b in pairs if a != b}
        best = {}

        def go(node, c, d):
            for (a, b), r in edges.items():
                if a == node and d < 4:
                    if b != 0:
                        old = best.get(b, (0, 9))
                        best[b] = (max(old[0], c * r), min(old[1], d + 1))
                    go(b, c * r, d + 1)

        go(0, 1.0, 0)
        got = reach(spark, [edge(a, b, r) for (a, b), r in edges.items()], 0, 4)
        assert set(got) == set(best)
        for k, (c, d) in best.items():
            assert got[k][0] == pytest.approx(c, abs=1e-8) and got[k][1] == d


def test_budget_discards_the_level_that_overflows(spark):
    hop = traverse.hops(spark.createDataFrame([edge(1, i) for i in range(2, 7)], EDGE), at())
    seeds = spark.createDataFrame([(1,)], "seed long")
    walked = traverse.walk(seeds, hop, 3, edge_budget=1)
    assert walked.truncated and walked.hits.count() == 0
    walked = traverse.walk(seeds, hop, 3, edge_budget=5)
    assert not walked.truncated and walked.hits.count() == 5


def test_collection_keeps_what_is_reinforced(spark):
    edges = spark.createDataFrame([edge(1, 2, age=2000), edge(1, 3, seen=1000, age=200, reliability=1.0), edge(1, 4, seen=1, age=200, reliability=1.0), edge(1, 5, reward=-1.0), edge(1, 6, seen=0)], EDGE)
    assert {r.dst for r in lifecycle.survivors(edges, at()).collect()} == {3}
    assert lifecycle.reaped(edges, at()).first().asDict() == {"edges": 5, "reaped": 4, "kept": 1}


def test_self_loop_counts_once(spark):
    edges = spark.createDataFrame([edge(1, 1), edge(1, 2)], EDGE)
    assert {r.node: r.degree for r in lifecycle.degrees(edges).collect()} == {1: 2, 2: 1}


def test_merge_unions_witnesses_and_drops_loops(spark):
    log = spark.createDataFrame([event(10, 20, 1, "p1"), event(11, 20, 2, "p4"), event(10, 11, 3, "p2")], LOG)
    mapping = spark.createDataFrame([(10, 10), (11, 10)], "id long, root long")
    edges = evidence.fold_edges(resolution.merge_evidence(log, mapping)).collect()
    assert [(e.src, e.dst, e.seen_count) for e in edges] == [(10, 20, 2)]


def test_components_and_survivors(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "into long, alias long")
    assert {r.id: r.root for r in resolution.roots(pairs).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    chosen = resolution.survivors(spark.createDataFrame([(1, 2), (3, 4)], "left_id long, right_id long"), spark.createDataFrame([(2, 5)], "node long, degree long"))
    assert {(r.into, r.alias) for r in chosen.collect()} == {(2, 1), (3, 4)}


def test_merge_keeps_the_survivor_s_terms(spark):
    log = spark.createDataFrame([event(11, 20, 1, "p1", "A", 0.3), event(10, 20, 2, "p2", "B", 0.9), event(10, 20, 3, "p1", "C", 0.5), event(11, 30, 4, "p4", reliability=0.2)], LOG)
    mapping = spark.createDataFrame([(10, 10), (11, 10)], "id long, root long")
    edges = {r.dst: (r.src, r.reliability, r.seen_count) for r in evidence.fold_edges(resolution.merge_evidence(log, mapping)).collect()}
    # p1 was the survivor's already, from C
    assert edges == {20: (10, 0.9, 2), 30: (10, 0.2, 1)}


def test_roots_follow_long_chains(spark):
    pairs = spark.createDataFrame([(i + 1, i) for i in range(200)], "into long, alias long")
    assert {r.root for r in resolution.roots(pairs).collect()} == {0}


@pytest.mark.parametrize("tile", [4, 1024])
def test_scored_pairs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(resolution, "TILE", tile)
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), "public", f"key {i}", None if i == 5 else [0.0, 0.0, 0.0] if i == 6 else [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, type string, scope string, key string, vec array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b) or 1)
    want = {(a[0], b[0]): cos(a[4], b[4]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[4] and b[4] and cos(a[4], b[4]) >= 0.3}
    got = {(r.left_id, r.right_id): r for r in resolution.scored_pairs(df, 0.3).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r.cosine for k, r in got.items()}
    assert all(r.left_key == f"key {r.left_id}" and r.right_key == f"key {r.right_id}" and r.type == rows[r.left_id][1] for r in got.values())
    top = resolution.propose(df, None, 0.3, 0.0, 7)
    assert {(r.left_id, r.right_id) for r in top.collect()} == set(sorted(want, key=lambda k: -want[k])[:7])
    known = spark.createDataFrame([(rows[a][1], f"key {b}", f"key {a}") for a, b in sorted(want, key=lambda k: -want[k])[:3]], "type string, alias_key string, canonical_key string")
    assert {(r.left_id, r.right_id) for r in resolution.propose(df, known, 0.3, 0.0, 7).collect()} == set(sorted(want, key=lambda k: -want[k])[3:10])


def test_walks_over_the_log_equal_walks_over_the_edges(spark, monkeypatch):
    rnd = random.Random(3)
    log = spark.createDataFrame([(*event(rnd.randint(0, 9), rnd.randint(0, 9), i, f"p{rnd.randint(0, 50)}", reliability=rnd.uniform(0.1, 0.9)), rnd.choice([0.0, 0.0, 0.0, -1.0])) for i in range(60)], LOG + ", reward double")
    seeds = spark.createDataFrame([(0,), (3,)], "seed long")
    key = lambda df: sorted((r.seed, r.id, round(r.confidence, 9), r.depth) for r in df.collect())
    want = key(traverse.reach(seeds, traverse.hops(evidence.fold_edges(log.drop("reward"), log), at()), 3))
    for frontier in (100_000, 0):
        monkeypatch.setattr(traverse, "FRONTIER", frontier)
        assert key(traverse.reach_log(seeds, log, at(), 3)) == want
    ids = spark.createDataFrame([(4,), (5,)], "node long")
    every = {r.node: r.confidence for r in confidence.corroboration_of_log(log, at()).collect()}
    assert {r.node: r.confidence for r in confidence.corroboration_of_log(log, at(), ids=ids).collect()} == {k: v for k, v in every.items() if k in (4, 5)}


def test_merge_outcomes(spark):
    nodes = spark.createDataFrame([("entity", "a", "public"), ("entity", "b", "public"), ("entity", "c", "private")], "type string, key string, scope string")
    asked = spark.createDataFrame([("entity", "x", "a"), ("entity", "a", "a"), ("entity", "a", "z"), ("entity", "a", "c"), ("entity", "a", "b")], "type string, alias_key string, into_key string")
    got = {(r.alias_key, r.into_key): r.outcome for r in resolution.outcomes(asked, nodes).collect()}
    assert got == {("x", "a"): "noop_no_alias", ("a", "a"): "noop_same", ("a", "z"): "renamed", ("a", "c"): "refused_cross_scope", ("a", "b"): "merged"}


def test_alias_chains_end_at_their_end(spark):
    steps = "ab bc cd tx xy yz zx pq qp mm"
    log = spark.createDataFrame([("entity", *s) for s in steps.split()], "type string, alias_key string, canonical_key string")
    assert {r.alias_key: r.canonical_key for r in evidence.close_aliases(log).collect()} == dict(a="d", b="d", c="d", t="x", x="x", y="x", z="x", p="p", q="p", m="m")
    assert evidence.close_aliases(log.limit(0)).count() == 0


def test_contract_names_the_first_violation(spark):
    nodes = spark.createDataFrame([(1, "public"), (2, "group")], "id long, scope string")
    row = dict(src=1, dst=2, type="mentions", scope="group", reliability=0.5, provenance="p", origin=None, kind="claim")
    cases = [({}, None), ({"type": "No!", "scope": "x"}, "invalid_type_format"), ({"scope": "x"}, "invalid_scope"), ({"reliability": 2.0}, "invalid_reliability"), ({"provenance": " "}, "invalid_provenance"), ({"origin": ""}, "invalid_origin"), ({"kind": "rumour"}, "invalid_evidence_kind"), ({"dst": 9}, "unknown_endpoint"), ({"scope": "public"}, "visibility_violation")]
    rows = [(*{**row, **c}.values(), i) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "src long, dst long, type string, scope string, reliability double, provenance string, origin string, kind string, i int")
    assert [r.reason for r in evidence.checked_edges(df, nodes).orderBy("i").collect()] == [c[1] for c in cases]


def test_no_scopes_no_rows(spark):
    assert schema.visible(spark.createDataFrame([("public",)], "scope string"), []).count() == 0


def test_gaps_and_fences(spark):
    box = spark.createDataFrame([(s,) for s in (1, 3, 4, 70_000, 70_002)], "seq long")
    assert sorted((r.first_missing, r.last_missing) for r in coordination.gaps(box).collect()) == [(2, 2), (5, 69_999), (70_001, 70_001)]
    claims = spark.createDataFrame([(1, 5, 1), (1, 3, 2), (1, 8, 3), (1, 8, 4)], "id long, token long, seq long")
    assert [r.won for r in coordination.fenced(claims).orderBy("seq").collect()] == [True, False, True, False]
    assert coordination.fences(claims).first().fence == 8


def test_lease_renewal_needs_the_current_lease(spark):
    log = spark.createDataFrame([(1, 1, "claim", "w", 4, None, 10), (1, 2, "renew", "w", 4, 10, 20), (1, 3, "renew", "w", 4, 10, 30), (1, 4, "renew", "v", 4, 20, 30)], "id long, seq long, op string, holder string, token long, observed long, until long")
    r = coordination.renewals(log).first()
    assert (r.holder, r.fence, r.lease_until, r.renewed, r.refused) == ("w", 4, 20, 1, 2)


def test_outbox_numbers_have_no_gaps(spark):
    changes = spark.createDataFrame([(f"c{i % 3}", f"k{i}", "{}", f"id{i % 50}", i) for i in range(80)], "change string, target_key string, payload string, idem_key string, order long")
    rows = sorted((r.seq, r.idem_key) for r in evidence.outbox(changes, offset=7).collect())
    assert [s for s, _ in rows] == list(range(8, 58)) and len({k for _, k in rows}) == 50


def test_ranks_of_many_rows_of_one_number(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([3, 3, 3, rnd.randint(0, 9)]), f"{rnd.randint(0, 10**9)}x{i}") for i in range(400)]
    got = [(r.order, r.idem) for r in evidence.ranked(spark.createDataFrame(rows, "order long, idem string"), ["order", "idem"], "n").orderBy("n").collect()]
    assert got == sorted(rows)


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from evidentia.operators.iterate import shared_folder

    conf = {"spark.sql.warehouse.dir": "/w/"}
    asked = lambda master, **more: shared_folder(SimpleNamespace(conf=conf | more, sparkContext=SimpleNamespace(master=master, getConf=dict)))
    assert asked("local[4]") == "/w/_checkpoints" and asked("yarn", **{"spark.checkpoint.dir": "s3://x"}) == "s3://x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            asked(master)


def grouped(pairs):
    root = {("path", p): ("path", p) for p, _ in pairs} | {("node", n): ("node", n) for _, n in pairs}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, n in pairs:
        root[find(("path", p))] = find(("node", n))
    least = {}
    for p in {p for p, _ in pairs}:
        least.setdefault(find(("path", p)), []).append(p)
    return {p: min(group) for group in least.values() for p in group}


def test_independence_groups_follow_long_chains(spark):
    chain = list(range(150))
    rnd = random.Random(9)
    mixed = rnd.sample(range(1000, 1150), 150)
    pairs = [(p, n) for at, p in enumerate(chain) for n in (at, at + 1)] + [(p, 5000 + n) for at, p in enumerate(mixed) for n in (at, at + 1)]
    pairs += [(2000 + rnd.randint(0, 60), 9000 + rnd.randint(0, 60)) for _ in range(70)]
    got = confidence.independence_groups(spark.createDataFrame(pairs, "path long, node long")).collect()
    assert {r.path: r.group for r in got} == grouped(pairs) and len(got) == len({p for p, _ in pairs})


def test_independence_groups_of_all_paths(spark):
    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()]
    got = entry.queries()["independence_groups"](spark, data).collect()
    assert {r.path: r.group for r in got} == grouped(pairs) and len(got) == len({p for p, _ in pairs})
