import json

from evidentia.operators import ingest
from evidentia.sources import connector, wiki
from evidentia.streaming import feed


class Titles(connector.Connector):
    """250 titles in pages of 50; options make it flaky, truncated or lying."""

    def __init__(self, n=250, flaky=0, ceiling=False, total=None):
        self.n, self.flaky, self.ceiling, self.total = n, flaky, ceiling, total

    def fetch(self, cursor, since=None):
        if self.flaky:
            self.flaky -= 1
            raise ConnectionError
        at = cursor or 0
        ids = [i for i in range(self.n) if since is None or i >= self.n - 3]
        part = ids[at : at + 50]
        events = [{"source": "t", "provenance": f"doc-{i}", "occurred_at": f"2026-01-{1 + i % 28:02d}T00:00:00Z", "entities": [("source", f"doc-{i}", "public", "")], "relations": []} for i in part]
        return connector.Page(events, at + 50, at + 50 >= len(ids), self.ceiling and at == 50, self.total)


def land(df):
    return ingest.ingest(df).outcomes


def test_sync_contracts(spark):
    r = connector.sync(spark, Titles(), land)
    assert (r.mode, r.ingested, r.pages, r.complete, r.watermark) == ("full", 250, 5, True, "2026-01-28T00:00:00Z")
    assert connector.sync(spark, Titles(60, flaky=2), land).complete
    broken = connector.sync(spark, Titles(60, flaky=9), land)
    assert (broken.complete, broken.errors, broken.pages) == (False, 1, 0)
    cut = connector.sync(spark, Titles(120, ceiling=True), land)
    assert (cut.complete, cut.ceilings) == (False, 1)
    assert not connector.sync(spark, Titles(60, total=100), land).complete
    delta = connector.sync(spark, Titles(), land, since="2026-01-01T00:00:00Z")
    assert (delta.mode, delta.ingested) == ("delta", 3)


class Stream(connector.Connector):
    def stream(self, since=None):
        for i in range(25):
            yield {"source": "t", "provenance": f"s-{i}", "occurred_at": "2026-01-01T23:00:00-05:00" if i == 3 else "2026-01-02T01:00:00Z", "entities": [("source", f"s-{i}", "public", "")], "relations": []}


def test_streams_land_in_pages_and_watermarks_are_instants(spark, monkeypatch):
    monkeypatch.setattr(connector.in_pages, "__defaults__", (10,))
    sizes = []

    def landed(df):
        sizes.append(df.count())
        return land(df)

    r = connector.sync(spark, Stream(), landed)
    # eleven in the evening, five hours west, is later than one o'clock
    assert (r.ingested, sizes, r.watermark) == (25, [10, 10, 5], "2026-01-01T23:00:00-05:00")


def test_pages_as_a_stream(spark, tmp_path):
    reader = connector._Pages(Titles(120), None)
    at, seen, ends = reader.initialOffset(), [], []
    while True:
        rows, end = reader.read(at)
        rows = list(rows)
        if not rows:
            break
        assert list(reader.readBetweenOffsets(at, end)) == rows
        seen += rows
        ends.append(end)
        at = end
    names = [f.name for f in connector.schema.EVENT]
    assert [r[names.index("seq")] for r in seen] == list(range(120)) and len(ends) == 3


def test_plugins_of_a_folder(tmp_path):
    (tmp_path / "good.py").write_text("from evidentia.sources.connector import Connector\nclass Mine(Connector):\n    pass\n")
    (tmp_path / "bad.py").write_text("raise ValueError('no')\n")
    found = connector.Plugins().load_folder(str(tmp_path))
    assert list(found.found) == ["good:Mine"] and list(found.broken) == ["bad"]


def test_python_source(spark):
    spark.dataSource.register(connector.Events)
    df = spark.read.format("events").option("connector", f"{__name__}:Titles").load() if __name__ != "test_sources" else None
    connector.register("titles", Titles)
    assert df is None or df.count() == 250
    assert list(connector.Plugins().load(["no.such.module"]).broken) == ["no.such.module"]


def test_wiki_events(spark, tmp_path):
    page = {"query": {"pages": [{"pageid": 1, "title": "mars", "revisions": [{"timestamp": "2026-01-01T00:00:00Z", "slots": {"main": {"content": "[[Earth]] and [[Red planet]] '''here'''"}}}]}], "redirects": [{"from": "Red planet", "to": "The red one"}, {"from": "The red one", "to": "Mars"}]}}
    (tmp_path / "a.json").write_text(json.dumps(page))
    responses = wiki.read(spark, str(tmp_path))
    row = wiki.events(responses).first()
    assert row.provenance == "wiki:Mars@2026-01-01T00:00:00Z" and [x["to"] for x in row.relations] == ["Earth", "Red planet"]
    links = spark.createDataFrame([("Mars", "Red planet"), ("Mars", "Earth")], "src string, dst string")
    assert {(r.src, r.dst) for r in wiki.resolve(links, wiki.redirects(responses)).collect()} == {("Mars", "Mars"), ("Mars", "Earth")}


class Api:
    """A wiki of articles A0, A1, ... in pages of three; each links to the next through a redirect."""

    def __init__(self, n):
        self.n, self.titles = n, []

    def __call__(self, params):
        if "titles" in params:
            asked = params["titles"].split("|")
            self.titles.append(len(asked))
            return {"query": {"redirects": [{"from": t, "to": t.replace("To ", "A")} for t in asked if t.startswith("To ")]}}
        at = int(params.get("gapcontinue", 0))
        page = lambda i: {"title": f"a{i}", "revisions": [{"timestamp": f"2026-01-{1 + i:02d}T00:00:00Z", "slots": {"main": {"content": f"'''a{i}''' [[to {i + 1}|next]] [[A{i}]]"}}}]}
        more = {"continue": {"gapcontinue": str(at + 3)}} if at + 3 < self.n else {}
        return {"query": {"pages": [page(i) for i in range(at, min(self.n, at + 3))]}} | more


def test_wiki_is_pulled_by_its_continue_token(spark):
    api = Api(8)
    r = connector.sync(spark, wiki.Wiki(api, batch=2), land)
    assert (r.ingested, r.pages, r.complete, r.watermark) == (8, 3, True, "2026-01-08T00:00:00Z") and max(api.titles) == 2
    first = wiki.Wiki(Api(8)).fetch(None).events[0]
    assert first["relations"] == [("A0", "A1", "links_to")] and first["entities"][0] == ("article", "A0", "public", "a0 next A0")
    cut = connector.sync(spark, wiki.Wiki(Api(8), ceiling=5), land)
    assert (cut.ingested, cut.pages, cut.complete, cut.ceilings) == (5, 2, False, 1)
    exact = connector.sync(spark, wiki.Wiki(Api(6), ceiling=6), land)
    assert (exact.ingested, exact.complete) == (6, True)
    late = connector.sync(spark, wiki.Wiki(Api(8)), land, since="2026-01-06T00:00:00Z")
    assert (late.mode, late.ingested) == ("delta", 2)


class Hostile(connector.Connector):
    """Titles by keyset cursor; each third page fails once; a page over its byte ceiling loses the second half of its window; movers only in a delta."""

    def __init__(self, titles, ceiling=10_000, movers=()):
        self.titles, self.ceiling, self.movers, self.failed = sorted(titles), ceiling, set(movers), set()

    def fetch(self, cursor, since=None):
        rest = [t for t in self.titles if (cursor is None or t > cursor) and (since is None or t in self.movers)][:4]
        if cursor and len(cursor) % 3 == 0 and cursor not in self.failed:
            self.failed.add(cursor)
            raise ConnectionError
        over = sum(map(len, rest)) > self.ceiling
        kept = rest[: len(rest) // 2] if over else rest
        events = [{"source": "h", "provenance": t, "occurred_at": "2026-01-01T00:00:00Z", "entities": [("source", t, "public", "")], "relations": []} for t in kept]
        return connector.Page(events, rest[-1] if rest else cursor, len(rest) < 4, over)


def test_hostile_source(spark):
    titles = [f"t{i:02d}" for i in range(10)]
    whole = connector.sync(spark, Hostile(titles), land)
    assert (whole.ingested, whole.complete, whole.errors) == (10, True, 0)
    lost = connector.sync(spark, Hostile(titles, ceiling=8), land)
    assert (lost.complete, lost.ceilings) == (False, 2) and lost.ingested < 10
    moved = connector.sync(spark, Hostile(titles, movers={"t03", "t08"}), land, since="2025-01-01T00:00:00Z")
    assert (moved.mode, moved.ingested, moved.complete) == ("delta", 2, True)


def test_feed_is_dispatched_once_in_lanes(spark, tmp_path):
    rows = [(i, "content_added" if i % 2 else "edge_reinforced", f"k{i % 3}", "{}", f"id{i}") for i in range(1, 21)]
    from evidentia import schema

    spark.createDataFrame(rows, schema.OUTBOX).write.parquet(f"{tmp_path}/box")
    got, lost = [], []
    d = feed.Dispatcher()
    d.subscribe("content_added", lambda df: got.extend((r.target_key, r.seq) for r in df.collect()))
    d.unmatched = lambda df: lost.extend(r.change for r in df.collect())
    for _ in range(2):
        feed.tail(feed.changes(spark, f"{tmp_path}/box"), d, f"{tmp_path}/cursor").awaitTermination()
    assert len(got) == 10 and set(lost) == {"edge_reinforced"} and len(lost) == 10
    for lane in {k for k, _ in got}:
        assert [s for k, s in got if k == lane] == sorted(s for k, s in got if k == lane)


def test_feed_waits_for_gaps(spark, tmp_path):
    from pyspark.sql import functions as F

    from evidentia import schema

    def write(seqs):
        spark.createDataFrame([(s, "c", "k", "{}", f"i{s}") for s in seqs], schema.OUTBOX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/box")

    write([1, 3])
    ordered = feed.in_order(feed.changes(spark, f"{tmp_path}/box").withColumn("lane", F.lit("all")))
    out = []

    def run():
        ordered.writeStream.foreachBatch(lambda df, _: out.extend(r.seq for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cursor").outputMode("append").trigger(once=True).start().awaitTermination(60)

    run()
    assert out == [1]
    write([2, 4])
    run()
    assert out == [1, 2, 3, 4]
