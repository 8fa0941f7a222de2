"""The engine as its users call it: one object to ask and search, and one to change the graph, over a ``Store``.

Transports (RPC, HTTP, the command line) stand in front of ``Core``; requests and answers are plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import ports
from evidentia.config import DEFAULT
from evidentia.functions import scalars
from evidentia.operators import changes, content, coordination, embedding, evidence, lifecycle, resolution, retrieval, routing, traverse
from evidentia.store import Store

#: (query, scopes, limit, owner) to hits (id, type, key, score).
Retriever = Callable[[str, list[str], int, str | None], DataFrame]


def _now() -> Column:
    return F.lit(datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


class Core:
    """Ask, status and search. Without scopes an asker is public; a limit of 0 is the default one.

    model: embeds for routing and dense search (without one, keywords route and the lexical arm answers);
    retriever: replaces the store's own search; escalate: answers what is routed past the tools;
    skill: puts answers into the asker's words.
    """

    def __init__(self, store: Store, model: ports.Model | None = None, retriever: Retriever | None = None, escalate: Callable[[str, str], routing.Verdict] | None = None, skill: ports.Skill | None = None, connectors: list[str] | None = None, panel: list[str] | None = None, handle: float = DEFAULT.handle_threshold) -> None:
        self.store, self.model, self.retriever, self.escalate, self.skill = store, model, retriever, escalate, skill
        self.connectors, self.panel, self.handle = connectors or [], panel or [], handle

    def route(self, query: str) -> tuple[str, str | None, float | None]:
        """(tier, intent, score): by the closest prototype where there is a model that answers, else by keywords."""
        spark = self.store.spark
        try:
            vectors = self.model.embed([query, *[p[2] for p in routing.PROTOTYPES]]) if self.model else None
        except (ConnectionError, TimeoutError, OSError):
            vectors = None
        if not vectors:
            return spark.range(1).select(scalars.keyword_route(F.lit(query)).alias("r")).first().r, None, None
        known = spark.createDataFrame([(p[0], p[1], i, [float(x) for x in v]) for i, (p, v) in enumerate(zip(routing.PROTOTYPES, vectors[1:], strict=True))], "intent string, tier string, ordinal int, vec array<double>")
        asked = spark.createDataFrame([(0, query, [float(x) for x in vectors[0]])], "id int, text string, vec array<double>")
        row = routing.routed(routing.nearest(asked, known), self.handle).first()
        return row.route, row.intent, row.score

    def ask(self, query: str, scopes: list[str] | None = None, viewer: str | None = None) -> routing.Answer:
        tier, intent, _ = self.route(query)
        hits = None
        if self.retriever is not None:
            hits = lambda owner: self.retriever(query, scopes or ["public"], DEFAULT.limit, owner)
        answer = routing.ask(self.store.spark, query, self.store.read("node"), self.store.read("chunk"), tier, scopes, viewer or None, self.escalate, retriever=hits)
        if self.skill is not None:
            answer.answer = self.skill.deflection({"query": query}) if intent == "off_topic" and tier == "tier0" else self.skill.render(asdict(answer), {"query": query})
        return answer

    def search(self, query: str, scopes: list[str] | None = None, limit: int = 0) -> list[dict]:
        """Hits (id, type, key, score), best first."""
        scopes, limit = scopes or ["public"], limit or DEFAULT.limit
        if self.retriever is not None:
            found = self.retriever(query, scopes, limit, None)
        else:
            nodes = self.store.read("node")
            embed = (lambda q: self.model.embed([q])[0]) if self.model else None
            memories = retrieval.search(self.store.read("chunk"), nodes, query, scopes, embed=embed, limit=limit)
            named = memories.join(nodes.select(F.col("id").alias("node_id"), "type", "key"), "node_id")
            found = named.select(F.col("node_id").alias("id"), "type", "key", "score").orderBy(F.desc("score"), "id")
        return [r.asDict() for r in found.collect()]

    def answer(self, query: str, scopes: list[str] | None = None, as_of: Column | None = None, **options) -> retrieval.Answer:
        """The memories with their confidence, and what they lead to."""
        return retrieval.answer(self.store.read("chunk"), self.store.read("node"), self.store.read("evidence"), query, scopes or ["public"], _now() if as_of is None else as_of, **options)

    def status(self) -> dict:
        nodes, log = self.store.read("node"), self.store.read("evidence")
        found = routing.status(nodes, log.select(*evidence.EDGE_KEY).distinct(), self.connectors, self.panel)
        stamps = embedding.namespaces(self.store.read("schema_meta")).collect()
        return found | {"namespaces": [r.asDict() for r in stamps], "capabilities": [*sorted(self.connectors), f"panel:{len(self.panel)}-models"]}


class Graph:
    """Changes to the graph, each with its rows in the change feed; rejected rows go to the dead letters."""

    def __init__(self, store: Store) -> None:
        self.store = store

    def _tell(self, rows: DataFrame) -> None:
        last = self.store.read("outbox").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self.store.append("outbox", evidence.outbox(rows, last))

    def add_nodes(self, nodes: DataFrame) -> int:
        """How many of the nodes were taken."""
        good, dead = evidence.insert_nodes(nodes)
        self.store.append("node", good)
        self.store.append("dead_letter", dead)
        self._tell(changes.node_added(good))
        return good.count()

    def add_edges(self, events: DataFrame) -> int:
        """How many of the events were taken; those that brought a new witness are told."""
        checked = evidence.checked_edges(events, self.store.read("node").select("id", "scope"))
        good = checked.filter("reason is null").drop("reason")
        if "reward" not in good.columns:
            good = good.withColumn("reward", F.lit(0.0))
        touched = self.store.read("evidence").join(good.select(*evidence.EDGE_KEY).distinct(), list(evidence.EDGE_KEY), "left_semi")
        new = good.select("seq", *evidence.EDGE_KEY, F.lit(True).alias("_new")).distinct()
        whole = touched.unionByName(good, allowMissingColumns=True)
        told = changes.edge_reinforced(whole).join(good.select(F.col("seq").alias("order")).distinct(), "order", "left_semi")
        self._tell(told.select("change", "target_key", "payload", "idem_key", "order"))
        self.store.append("evidence", good)
        self.store.append("dead_letter", evidence.dead_letters(checked.filter("reason is not null")))
        return new.count()

    def put_bodies(self, log: DataFrame) -> None:
        """Bodies (node_id, body, seq): the latest of each node; each is told, changed or not."""
        put = content.put_bodies(log)
        old = self.store.read("content")
        embedded = old.select("node_id", "embedded_hash")
        self.store.replace("content", old.join(put.select("node_id"), "node_id", "left_anti").unionByName(put.join(embedded, "node_id", "left"), allowMissingColumns=True))
        self._tell(changes.content_added(log.filter(F.trim("body") != "").groupBy("node_id").agg(F.max("seq").alias("seq"))))

    def claim(self, log: DataFrame) -> DataFrame:
        """Appends claims and renewals; the leases after them."""
        self.store.append("claim", log)
        return coordination.renewals(self.store.read("claim"))

    def read_fences(self) -> DataFrame:
        return coordination.fences(self.store.read("claim").filter("op = 'claim'"))

    def traverse(self, start: int, depth: int, scopes: list[str], as_of: Column | None = None) -> DataFrame:
        seeds = self.store.spark.createDataFrame([(start,)], "seed long")
        found = traverse.reach_log(seeds, self.store.read("evidence"), _now() if as_of is None else as_of, depth if scopes else 0, self.store.read("node"), scopes)
        return traverse.ordered(found.select("id", "confidence", "depth"))

    def audit(self, kind: str, rows: DataFrame) -> None:
        """Appends a pass' decisions or its summary to the audit, each row as JSON under its kind."""
        last = self.store.read("audit").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        self.store.append("audit", rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("payload"), F.lit(last + 1).alias("seq")))

    def resolve(self, degree: DataFrame, confirm: Column, **thresholds) -> DataFrame:
        """A pass of entity resolution over the store's entities: its decisions and summary are audited, merged ids replaced in the evidence, merges told; the summary."""
        nodes = self.store.read("node")
        entities = nodes.filter("type = 'entity' and vec is not null").select("id", "type", "scope", "key", "vec")
        decided, mapping = resolution.run_pass(entities, degree, confirm, **thresholds)
        found = resolution.summary(decided)
        self.audit("entity_resolution", decided)
        self.audit("entity_resolution_pass", found)
        moved = mapping.filter("id <> root")
        if not moved.isEmpty():
            merged = resolution.merge_evidence(self.store.read("evidence"), mapping)
            self.store.replace("evidence", merged)
            self.store.replace("node", nodes.join(moved.select("id"), "id", "left_anti"))
            self._tell(changes.merges(moved.select(F.col("root").alias("into_id"), F.col("id").alias("alias_id"), F.lit("merged").alias("outcome"), F.col("id").alias("seq"))))
        return found

    def collect_garbage(self, as_of: Column | None = None) -> DataFrame:
        """Removes the events of edges that have evaporated; one row of how many edges there were, went and stayed."""
        log = self.store.read("evidence")
        edges = evidence.fold_edges(log.drop("reward"), log)
        at = _now() if as_of is None else as_of
        report = self.store.spark.createDataFrame([lifecycle.reaped(edges, at).first().asDict()])
        kept = lifecycle.survivors(edges, at).select(*evidence.EDGE_KEY)
        self.store.replace("evidence", log.join(kept, list(evidence.EDGE_KEY), "left_semi"))
        return report


class EmbedWorker(ports.Worker):
    """Handles content_added rows of the change feed: embeds the bodies of the nodes they name. Rows that come again find their bodies embedded."""

    def __init__(self, store: Store, model: ports.Model | None = None, namespace: str = "hash-64") -> None:
        self.store, self.model, self.namespace = store, model, namespace

    def __call__(self, rows: DataFrame) -> None:
        wanted = rows.select(F.get_json_object("payload", "$.node_id").cast("long").alias("node_id")).filter("node_id is not null")
        if not wanted.isEmpty():
            self.handle({"wanted": wanted})

    def handle(self, task: dict) -> dict:
        store = self.store
        done = embedding.embed_bodies(store.read("content"), store.read("chunk"), task.get("wanted"), self.model.embed if self.model else None, self.namespace, task.get("force", False))
        counts = {r.outcome: r["count"] for r in done.outcomes.groupBy("outcome").count().collect()}
        if counts.get("embedded"):
            vectors, nodes = done.vectors, store.read("node")
            store.replace("chunk", done.chunks)
            store.replace("node", embedding.with_vectors(nodes, vectors, "node_id"))
            # the hashes last: a pass that fails before is done again
            store.replace("content", done.content)
            store.append("schema_meta", done.stamps)
        return counts


class Models:
    """Embedding and generation as callers ask for them, over a model: batches are answered whole or not at all, prompts have a ceiling."""

    def __init__(self, model: ports.Model, namespace: str = "hash-64", ceiling: int = DEFAULT.hard_tokens) -> None:
        self.model, self.namespace, self.ceiling = model, namespace, ceiling

    def embed(self, texts: list[str]) -> dict:
        """vectors, namespace and dim; another number of vectors, or of another length, is an error."""
        vectors = self.model.embed(texts) if texts else []
        if len(vectors) != len(texts) or len({len(v) for v in vectors}) > 1:
            raise ValueError("the embedder answered other vectors than it was asked for")
        return {"vectors": vectors, "namespace": self.namespace, "dim": len(vectors[0]) if vectors else 0}

    def generate(self, model: str, prompt: str, **options) -> str:
        """The model's text; a prompt beyond the ceiling is refused before any call."""
        routing.ensure(prompt, self.ceiling)
        return self.model.complete({"model": model, "prompt": prompt, **options})["text"]


class Timer:
    """Runs a job again and again, for instance ``Graph.collect_garbage`` every hour; one that fails is noted and tried again at its next turn."""

    def __init__(self, seconds: float, job: Callable[[], object]) -> None:
        import threading

        self.seconds, self.job, self.runs, self.errors = seconds, job, 0, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._loop, daemon=True)

    def _loop(self) -> None:
        while not self._stop.wait(self.seconds):
            try:
                self.job()
            except Exception as e:  # noqa: BLE001  the next turn tries again
                self.errors.append(repr(e))
            self.runs += 1

    def start(self) -> Timer:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
