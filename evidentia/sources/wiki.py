"""MediaWiki query responses as events: JSON files as DataFrames, and the API as a paginated connector."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import scalars
from evidentia.sources import connector

RESPONSE = "query struct<pages: array<struct<pageid: long, title: string, revisions: array<struct<timestamp: string, slots: struct<main: struct<content: string>>, content: string>>>>, redirects: array<struct<`from`: string, `to`: string>>>, `continue` map<string, string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path)


def redirects(responses: DataFrame) -> DataFrame:
    """(alias, target) of canonical titles."""
    rows = responses.select(F.explode("query.redirects").alias("r"))
    return rows.select(scalars.canonical_title("r.from").alias("alias"), scalars.canonical_title("r.to").alias("target")).distinct()


def resolve(links: DataFrame, redirect: DataFrame) -> DataFrame:
    """Links (src, dst) with redirect chains followed to their end; cycles end at their least title."""
    from evidentia.operators.evidence import close_aliases

    closed = close_aliases(redirect.select(F.lit("article").alias("type"), F.col("alias").alias("alias_key"), F.col("target").alias("canonical_key")))
    named = closed.select(F.col("alias_key").alias("dst"), "canonical_key")
    return links.join(named, "dst", "left").select("src", F.coalesce("canonical_key", "dst").alias("dst")).distinct()


def pages(responses: DataFrame) -> DataFrame:
    """(title, occurred_at, body, targets): readable text and canonical link targets of each page."""
    p = responses.select(F.explode("query.pages").alias("p"))
    rev = F.element_at(F.col("p.revisions"), 1)
    rows = p.select(F.col("p.title").alias("raw"), F.when(F.size("p.revisions") > 0, rev).alias("rev"))
    text = F.coalesce("rev.slots.main.content", "rev.content", F.lit(""))
    return rows.select(scalars.canonical_title("raw").alias("title"), F.coalesce("rev.timestamp", F.lit("1970-01-01T00:00:00Z")).alias("occurred_at"), scalars.plain_text(text).alias("body"), F.array_distinct(scalars.link_targets(text)).alias("targets"))


def events(responses: DataFrame, scope: str = "public") -> DataFrame:
    """One event for each page: an article, its link targets, and links_to relations."""
    rows = pages(responses)
    me = F.struct(F.lit("article").alias("type"), F.col("title").alias("key"), F.lit(scope).alias("scope"), F.col("body").alias("content"))
    others = F.transform(F.array_except("targets", F.array("title")), lambda t: F.struct(F.lit("article").alias("type"), t.alias("key"), F.lit(scope).alias("scope"), F.lit("").alias("content")))
    links = F.transform(F.array_except("targets", F.array("title")), lambda t: F.struct(F.col("title").alias("from"), t.alias("to"), F.lit("links_to").alias("type")))
    name = F.concat(F.lit("wiki:"), F.col("title"), F.lit("@"), F.col("occurred_at"))
    return rows.select(F.lit("wiki").alias("source"), name.alias("provenance"), F.concat(F.lit("wiki:"), F.col("title")).alias("origin"), "occurred_at", F.concat(F.array(me), others).alias("entities"), links.alias("relations"), F.xxhash64(name).alias("seq"))


class Wiki(connector.Connector):
    """All articles of a wiki, in the API's own pages: the answer's ``continue`` is the cursor.

    get: (parameters) to the parsed answer. ceiling: articles after which the pull stops, and says so. Link targets
    that are redirects are resolved, ``batch`` titles a request, chains to their end.
    """

    def __init__(self, get: Callable[[dict], dict], ceiling: int | None = None, scope: str = "public", batch: int = 50) -> None:
        self.get, self.ceiling, self.scope, self.batch = get, ceiling, scope, batch

    def fetch(self, cursor: dict | None, since: str | None = None) -> connector.Page:
        cursor = cursor or {"continue": {}, "pulled": 0}
        answer = self.get({"action": "query", "generator": "allpages", "prop": "revisions", "rvprop": "content|timestamp", "rvslots": "main", "format": "json", "formatversion": "2", **cursor["continue"]})
        found = answer.get("query", {}).get("pages", [])
        room = len(found) if self.ceiling is None else max(0, self.ceiling - cursor["pulled"])
        kept, goes_on = found[:room], answer.get("continue")
        full = len(found) > room or bool(goes_on) and self.ceiling is not None and cursor["pulled"] + len(kept) >= self.ceiling
        texts = [(scalars.wiki_title(p["title"]), *self._revision(p)) for p in kept]
        texts = [t for t in texts if since is None or datetime.fromisoformat(t[1]) > datetime.fromisoformat(since)]
        names = self._resolved({t for _, _, text in texts for t in scalars.wiki_links(text)})
        return connector.Page([self._event(title, at, text, names) for title, at, text in texts], {"continue": goes_on or {}, "pulled": cursor["pulled"] + len(kept)}, not goes_on or full, full)

    @staticmethod
    def _revision(page: dict) -> tuple[str, str]:
        latest = (page.get("revisions") or [{}])[0]
        return latest.get("timestamp", "1970-01-01T00:00:00Z"), latest.get("slots", {}).get("main", {}).get("content", latest.get("content", ""))

    def _resolved(self, titles: Iterable[str]) -> dict[str, str]:
        """Each title's article; redirects that lead in a circle stay as they are."""
        steps, asked = {}, sorted(titles)
        for at in range(0, len(asked), self.batch):
            answer = self.get({"action": "query", "titles": "|".join(asked[at : at + self.batch]), "redirects": "1", "format": "json", "formatversion": "2"})
            steps |= {scalars.wiki_title(r["from"]): scalars.wiki_title(r["to"]) for r in answer.get("query", {}).get("redirects", [])}
        out = {}
        for title in asked:
            end, seen = title, set()
            while end in steps and end not in seen:
                seen.add(end)
                end = steps[end]
            out[title] = title if end in seen else end
        return out

    def _event(self, title: str, at: str, text: str, names: dict[str, str]) -> dict:
        targets = [t for t in dict.fromkeys(names[t] for t in scalars.wiki_links(text)) if t != title]
        entities = [("article", title, self.scope, scalars.wiki_plain(text)), *[("article", t, self.scope, "") for t in targets]]
        return {"source": "wiki", "provenance": f"wiki:{title}@{at}", "origin": f"wiki:{title}", "occurred_at": at, "entities": entities, "relations": [(title, t, "links_to") for t in targets]}
