"""Connectors and the sync driver."""

from __future__ import annotations

import json
from abc import ABC
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from evidentia import schema
from evidentia.functions import scalars

#: Events of a stream that are landed at a time.
PAGE = 10_000
#: Events that are landed together: a landing's jobs cost the same for one page as for many.
LANDED = 50_000


@dataclass
class Page:
    events: list[dict]
    cursor: Any = None
    done: bool = False
    truncated: bool = False
    total: int | None = None


class Connector(ABC):
    """A source of events: pages by cursor, or a whole stream."""

    def describe(self) -> dict:
        return {"name": type(self).__name__}

    def fetch(self, cursor: Any, since: str | None = None) -> Page:
        raise NotImplementedError

    def stream(self, since: str | None = None) -> Iterable[dict]:
        raise NotImplementedError


@dataclass
class Report:
    mode: str
    ingested: int = 0
    duplicates: int = 0
    errors: int = 0
    pages: int = 0
    ceilings: int = 0
    complete: bool = True
    watermark: str | None = None
    expected: int | None = None


def pages(connector: Connector, since: str | None, retries: int, report: Report, cursor: Any = None) -> Iterator[Page]:
    """Pages until done; one that keeps failing ends the run as incomplete."""
    while True:
        for attempt in range(retries + 1):
            try:
                page = connector.fetch(cursor, since)
                break
            except (ConnectionError, TimeoutError, OSError):
                if attempt == retries:
                    report.errors += 1
                    report.complete = False
                    return
        report.pages += 1
        if page.truncated:
            report.ceilings += 1
            report.complete = False
        if page.total is not None:
            report.expected = max(report.expected or 0, page.total)
        yield page
        if page.done:
            return
        cursor = page.cursor


def delta(events: DataFrame, since: str | None, at: str = "ts") -> DataFrame:
    """The events that moved after the watermark; all without one."""
    return events if since is None else events.filter(F.col(at).cast("timestamp") > F.lit(since).cast("timestamp"))


def in_pages(events: Iterable[dict], size: int = PAGE) -> Iterator[Page]:
    """A stream's events, so many at a time: the driver holds one page."""
    rows = iter(events)
    while page := list(islice(rows, size)):
        yield Page(page)


def later(a: str | None, b: str | None) -> str | None:
    """Of two times with an offset the later instant, as it is written; the first of equals."""
    if not a or not b:
        return a or b
    return b if datetime.fromisoformat(b) > datetime.fromisoformat(a) else a


def _gathered(found: Iterator[Page]) -> Iterator[list[dict]]:
    """The events of whole pages, about ``LANDED`` together; what was gathered before a failure comes before it."""
    held: list[dict] = []
    failed = None
    while failed is None:
        try:
            page = next(found)
        except StopIteration:
            break
        except Exception as e:  # noqa: BLE001  raised again once the pages before it are landed
            failed = e
            break
        held += page.events
        if len(held) >= LANDED:
            yield held
            held = []
    if held:
        yield held
    if failed is not None:
        raise failed


def sync(spark: SparkSession, connector: Connector, land: Callable[[DataFrame], DataFrame], since: str | None = None, retries: int = 2, expected_total: int | None = None) -> Report:
    """Pulls a source page by page; ``land`` ingests whole pages, of about ``LANDED`` events together, and answers their outcomes (provenance, outcome).

    What came before a source fails is landed.

    The watermark is the latest instant of written events, as the source writes it. A complete run that brought fewer events than the
    source declares, or the caller expects, is incomplete.
    """
    report = Report("delta" if since else "full", watermark=since)
    if type(connector).fetch is not Connector.fetch:
        found = pages(connector, since, retries, report)
    elif type(connector).stream is not Connector.stream:
        found = in_pages(connector.stream(since))
    else:
        raise TypeError("a connector fetches pages or streams events")
    offset = 0
    for events in _gathered(found):
        rows = [{**e, "seq": offset + i} for i, e in enumerate(events)]
        offset += len(rows)
        df = spark.createDataFrame([tuple(e.get(f.name) for f in schema.EVENT) for e in rows], schema.EVENT)
        got = land(df).join(df.select("seq", "occurred_at"), "seq").groupBy("outcome").agg(F.count("*").alias("n"), F.max_by("occurred_at", scalars.utc_timestamp(F.col("occurred_at"))).alias("last")).collect()
        by = {r["outcome"]: r for r in got}
        report.ingested += by["written"]["n"] if "written" in by else 0
        report.duplicates += by["duplicate"]["n"] if "duplicate" in by else 0
        report.errors += by["quarantined"]["n"] if "quarantined" in by else 0
        if "written" in by:
            report.watermark = later(report.watermark, by["written"]["last"])
    expected = expected_total if expected_total is not None else report.expected
    if report.complete and expected is not None and report.ingested + report.duplicates < expected:
        report.complete = False
    return report


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, since: str | None) -> None:
        self.connector, self.since = connector, since

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = 0
        report = Report("full")
        for page in pages(self.connector, self.since, 2, report):
            for e in page.events:
                yield tuple({**e, "seq": n}.get(f.name) for f in schema.EVENT)
                n += 1
        if not report.complete:
            raise RuntimeError("the source could not be read completely")


class _Pages(SimpleDataSourceStreamReader):
    """A connector's pages as a stream: the offset is the next page's cursor, as JSON, and the number of events before it."""

    def __init__(self, connector: Connector, since: str | None) -> None:
        self.connector, self.since = connector, since

    def initialOffset(self) -> dict:
        return {"cursor": "null", "seq": 0, "done": 0}

    def _page(self, start: dict) -> tuple[list[tuple], dict]:
        if start["done"]:
            return [], start
        report = Report("stream")
        page = next(pages(self.connector, self.since, 2, report, json.loads(start["cursor"])), None)
        if page is None:
            raise RuntimeError("the source could not be read")
        rows = [tuple({**e, "seq": start["seq"] + i}.get(f.name) for f in schema.EVENT) for i, e in enumerate(page.events)]
        return rows, {"cursor": json.dumps(page.cursor), "seq": start["seq"] + len(rows), "done": int(page.done)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._page(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start["seq"] < end["seq"]:
            rows, start = self._page(start)
            yield from rows


#: Connectors by name, for ``spark.read.format("events").option("connector", name)``.
REGISTRY: dict[str, Callable[[], Connector]] = {}


def register(name: str, make: Callable[[], Connector]) -> None:
    REGISTRY[name] = make


class Events(DataSource):
    """Python data source over a connector given as ``module:attribute`` or by its registered name."""

    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self):
        return schema.EVENT

    def _connector(self) -> Connector:
        import importlib

        name = self.options["connector"]
        if ":" in name:
            module, attribute = name.split(":")
            return getattr(importlib.import_module(module), attribute)()
        return REGISTRY[name]()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._connector(), self.options.get("since"))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Pages(self._connector(), self.options.get("since"))


@dataclass
class Plugins:
    """Connector classes found in modules; one that doesn't import is skipped and noted."""

    found: dict[str, type[Connector]] = field(default_factory=dict)
    broken: dict[str, str] = field(default_factory=dict)

    def load_folder(self, folder: str) -> Plugins:
        """The Python files of a folder, by name."""
        import importlib.util
        from pathlib import Path

        for path in sorted(Path(folder).glob("*.py")):
            try:
                spec = importlib.util.spec_from_file_location(path.stem, path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
            except Exception as e:  # noqa: BLE001  a broken plugin must not stop the others
                self.broken[path.stem] = repr(e)
                continue
            self._take(path.stem, module)
        return self

    def _take(self, name: str, module) -> None:
        for x in vars(module).values():
            if isinstance(x, type) and issubclass(x, Connector) and x is not Connector:
                self.found[f"{name}:{x.__name__}"] = x

    def load(self, modules: list[str]) -> Plugins:
        import importlib

        for name in modules:
            try:
                module = importlib.import_module(name)
            except Exception as e:  # noqa: BLE001  a broken plugin must not stop the others
                self.broken[name] = repr(e)
                continue
            self._take(name, module)
        return self
