"""JSON responses of an HTTP endpoint as a Spark data source, in batch (`read`) or as a stream (`readStream`).

    spark.dataSource.register(JsonPoll)
    spark.readStream.format("json_poll").option("url", ...).option("retries", "2").load()

A trigger of the query is a poll. HTTP errors are tried again up to `retries` times, network errors until `patience` seconds have
gone; what does not come is a row with an error and no body, so that a poll is never lost silently. Options that start with
`header.` are sent as headers.

With the option `log`, a folder that the driver keeps over restarts (one for each checkpoint), a stream's answers are written there before
their offset is given out: a poll that a restart interrupted is read from it, neither lost nor asked for again, until it is committed.
Without it such a poll gives no rows.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "url string, poll long, checked_at double, body string, error string"


def fetch(url: str, headers: dict[str, str], timeout: float, retries: int, patience: float, pause: float = 1.0) -> tuple[str | None, str | None]:
    """(body, error): the body is JSON text."""
    began, tries = time.monotonic(), 0
    while True:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
                body = r.read().decode("utf-8")
                json.loads(body)
                return body, None
        except urllib.error.HTTPError as e:
            tries += 1
            if tries > retries:
                return None, f"HTTP {e.code}"
        except ValueError as e:
            return None, f"not JSON: {e}"
        except OSError as e:
            if time.monotonic() - began >= patience:
                return None, f"network: {e}"
        time.sleep(pause)


def _strong(marker: str | None) -> str | None:
    """An entity tag that stands for its bytes; weak ones do not."""
    return marker if marker and not marker.startswith("W/") else None


def read_if_changed(resources: DataFrame, timeout: float = 10) -> DataFrame:
    """resources(url, marker) with changed, body (binary), marker and error: a body only where the server's entity tag is another than the
    marker (null: none is known), asked for by a conditional request. Executors ask side by side; a server without strong tags is an error
    of its row."""

    def ask(url: str, marker: str | None) -> tuple:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"If-None-Match": marker} if marker else {}), timeout=timeout) as r:
                body, tag = r.read(), _strong(r.headers.get("ETag"))
                return (url, True, body, tag, None) if tag else (url, None, None, marker, "no strong entity tag")
        except urllib.error.HTTPError as e:
            return (url, False, None, marker, None) if e.code == 304 else (url, None, None, marker, f"HTTP {e.code}")
        except OSError as e:
            return url, None, None, marker, f"network: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([ask(u, m) for u, m in zip(b["url"], b["marker"].astype(object).where(b["marker"].notna(), None))], columns=["url", "changed", "body", "marker", "error"])

    return resources.select("url", "marker").mapInPandas(run, "url string, changed boolean, body binary, marker string, error string")


def remote_listing(responses: DataFrame) -> DataFrame:
    """(url, name, marker) of the entries of WebDAV folders: responses(url, body) are the answers to a PROPFIND of depth 1. The folder itself
    and what lies elsewhere are no entries; weak tags are no markers."""

    def entries(url: str, body: str) -> list[tuple]:
        own, out = urllib.parse.urlparse(url).path.rstrip("/") + "/", {}
        for node in (n for n in ElementTree.fromstring(body).iter() if n.tag.rpartition("}")[2] == "response"):
            said = {n.tag.rpartition("}")[2]: n.text for n in reversed(list(node.iter())) if n.text and n.text.strip()}
            path = urllib.parse.urlparse(said.get("href", "")).path
            if path.startswith(own) and path.rstrip("/") != own.rstrip("/"):
                out[urllib.parse.unquote(path[len(own) :].strip("/"))] = _strong(said.get("getetag"))
        return [(url, name, out[name]) for name in sorted(out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for u, x in zip(b["url"], b["body"]) for r in entries(u, x)], columns=["url", "name", "marker"])

    return responses.select("url", "body").mapInPandas(run, "url string, name string, marker string")


class _Settings:
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("url", "").split(",") if u]
        self.headers = {k[7:]: v for k, v in options.items() if k.startswith("header.")}
        self.log = options.get("log")
        self.timeout, self.retries, self.patience, self.pause = float(options.get("timeout", 10)), int(options.get("retries", 2)), float(options.get("patience", 60)), float(options.get("pause", 1))

    def row(self, url: str, poll: int) -> tuple:
        body, error = fetch(url, self.headers, self.timeout, self.retries, self.patience, self.pause)
        return url, poll, time.time(), body, error


class JsonPoll(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_poll"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Once(_Settings(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(_Settings(self.options))


class _Once(DataSourceReader):
    """One partition per URL: the executors poll side by side."""

    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.settings.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield self.settings.row(partition.value, 0)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, settings: _Settings):
        self.settings, self.read_rows = settings, {}
        if settings.log:
            os.makedirs(settings.log, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def _logged(self, n: int) -> list[tuple] | None:
        """The answers of a poll from the log, or None."""
        try:
            with open(f"{self.settings.log}/{n:012d}.json", encoding="utf-8") as f:
                return [tuple(r) for r in json.load(f)]
        except FileNotFoundError:
            return None

    def _keep(self, n: int, rows: list[tuple]) -> None:
        path = f"{self.settings.log}/{n:012d}.json"
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(rows, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.part", path)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["poll"]
        rows = self._logged(n) if self.settings.log else None
        if rows is None:
            rows = [self.settings.row(u, n) for u in self.settings.urls]
            if self.settings.log:
                self._keep(n, rows)
        if not self.settings.log:
            self.read_rows[n] = rows
        return iter(rows), {"poll": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """What was polled before, from the log or, within one run, from memory."""
        known = self._logged if self.settings.log else self.read_rows.get
        return iter([r for n in range(start["poll"], end["poll"]) for r in known(n) or []])

    def commit(self, end: dict) -> None:
        self.read_rows = {n: r for n, r in self.read_rows.items() if n >= end["poll"]}
        for name in os.listdir(self.settings.log) if self.settings.log else ():
            if name.endswith(".json") and int(name[:-5]) < end["poll"]:
                os.unlink(f"{self.settings.log}/{name}")
