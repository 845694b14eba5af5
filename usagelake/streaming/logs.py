"""Token events of growing session logs as a stream: each poll reads what was appended and writes what is new.

`appended_lines` gives the lines, `log_rows` reads them as columns, and a stateful operator keyed by file holds what a file's next line
depends on: the last counters, the model and tier in force, and the number of events. Its rows go to commits of a ledger (see `service`);
what may change later, as a session's name that the file's last metadata gives, is decided when they are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from usagelake.operators.tokens import COUNTERS
from usagelake.sources import markers
from usagelake.sources.files import log_rows, named_events
from usagelake.sources.tail import AppendedLines
from usagelake.streaming.service import committed, is_committed, rocks

ROWS = "file string, generation long, pos long, kind string, checked_at string, model string, tier string, input long, cached long, cache_write long, output long, index long, sid string, carries boolean"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


class LogFile(StatefulProcessor):
    """What a log file's next line depends on, as one JSON text."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("file", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {"generation": -1}
        out: list[tuple] = []
        for r in sorted((r for b in rows for r in b.astype(object).where(b.notna(), None).itertuples(index=False)), key=lambda r: (r.generation, r.pos)):
            out += self.row(held, r)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=NAMES)

    def row(self, held: dict, r) -> list[tuple]:
        if r.generation > held["generation"]:
            held.clear()
            held |= {"generation": int(r.generation), "last": [0] * len(COUNTERS), "model": "unknown", "tier": "default", "index": 0}
        at = (r.file, r.generation, r.pos)
        none = [None] * 8
        if r.kind == "gone":
            return [(*at, "gone", *none, None, None)]
        out = []
        if r.is_meta:
            out.append((*at, "meta", *none, r.sid, r.carries))
        if r.is_edge:
            out.append((*at, "edge", *none, None, None))
        held["model"], held["tier"] = r.model or held["model"], r.tier or held["tier"]
        if not r.counts:
            return out
        now = [int(getattr(r, c) or 0) for c in COUNTERS]
        grown = dict(zip(COUNTERS, [max(0, a - b) for a, b in zip(now, held["last"])] if r.is_total else now))
        if r.is_total:
            held["last"] = now
        cached = min(grown["cached"], grown["input"])
        write = min(grown["cache_write"], grown["input"] - cached)
        if any((grown["input"], cached, write, grown["output"])):
            held["index"] += 1
            out.append((*at, "event", r.checked_at, held["model"], held["tier"], grown["input"], cached, write, grown["output"], held["index"], None, None))
        return out


def log_events(lines: DataFrame) -> DataFrame:
    """A streaming DataFrame of appended lines to one of ROWS: events, metadata, replay boundaries and files that went."""
    rocks(lines.sparkSession)
    read = log_rows(lines.where("kind = 'line'"), "generation", "pos", "kind")
    gone = lines.where("kind = 'gone'").select(*(F.col(c) if c in lines.columns else F.lit(None).cast(t).alias(c) for c, t in read.dtypes))
    return read.unionByName(gone).groupBy("file").transformWithStateInPandas(LogFile(), ROWS, "Append", "None")


def start(spark: SparkSession, home: str, root: str, checkpoint: str, every: str | None = "90 seconds", size: int | None = None) -> StreamingQuery:
    """Follow the logs of a home: each trigger commits the rows of what was appended. every=None takes what there is and ends."""
    spark.dataSource.register(AppendedLines)
    source = spark.readStream.format("appended_lines").option("home", home).option("state", f"{root}/listings")
    lines = (source.option("range", str(size)) if size else source).load()

    def commit(rows: DataFrame, batch: int) -> None:
        name = f"{batch:012d}"
        if not is_committed(spark, root, name):
            rows.write.mode("overwrite").parquet(f"{root}/rows/commit={name}")
            markers.create(spark, f"{root}/ledger/{name}", "")

    w = log_events(lines).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def events(spark: SparkSession, root: str) -> DataFrame:
    """The token events of the logs as they are now: those of files and generations that went are none."""
    paths = [f"{root}/rows/commit={n}" for n in committed(spark, root)]
    rows = spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)
    alive = rows.join(rows.where("kind = 'gone'").select("file", "generation"), ["file", "generation"], "left_anti")
    meta = alive.where("kind = 'meta'").groupBy("file").agg(F.max_by(F.struct("sid", "carries"), "pos").alias("m"))
    edge = alive.where("kind = 'edge'").groupBy("file").agg(F.max("pos").alias("boundary"))
    found = alive.where("kind = 'event'").select("file", F.col("pos").alias("line"), "checked_at", "model", "tier", *COUNTERS, "index")
    return named_events(found, meta, edge)
