"""The service as streams: one poll is one micro-batch of one query that feeds every history, and inactive accounts are polled by timers.

`machine` is the live machine as a `transformWithState` operator: an account's state lives in a value that can expire, starts from what the
ledger of an earlier run holds, and each sample gives all rows that any history takes. `start` writes a micro-batch's rows in one action and
then commits them under the batch's name; readers see committed batches only, so a batch that was killed half-way leaves nothing, and one
that is run again replaces what it wrote. `due_polls` holds a timer for each inactive account.

Both need the RocksDB state store, which they set for the queries that they start.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from usagelake.dims import WINDOWS
from usagelake.operators.deltas import last_cumulative
from usagelake.sources import markers
from usagelake.sources.poll import fetch
from usagelake.streaming import live

NAMES = [f.split()[0] for f in live.OUT.split(", ")]
READING = "used_percent double, reset double, plan string, admitted boolean"
POLL_EVERY_S = 600


def rocks(spark: SparkSession) -> None:
    """State stores that hold values, timers and expiry: for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _row(sample, window: str | None, kind: str, detail: dict) -> tuple:
    return (sample.account_id, sample.seq, sample.checked_at, window, kind, *[None] * 7, json.dumps(detail), None)


def rows_of(state: dict, sample) -> list[tuple]:
    """All that a sample gives: the live machine's events, intervals and special events, a reading for each window, and a row of the
    sample log. A reading that the machine did not admit is kept, as the quota history shows what was said, but is marked."""
    out = live.transition(state, sample)
    admitted = not any(r[4] == "special" and r[12] == "bad-remote-usage-discarded" for r in out)
    windows = json.loads(sample.windows or "{}")
    readings = []
    for label in WINDOWS:
        w = windows.get(label) or {}
        if w.get("used_percent") is not None and not w.get("unavailable"):
            readings.append(_row(sample, label, "quota", {"used_percent": float(w["used_percent"]), "reset": w.get("reset"), "plan": w.get("plan") or "unknown", "admitted": admitted}))
    told = [{"window": r[3], "model": r[5], "delta_percent": round(r[6], 8), "delta_cost": round(r[7], 8)} for r in out if r[4] == "event"]
    kept = {label: {k: v for k, v in (state.get(label) or {}).items() if k in ("percent", "reset", "sum")} for label in WINDOWS}
    return [*out, *readings, _row(sample, None, "sample", {"windows": windows, "cost": None if pd.isna(sample.cost) else float(sample.cost), "events": told, "state": kept, "admitted": admitted})]


def samples_of(polls: DataFrame) -> DataFrame:
    """live.SAMPLE rows of polls(url, poll, checked_at, body, error) whose bodies hold account_id, windows, cost, cost_by_model, identity and
    confirmed. Their order is the time of the poll, which goes on over restarts; polls without a body give none."""
    get = lambda p: F.get_json_object("body", f"$.{p}")
    at = F.timestamp_seconds("checked_at")
    return polls.where("body is not null").select(get("account_id").alias("account_id"), (F.col("checked_at") * 1_000_000).cast("long").alias("seq"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("checked_at"), get("windows").alias("windows"),
                                                 get("cost").cast("double").alias("cost"), get("cost_by_model").alias("cost_by_model"), F.coalesce(get("cost_ready").cast("boolean"), F.lit(True)).alias("cost_ready"), get("identity").alias("identity"), get("confirmed").alias("confirmed"))


class Accounts(StatefulProcessor):
    """An account's live state as one JSON text; with `retain_ms` it expires after so long without a sample."""

    def __init__(self, retain_ms: int | None = None):
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "state string", self.retain_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState["state"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {}
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.seq > held.get("_seq", -1):  # a sample delivered again changes nothing
                out += rows_of(held, r)
                held["_seq"] = int(r.seq)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=NAMES)


def machine(samples: DataFrame, initial: DataFrame | None = None, retain_days: float | None = None) -> DataFrame:
    """A streaming DataFrame of live.SAMPLE rows to one of live.OUT rows of the kinds event, interval, special, quota and sample."""
    rocks(samples.sparkSession)
    keyed = initial.groupBy("account_id") if initial is not None else None
    return samples.groupBy("account_id").transformWithStateInPandas(Accounts(int(retain_days * 86_400_000) if retain_days else None), live.OUT, "Append", "ProcessingTime" if retain_days else "None", keyed)


def committed(spark: SparkSession, root: str) -> list[str]:
    """The commits that count: the newest compaction and those after it. A compaction is named by the last commit that it holds."""
    found = markers.names(spark, f"{root}/ledger")
    base = max((n for n in found if n.endswith("-c")), default=None)
    return [n for n in found if base is None or n == base or n.split("-c")[0] > base.split("-c")[0]]


def is_committed(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a batch was committed, by itself or as part of a compaction: batches of a run are committed in order."""
    return name <= max((n.split("-c")[0] for n in committed(spark, root)), default="")


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The committed rows of a kind; those of quota with their readings as columns."""
    paths = [f"{root}/rows/commit={n}" for n in committed(spark, root)]
    rows = spark.read.schema(live.OUT).option("basePath", f"{root}/rows").parquet(*paths).where(F.col("kind") == kind) if paths else spark.createDataFrame([], live.OUT)
    if kind != "quota":
        return rows.select(*NAMES)
    return rows.select("account_id", "seq", "checked_at", "window", F.from_json("detail", READING).alias("r")).select("account_id", "seq", "checked_at", "window", "r.*")


def initial_states(spark: SparkSession, root: str) -> DataFrame | None:
    """(account_id, state) to start anew from: cumulative sums of the committed events by window and by model, and the last sample seen;
    baselines go, as what was spent while nothing ran belongs to no event. None without a commit."""
    if not committed(spark, root):
        return None
    events, samples = read(spark, root, "event"), read(spark, root, "sample")
    order = F.struct("seq", "cumulative_percent")
    window = last_cumulative(events, ["account_id", "window"], order).select("account_id", "window", F.array("cumulative_percent", "cumulative_cost").alias("sum"))
    model = events.groupBy("account_id", "window", "model").agg(F.array(F.sum("delta_percent"), F.sum("delta_cost")).alias("m")).groupBy("account_id", "window").agg(F.map_from_entries(F.collect_list(F.struct("model", "m"))).alias("by_model"))
    both = window.join(model, ["account_id", "window"]).groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("sum", "by_model")))).alias("w"))
    last = samples.groupBy("account_id").agg(F.max("seq").alias("_seq"))
    state = F.to_json(F.struct("_seq", *(F.col("w")[label].alias(label) for label in WINDOWS)))
    return last.join(both, "account_id", "left").select("account_id", state.alias("state"))


def start(samples: DataFrame, root: str, checkpoint: str, every: str | None = "90 seconds", retain_days: float | None = None, restart: bool = False, sinks: dict[str, Callable[[DataFrame, str], None]] | None = None) -> StreamingQuery:
    """Start the service's query. A trigger is a poll; every=None takes what there is and ends.

    restart begins a run of its own, from the ledger's sums instead of the last run's state; otherwise the last run goes on from its
    checkpoint. sinks are called with a batch's written rows and its name before it is committed, and again if it is run again.
    """
    spark = samples.sparkSession
    runs = [int(n[:6]) for n in markers.names(spark, f"{root}/ledger")]
    last = max(runs, default=0)
    run = last + 1 if restart and runs else last
    initial = initial_states(spark, root) if run > last else None

    def commit(rows: DataFrame, batch: int) -> None:
        name = f"{run:06d}-{batch:012d}"
        if is_committed(spark, root, name):
            return
        at = f"{root}/rows/commit={name}"
        rows.write.mode("overwrite").parquet(at)
        for sink in (sinks or {}).values():
            sink(spark.read.schema(live.OUT).parquet(at), name)
        markers.create(spark, f"{root}/ledger/{name}", "")

    w = machine(samples, initial, retain_days).writeStream.foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/run={run}")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def compact(spark: SparkSession, root: str, oldest: Column | None = None) -> str | None:
    """Write all committed rows, but those checked before `oldest`, as one commit, and delete what it replaces. The new commit counts
    before anything goes; run it between polls, as readers of the replaced files lose them."""
    now, every = committed(spark, root), markers.names(spark, f"{root}/ledger")
    if not now:
        return None
    rows = spark.read.schema(live.OUT).parquet(*(f"{root}/rows/commit={n}" for n in now))
    if oldest is not None:
        at = F.try_to_timestamp("checked_at")
        rows = rows.where(at.isNull() | (at >= oldest))
    name = f"{now[-1]}-c"
    rows.write.mode("overwrite").parquet(f"{root}/rows/commit={name}")
    markers.create(spark, f"{root}/ledger/{name}", "")
    markers.delete(spark, *(f"{root}/ledger/{n}" for n in every), *(f"{root}/rows/commit={n}" for n in every))
    return name


# -- polls of inactive accounts --------------------------------------------------------------------------------------------------------------

DUE = "account_id string, label string, due_ms long"


class Inactive(StatefulProcessor):
    """One timer for each account that is inactive and ready: `every_ms` after its last poll began, or at once."""

    def __init__(self, every_ms: int):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "label string, waits boolean, began_ms long")

    def _begin(self, key, label: str, now: int) -> pd.DataFrame:
        self.account.update((label, True, now))
        self.handle.registerTimer(now + self.every_ms)
        return pd.DataFrame([(key[0], label, now)], columns=["account_id", "label", "due_ms"])

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("seq", kind="stable").iloc[-1]
        waits, now = bool(last["ready"]) and not bool(last["active"]), self._now(timerValues)
        _, _, began = self.account.get() if self.account.exists() else (None, False, None)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = now if began is None else began + self.every_ms
        if waits and due <= now:
            yield self._begin(key, last["label"], now)
            return
        self.account.update((last["label"], waits, began))
        if waits:
            self.handle.registerTimer(due)
        yield pd.DataFrame([], columns=["account_id", "label", "due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        label, waits, _ = self.account.get()
        yield self._begin(key, label, self._now(timerValues)) if waits else pd.DataFrame([], columns=["account_id", "label", "due_ms"])


def due_polls(accounts: DataFrame, every_s: float = POLL_EVERY_S) -> DataFrame:
    """accounts(account_id, seq, label, active, ready), streaming: a row says what an account is from then on. A streaming DataFrame of the
    polls that fall due, each account by its own time: at once when it becomes inactive and ready, then every `every_s` seconds, and not
    sooner after a spell of activity."""
    rocks(accounts.sparkSession)
    return accounts.groupBy("account_id").transformWithStateInPandas(Inactive(int(every_s * 1000)), DUE, "Append", "ProcessingTime")


def polled(due: DataFrame, url: Column, timeout: float = 10, retries: int = 2, patience: float = 60, pause: float = 1) -> DataFrame:
    """due with checked_at, body and error: what each account's endpoint answers. Executors poll side by side; an account whose poll
    fails has an error and no body, and no other is touched."""
    asked = due.select("*", url.alias("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fetch(u, {}, timeout, retries, patience, pause) for u in b["url"]]
            yield b.assign(checked_at=pd.Timestamp.now("UTC").tz_localize(None).isoformat(), body=[x[0] for x in got], error=[x[1] for x in got])

    schema = ", ".join(f"{n} {t}" for n, t in asked.dtypes)
    return asked.mapInPandas(run, f"{schema}, checked_at string, body string, error string")


def start_inactive(accounts: DataFrame, url: Column, windows: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, every_s: float = POLL_EVERY_S, trigger: str = "1 second", **settings) -> StreamingQuery:
    """Poll inactive accounts as they fall due: their readings go to the quota history and nothing else does. windows makes readings
    (account_id, checked_at, window, used_percent, reset, plan) of polled rows. A batch is polled once: what was answered is written before
    it is read, so a batch that is run again finds its answers there."""
    spark = accounts.sparkSession

    def commit(due: DataFrame, batch: int) -> None:
        name = f"{batch:012d}"
        if name in markers.names(spark, f"{root}/inactive-ledger"):
            return
        at = f"{root}/inactive-polls/batch={name}"
        if not markers.exists(spark, f"{at}/_SUCCESS"):
            polled(due, url, **settings).write.mode("overwrite").parquet(at)
        answers = spark.read.parquet(at)
        windows(answers.where("body is not null")).write.mode("overwrite").parquet(f"{root}/inactive-quota/batch={name}")
        markers.create(spark, f"{root}/inactive-ledger/{name}", "")

    return due_polls(accounts, every_s).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def inactive_readings(spark: SparkSession, root: str) -> DataFrame:
    """The committed readings of inactive accounts."""
    paths = [f"{root}/inactive-quota/batch={n}" for n in markers.names(spark, f"{root}/inactive-ledger")]
    schema = "account_id string, checked_at string, window string, used_percent double, reset double, plan string"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
