"""The service's streams: one poll for all histories, commits, restarts, expiry, and timers of inactive accounts."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from usagelake.sources import markers
from usagelake.sources.poll import JsonPoll
from usagelake.streaming import live, service


def served(answer):
    """A server on a free port whose bodies are answer(path, request number), and the list of its requests."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.time(), self.path))
            body = json.dumps(answer(self.path, len(asked) - 1)).encode()
            self.send_response(500 if body == b"null" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, asked, f"http://127.0.0.1:{server.server_port}"


def sample(i, percent, cost, account="a", reset=4_000_000_000, **more):
    w = {"5h": {"used_percent": percent, "plan": "plus", "reset": reset}}
    return {"account_id": account, "seq": i, "checked_at": f"2030-01-01T00:{i:02d}:00Z", "windows": json.dumps(w), "cost": cost, "cost_ready": True, "identity": "x", **more}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("\n".join(map(json.dumps, rows)))
    at = time.time() - 1000 + len(list(folder.iterdir()))  # the file source reads by age
    os.utime(folder / f".{name}", (at, at))
    (folder / f".{name}").rename(folder / f"{name}.json")


def source(spark, folder):
    return spark.readStream.schema(live.SAMPLE).option("maxFilesPerTrigger", 1).json(str(folder))


def run(spark, folder, root, **more):
    q = service.start(source(spark, folder), str(root), str(root) + "-checkpoint", every=None, **more)
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def rows(spark, root, kind="event"):
    return sorted((tuple(r) for r in service.read(spark, str(root), kind).collect()), key=str)


def test_one_poll_is_one_request_for_all_histories(spark, tmp_path):
    server, asked, url = served(lambda _, n: {"account_id": "a", "windows": {"5h": {"used_percent": 3.0 if n == 2 else 10.0 + n, "plan": "plus", "reset": 4_000_000_000 + 1000 * (n == 2)}}, "cost": float(n), "identity": "x"})
    spark.dataSource.register(JsonPoll)
    polls = spark.readStream.format("json_poll").option("url", url).load()
    told = []
    q = service.start(service.samples_of(polls), str(tmp_path / "s"), str(tmp_path / "c"), every="1 second", sinks={"console": lambda df, name: told.append((name, df.count()))})
    try:
        end = time.time() + 90
        while len(service.committed(spark, str(tmp_path / "s"))) < 5 and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
        server.shutdown()
    logged, quota = service.read(spark, str(tmp_path / "s"), "sample"), service.read(spark, str(tmp_path / "s"), "quota")
    n = logged.count()
    assert n >= 4 and len(asked) - n in (0, 1, 2) and quota.count() == n  # a poll that was not committed when the query ended
    assert [r.admitted for r in quota.orderBy("seq").limit(4).collect()] == [True, True, False, True]  # a share that fell with a reset that moved, before its reset
    special = service.read(spark, str(tmp_path / "s"), "special")
    assert special.where("detail = 'bad-remote-usage-discarded'").count() == 1 and special.where("detail = 'baseline-initialized'").count() == 1
    events = service.read(spark, str(tmp_path / "s"), "event")
    assert events.where("delta_percent > 0 and delta_cost > 0").count() == events.count() == n - 2
    assert len({name for name, _ in told}) == len(told) >= n


def test_a_killed_batch_leaves_nothing_and_repeats_exactly(spark, tmp_path, monkeypatch):
    for i in range(4):
        put(tmp_path / "in", f"s{i}", [sample(i, 5.0 + i, float(i))])
    run(spark, tmp_path / "in", tmp_path / "whole")
    real, calls = markers.create, []

    def killed(s, path, text):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("killed before the commit")
        return real(s, path, text)

    monkeypatch.setattr(markers, "create", killed)
    q = service.start(source(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), every=None)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(180)
    assert len(service.committed(spark, str(tmp_path / "s"))) == 2 and len(markers.names(spark, str(tmp_path / "s/rows"))) == 3
    assert len(rows(spark, tmp_path / "s", "sample")) == 2
    service.start(source(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), every=None).awaitTermination(180)
    for kind in ("event", "interval", "special", "quota", "sample"):
        assert rows(spark, tmp_path / "s", kind) == rows(spark, tmp_path / "whole", kind)


def test_restart_equals_an_unbroken_run_but_for_baselines(spark, tmp_path):
    first, more = [sample(i, 5.0 + i, float(i)) for i in range(4)], [sample(i, 6.0 + i, 2.0 * i) for i in range(4, 8)]
    put(tmp_path / "in", "a", first)
    run(spark, tmp_path / "in", tmp_path / "s")
    put(tmp_path / "in", "b", more)
    run(spark, tmp_path / "in", tmp_path / "s", restart=True)
    put(tmp_path / "all", "a", first)
    put(tmp_path / "all", "b", more)
    run(spark, tmp_path / "all", tmp_path / "u")
    key = lambda root: {(r.seq, r.model): r for r in service.read(spark, str(root), "event").collect()}
    broken, whole = key(tmp_path / "s"), key(tmp_path / "u")
    assert whole.keys() - broken.keys() == {(4, "gpt-5.5")}  # the first sample after the restart is a baseline
    lost = whole[4, "gpt-5.5"]
    for k, r in broken.items():
        assert (r.delta_percent, r.delta_cost) == (whole[k].delta_percent, whole[k].delta_cost)
        if r.seq > 4:
            assert abs(r.cumulative_percent + lost.delta_percent - whole[k].cumulative_percent) < 1e-9 and r.average_ratio is not None
    special = [r.detail for r in service.read(spark, str(tmp_path / "s"), "special").orderBy("seq").collect()]
    assert special == ["baseline-initialized", "baseline-initialized"]
    assert len(rows(spark, tmp_path / "s", "sample")) == 8  # what the second run saw again gave nothing
    run(spark, tmp_path / "in", tmp_path / "s")
    assert len(rows(spark, tmp_path / "s", "sample")) == 8


def test_compaction_and_retention(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "in", f"s{i}", [sample(i, 5.0 + i, float(i))])
    run(spark, tmp_path / "in", tmp_path / "s")
    root = str(tmp_path / "s")
    before = rows(spark, root, "quota")
    service.compact(spark, root)
    assert rows(spark, root, "quota") == before and len(markers.names(spark, f"{root}/rows")) == 1
    assert service.is_committed(spark, root, "000000-000000000001") and not service.is_committed(spark, root, "000000-000000000009")
    put(tmp_path / "in", "s9", [sample(9, 9.0, 9.0)])
    run(spark, tmp_path / "in", root)
    assert len(rows(spark, root, "quota")) == 4 and len(rows(spark, root, "event")) == 3
    service.compact(spark, root, F.timestamp_seconds(F.lit(1893456000 + 90)))
    assert [r[1] for r in rows(spark, root, "quota")] == [2, 9]
    assert service.compact(spark, str(tmp_path / "none")) is None and rows(spark, tmp_path / "none") == []


def test_an_idle_account_expires_and_starts_anew(spark, tmp_path):
    put(tmp_path / "in", "a", [sample(0, 5.0, 0.0), sample(1, 6.0, 1.0)])
    q = service.start(source(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), every="500 milliseconds", retain_days=15 / 86_400)
    seen = lambda n: len(rows(spark, tmp_path / "s", "sample")) >= n
    try:
        for n, (name, row) in enumerate((("b", sample(2, 7.0, 2.0)), ("c", sample(3, 8.0, 3.0)))):
            end = time.time() + 60
            while not seen(2 + n) and time.time() < end:
                time.sleep(0.3)
            time.sleep(20 if name == "c" else 0)
            put(tmp_path / "in", name, [row])
        end = time.time() + 60
        while not seen(4) and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert [r.seq for r in service.read(spark, str(tmp_path / "s"), "special").where("detail = 'baseline-initialized'").orderBy("seq").collect()] == [0, 3]
    assert [r[1] for r in rows(spark, tmp_path / "s", "event")] == [1, 2]


def test_inactive_accounts_fall_due_at_times_of_their_own(spark, tmp_path):
    server, asked, url = served(lambda path, _: None if path == "/bad" else {"windows": {"5h": {"used_percent": 7.0, "plan": "plus", "reset": 9}}})
    account = lambda name, seq, active=False, ready=True: {"account_id": name, "seq": seq, "label": name.upper(), "active": active, "ready": ready}
    put(tmp_path / "in", "0", [account("a", 0), account("on", 0, active=True), account("bad", 0), account("out", 0, ready=False)])
    accounts = spark.readStream.schema("account_id string, seq long, label string, active boolean, ready boolean").json(str(tmp_path / "in"))

    def windows(polled):
        w = F.explode(F.from_json(F.get_json_object("body", "$.windows"), "map<string,struct<used_percent:double,reset:double,plan:string>>")).alias("window", "w")
        return polled.select("account_id", "checked_at", w).select("account_id", "checked_at", "window", "w.*")

    q = service.start_inactive(accounts, F.concat(F.lit(f"{url}/"), "account_id"), windows, str(tmp_path / "s"), str(tmp_path / "c"), every_s=4, trigger="500 milliseconds", retries=0, pause=0)
    times = lambda name: [t for t, path in asked if path == f"/{name}"]
    try:
        end = time.time() + 60
        while not times("a") and time.time() < end:
            time.sleep(0.2)
        time.sleep(2)
        put(tmp_path / "in", "1", [account("b", 0)])
        while len(times("a")) < 3 or len(times("b")) < 2:
            assert time.time() < end + 60
            time.sleep(0.2)
        put(tmp_path / "in", "2", [account("a", 1, active=True)])
        time.sleep(3)
        n = len(times("a"))
        time.sleep(6)
        assert len(times("a")) == n  # an account in use is not polled here
    finally:
        q.stop()
        server.shutdown()
    for name in ("a", "b"):
        assert len(times(name)) >= 2
    assert not times("on") and not times("out") and times("bad")
    got = service.inactive_readings(spark, str(tmp_path / "s"))
    assert {(r.account_id, r.window, r.used_percent) for r in got.collect()} == {("a", "5h", 7.0), ("b", "5h", 7.0)}
    polls = spark.read.parquet(str(tmp_path / "s/inactive-polls"))
    assert {r.error for r in polls.where("account_id = 'bad'").collect()} == {"HTTP 500"}
    due = sorted((r.account_id, r.due_ms) for r in polls.where("account_id in ('a', 'b')").collect())
    assert all(y[1] - x[1] >= 4000 for x, y in zip(due, due[1:]) if x[0] == y[0])
    assert not {r[1] // 1000 for r in due if r[0] == "a"} & {r[1] // 1000 for r in due if r[0] == "b"} or len(due) > 6


def test_a_poll_outlives_a_restart_and_is_not_asked_for_again(spark, tmp_path):
    server, asked, url = served(lambda _, n: {"n": n})
    spark.dataSource.register(JsonPoll)
    got: list[tuple[int, int]] = []

    def begin(fail):
        def write(df, batch):
            rows = [json.loads(r.body)["n"] for r in df.collect()]
            if fail and batch == 1:
                raise OSError("killed between the poll and its commit")
            got.extend((batch, n) for n in rows)

        polls = spark.readStream.format("json_poll").option("url", url).option("log", str(tmp_path / "log")).load()
        return polls.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    try:
        with pytest.raises(Exception, match="killed"):
            begin(True).awaitTermination(120)
        n = len(asked)
        q = begin(False)
        end = time.time() + 90
        while len(got) < 4 and time.time() < end:
            time.sleep(0.3)
        q.stop()
    finally:
        server.shutdown()
    assert n >= 2 and got[:4] == [(0, 0), (1, 1), (2, 2), (3, 3)]  # the interrupted poll's own answer, and none twice
    assert len(asked) - len(got) in (0, 1, 2)
    assert all(int(x.name[:-5]) >= len(got) - 2 for x in (tmp_path / "log").glob("*.json"))
