"""Session logs as a stream of appended lines: against a scan of everything, with bytes and rows counted."""

import json
import os
import random

from pyspark.sql import functions as F

from usagelake.sources import files, tail
from usagelake.streaming import logs


def usage(n, **more):
    return json.dumps({"timestamp": f"t{n}", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "output_tokens": n // 2}} | more}})


def context(model):
    return json.dumps({"type": "turn_context", "payload": {"model": model}})


def follow(spark, home, root, size=None):
    q = logs.start(spark, str(home), str(root), str(root) + "-checkpoint", every=None, size=size)
    q.awaitTermination(180)
    assert q.exception() is None


def rows(df):
    return sorted(map(str, df.select("event_id", "session_id", "checked_at", "model", "tier", "input", "cached", "cache_write", "output", "index").collect()))


def same(spark, home, root):
    got = rows(logs.events(spark, str(root)))
    assert got == rows(files.token_events(files.session_files(spark, str(home))))
    return got


def test_every_change_gives_what_a_scan_of_everything_gives(spark, tmp_path):
    home, root = tmp_path / "home", tmp_path / "root"
    (home / "sessions/2030").mkdir(parents=True)
    (home / "archived_sessions").mkdir()
    a, b, c = home / "sessions/2030/a.jsonl", home / "sessions/b.jsonl", home / "archived_sessions/c.jsonl"
    line = lambda *x: "".join(f"{y}\n" for y in x)
    a.write_text(line(context("m/one"), usage(10), usage(30)))
    b.write_text(line(usage(5)) + usage(9)[:40])  # a last line that is not finished
    c.write_bytes(b"\xff\xfe token_count\n" + line(usage(7)).replace("\n", "\r\n").encode())
    step = lambda: (follow(spark, home, root, 100), same(spark, home, root))[1]  # noqa: E731  ranges of 100 bytes cut most lines
    assert len(step()) == 4
    with b.open("a") as f:
        f.write(usage(9)[40:] + "\n" + line(json.dumps({"type": "session_meta", "payload": {"id": "S"}})))
    assert {r.session_id for r in (step(), logs.events(spark, str(root)))[1].collect()} == {"a", "S", "c"}  # a name that came late
    with a.open("a") as f:
        f.write(line(usage(31, model="two"), usage(25), json.dumps({"type": "event_msg", "payload": {"type": "thread_settings_applied", "x": "y" * 500}}), usage(60)))
    assert len(step()) == 7
    old = os.stat(c)
    other = tmp_path / "other"
    other.write_bytes(c.read_bytes().replace(b"7", b"8"))
    os.utime(other, ns=(old.st_atime_ns, old.st_mtime_ns))
    os.replace(other, c)  # another file of equal size and time
    assert any("input=8" in x for x in step())
    a.write_text(line(usage(3)))  # cut
    b.unlink()
    assert len(step()) == 2
    a.write_text(line(usage(4)) * 9)  # longer, but not appended: its first bytes are others
    b.write_text(line(usage(1)))
    step()
    n = len(os.listdir(root / "ledger"))
    step()
    assert len(os.listdir(root / "ledger")) == n  # nothing changed: no batch


def test_a_poll_reads_and_writes_only_what_was_appended(spark, tmp_path):
    home, root = tmp_path / "home", tmp_path / "root"
    (home / "sessions").mkdir(parents=True)
    rng = random.Random(2)
    for i in range(1000):
        (home / f"sessions/{i:04d}.jsonl").write_text("".join(usage(10 * k) + "\n" for k in range(1, rng.randrange(2, 30))))
    follow(spark, home, root)
    before = tail.listing(str(home), {})
    appended = 0
    for i in range(1000):
        with (home / f"sessions/{i:04d}.jsonl").open("a") as f:
            appended += f.write(usage(1000) + "\n")
    reader = tail.Reader(str(home), str(root / "listings"), tail.RANGE)
    start = {"version": reader._last()}
    ranges = [r for p in reader.partitions(start, reader.latestOffset()) for r in p.ranges]
    assert len(ranges) == 1000 and sum(end - begin for *_, begin, end in ranges) == appended
    follow(spark, home, root)
    last = sorted(os.listdir(root / "rows"))[-1]
    new = spark.read.parquet(str(root / "rows" / last))
    assert new.count() == 1000 and new.where("kind = 'event'").count() == 1000 and new.agg(F.sum("input")).first()[0] > 0
    same(spark, home, root)
    assert len(before) == 1000 and len(os.listdir(root / "listings")) <= 2


def test_a_line_belongs_to_the_range_that_holds_its_end(tmp_path):
    rng = random.Random(5)
    data = b"".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 5, 40]))) + rng.choice([b"\n", b"\r\n"]) for _ in range(60)) + b"open"
    path = tmp_path / "x"
    path.write_bytes(data)
    want, pos = [], 0
    for x in data.split(b"\n")[:-1]:
        want.append((pos, x.decode().rstrip("\r")))
        pos += len(x) + 1
    for size in (1, 3, 17, 1000, 10_000):
        got = [r for at in range(0, len(data), size) for r in tail.ended_lines(str(path), at, min(at + size, len(data)))]
        assert got == want
