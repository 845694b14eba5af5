"""Session logs as a stream of appended lines: `spark.readStream.format("appended_lines")`.

    spark.dataSource.register(AppendedLines)
    spark.readStream.format("appended_lines").option("home", ...).option("state", ...).load()

Spark's own file stream takes a file for immutable; here a trigger lists the session files, and an offset is the number of a listing kept in
the `state` folder: file -> identity, size, time, guard and generation. What lies between two listings is byte ranges, which tasks read
side by side, so a poll opens what grew and reads what was appended, however long the logs are. A file of another identity, or one that
shrank, or changed without growing, or whose bytes before the old end are not what they were, is read anew as its next generation; of a
generation that ended there is a row of kind 'gone'.

A line belongs to the range that holds its end, so one that is not finished is read when it is. Lines that are not UTF-8 are none. The
folders have to be mounted by the driver and all executors. Listings are written before their number is given out and kept until the
query has committed a later one, so a batch that is run again reads the same ranges; bytes that were meanwhile replaced are not there
any more, and the next listing says so.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, generation long, pos long, kind string, text string"
RANGE = 64 * 2**20  # bytes of a range, and of the ranges that a task reads
FILES = 1000  # ranges of a task at most
GUARD = 256  # bytes before the end that must be the same for what follows to count as appended
BLOCK = 64 * 1024


def log_files(home: str) -> Iterator[str]:
    """sessions/**/*.jsonl and archived_sessions/*.jsonl."""
    for folder, deep in (("sessions", True), ("archived_sessions", False)):
        for at, folders, names in os.walk(os.path.join(home, folder)):
            if not deep:
                folders.clear()
            yield from (os.path.join(at, n) for n in names if n.endswith(".jsonl"))


def guard(path: str, size: int) -> str:
    """A hash of the bytes before an offset."""
    with open(path, "rb") as f:
        f.seek(max(0, size - GUARD))
        return hashlib.sha256(f.read(min(GUARD, size))).hexdigest()


def listing(home: str, before: dict[str, list]) -> dict[str, list]:
    """file -> [identity, size, modified, guard, generation] now. Contents are looked at only where a file changed, and only at its ends."""
    now: dict[str, list] = {}
    last = max((x[4] for x in before.values()), default=0)
    for path in log_files(home):
        try:
            st = os.stat(path)
            identity, old = f"{st.st_dev}:{st.st_ino}", before.get(path)
            if old and old[:3] == [identity, st.st_size, st.st_mtime_ns]:
                now[path] = old
                continue
            appended = old and old[0] == identity and st.st_size > old[1] and guard(path, old[1]) == old[3]
            now[path] = [identity, st.st_size, st.st_mtime_ns, guard(path, st.st_size), old[4] if appended else last + 1]
        except FileNotFoundError:  # it went meanwhile
            continue
    return now


def ended_lines(path: str, begin: int, end: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the lines whose end lies in [begin, end)."""
    with open(path, "rb") as f:
        start = begin
        while start:  # back to the start of the line that begin is in
            at = max(0, start - BLOCK)
            f.seek(at)
            cut = f.read(start - at).rfind(b"\n")
            if cut >= 0:
                start = at + cut + 1
                break
            start = at
        f.seek(start)
        pos = start
        while pos < end:
            line = f.readline(end - pos)
            if not line.endswith(b"\n"):
                return
            try:
                yield pos, line.decode().rstrip("\r\n")
            except UnicodeDecodeError:
                pass
            pos += len(line)


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple], gone: list[tuple]):
        self.ranges, self.gone = ranges, gone


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options["home"], self.options["state"], int(self.options.get("range", RANGE)))


class Reader(DataSourceStreamReader):
    def __init__(self, home: str, state: str, size: int):
        self.home, self.state, self.size = home, state, size
        os.makedirs(state, exist_ok=True)

    def _path(self, version: int) -> str:
        return f"{self.state}/{version:012d}.json"

    def _read(self, version: int) -> dict[str, list]:
        if not version:
            return {}
        with open(self._path(version), encoding="utf-8") as f:
            return json.load(f)

    def _last(self) -> int:
        return max((int(n[:-5]) for n in os.listdir(self.state) if n.endswith(".json")), default=0)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        last = self._last()
        before = self._read(last)
        now = listing(self.home, before)
        if now == before:
            return {"version": last}
        path = self._path(last + 1)
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            json.dump(now, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{path}.part", path)
        return {"version": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, now = self._read(start["version"]), self._read(end["version"])
        gone = [(path, old[4]) for path, old in before.items() if path not in now or now[path][4] != old[4]]
        out, held, used = [], [], 0
        for path, (identity, size, _, _, generation) in sorted(now.items()):
            old = before.get(path)
            since = old[1] if old and old[4] == generation else 0
            for at in range(since, size, self.size):
                upto = min(at + self.size, size)
                if held and (used + upto - at > self.size or len(held) >= FILES):
                    out.append(Ranges(held, []))
                    held, used = [], 0
                held.append((path, identity, generation, at, upto))
                used += upto - at
        if held or gone:
            out.append(Ranges(held, gone))
        return out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, generation in partition.gone:
            yield path, generation, -1, "gone", None
        for path, identity, generation, begin, end in partition.ranges:
            try:
                st = os.stat(path)
                if f"{st.st_dev}:{st.st_ino}" == identity:
                    for pos, text in ended_lines(path, begin, end):
                        yield path, generation, pos, "line", text
            except FileNotFoundError:
                continue

    def commit(self, end: dict) -> None:
        for n in os.listdir(self.state):
            if n.endswith(".json") and int(n[:-5]) < end["version"]:
                os.unlink(f"{self.state}/{n}")
