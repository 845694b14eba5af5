"""Session logs that grow: only bytes that were appended are read.

A Spark file source takes a file for immutable and reads it whole, so growth is found by comparing listings, and tasks read byte
ranges of the files themselves. That needs a file system that all executors mount; on another kind of store the logs are scanned whole.
An unchanged file is not opened; of a grown one the bytes after the last whole line are read, if those before them are still the
same; a cut, replaced or rewritten one is read from its start; events of a deleted file go. Lines that matter are stored, so that
no byte is read twice but an unfinished last line. Since a file's events depend on that file alone, the result equals a scan of
everything.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.sources.files import session_files, sifted, token_events

RANGE = 64 * 2**20  # bytes of a file that one task reads
GUARD = 1024  # bytes before the offset that must be the same for what follows to count as appended
FILES = "path string, size long, modified timestamp, offset long, guard string, since int"


def listing(spark: SparkSession, home: str) -> DataFrame:
    """(path, size, modified) of the session files, from the listing: contents are not read."""
    out = None
    for folder, deep in (("sessions", "true"), ("archived_sessions", "false")):
        try:
            df = spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", "*.jsonl").load(f"{home}/{folder}")
        except AnalysisException:
            continue
        df = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "path string, size long, modified timestamp")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


def _guard(path: str, offset: int) -> str:
    """A hash of the bytes before an offset."""
    with open(_local(path), "rb") as f:
        f.seek(max(0, offset - GUARD))
        return hashlib.sha256(f.read(min(GUARD, offset))).hexdigest()


def starts(changed: DataFrame) -> DataFrame:
    """changed(path, size, offset, guard) with start: where to read from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [guard is not None and offset < size and _guard(path, int(offset)) == guard for path, size, offset, guard in zip(b["path"], b["size"], b["offset"], b["guard"])]
            yield pd.DataFrame({"path": b["path"], "size": b["size"], "start": [int(o) if k else 0 for o, k in zip(b["offset"], kept)]})

    return changed.select("path", "size", F.coalesce("offset", F.lit(0)).alias("offset"), "guard").mapInPandas(run, "path string, size long, start long")


def tail(files: DataFrame) -> DataFrame:
    """(path, pos, text): the lines of files(path, size, start) that begin from start on, with their places in bytes, in ranges that
    tasks share; and rows without text, the least pos of which per file is where the next reading begins. Lines that are not UTF-8 go."""
    begin = F.explode(F.sequence("start", F.greatest(F.col("start"), F.col("size") - 1), F.lit(RANGE))).alias("begin")

    def lines(path: str, size: int, start: int, begin: int) -> Iterator[tuple]:
        end = min(begin + RANGE, size)
        with open(_local(path), "rb") as f:
            if begin > start:
                f.seek(begin - 1)
                f.readline()
            else:
                f.seek(begin)
            pos, rest = f.tell(), None
            while pos < end and (line := f.readline(size - pos)):
                whole = line.endswith((b"\n", b"\r"))
                try:
                    text = line.decode().rstrip("\r\n")
                    if not whole:
                        json.loads(text)
                except ValueError:
                    text = None
                if text is not None:
                    yield path, pos, text
                if not whole:
                    rest = pos
                pos += len(line)
            if rest is not None or end == size:
                yield path, size if rest is None else rest, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                for x in lines(row.path, int(row.size), int(row.start), int(row.begin)):
                    out.append(x)
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["path", "pos", "text"])
                        out = []
            yield pd.DataFrame(out, columns=["path", "pos", "text"])

    return files.select("path", "size", "start", begin).repartition("path", "begin").mapInPandas(run, "path string, pos long, text string")


def refresh(spark: SparkSession, home: str, store: str, version: int) -> DataFrame:
    """Bring the stored events up to date; `version` counts refreshes from 0. Returns all token events.

    Each refresh writes a version of its own (the new lines, the state of the files, the events) before the old one loses its use, so
    one that fails can be run again.
    """
    at = f"{store}/v{version}"
    if ":" in home and not home.startswith("file:"):
        token_events(session_files(spark, home)).write.mode("overwrite").parquet(f"{at}/events")
        return spark.read.parquet(f"{at}/events")
    old = (_stored(spark, f"{store}/v{version - 1}/files") if version else None) or spark.createDataFrame([], FILES)
    was = old.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"), "offset", "guard", "since")
    now = listing(spark, home).join(was, "path", "left").withColumn("same", F.coalesce((F.col("size") == F.col("_s")) & (F.col("modified") == F.col("_m")), F.lit(False)))
    now.write.mode("overwrite").parquet(f"{at}/listing")
    now = spark.read.parquet(f"{at}/listing")
    grown = F.when(F.col("size") > F.col("_s"), F.col("guard"))
    starts(now.where("not same").withColumn("guard", grown)).write.mode("overwrite").parquet(f"{at}/starts")
    start = spark.read.parquet(f"{at}/starts")
    marks, event = sifted(F.col("text"))
    tail(start.where("size > 0")).where(F.col("text").isNull() | marks | event).write.mode("overwrite").parquet(f"{at}/lines")
    fresh = spark.read.parquet(f"{at}/lines")

    hashed = F.udf(_guard, "string")
    ends = fresh.where("text is null").groupBy("path").agg(F.min("pos").alias("offset"))
    read = now.select("path", "size", "modified", "since").join(start.select("path", "start"), "path").join(ends, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
    read = read.select("path", "size", "modified", "offset", F.when(F.col("offset") > 0, hashed("path", "offset")).alias("guard"), F.when(F.col("start") > 0, F.col("since")).otherwise(version).alias("since"))
    now.where("same").select(*read.columns).unionByName(read).write.mode("overwrite").parquet(f"{at}/files")
    files = spark.read.parquet(f"{at}/files")

    every = None
    for v in range(version + 1):  # a version holds what one refresh read; a rewritten file counts from its last start
        if (part := _stored(spark, f"{store}/v{v}/lines")) is not None:
            part = part.withColumn("v", F.lit(v))
            every = part if every is None else every.unionByName(part)
    changed = files.join(start.select("path"), "path", "left_semi").select("path", "since")
    valid = every.where("text is not null").join(changed, "path").where("v >= since")
    valid = valid.withColumn("_n", F.row_number().over(Window.partitionBy("path", "pos").orderBy(F.desc("v")))).where("_n = 1")
    events = token_events(valid.select(F.col("path").alias("file"), F.struct(F.col("pos").alias("block"), F.lit(0).cast("long").alias("row")).alias("line"), "text"))
    before = _stored(spark, f"{store}/v{version - 1}/events") if version else None
    if before is not None:
        events = before.join(now.where("same").select(F.col("path").alias("file")), "file", "left_semi").unionByName(events)
    events.write.mode("overwrite").parquet(f"{at}/events")
    return spark.read.parquet(f"{at}/events")
