"""Sources: session logs, JSON sequences, file manifests and packages."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.scalars import first_truthy, normalize_model, service_tier
from usagelake.operators.tokens import clamp_tokens, counter_deltas, first_by_id, carry_forward

_USAGE = "struct<" + ",".join(f"{c}:bigint" for c in ("input_tokens", "prompt_tokens", "cached_input_tokens", "cache_read_input_tokens", "cache_write_input_tokens", "cache_creation_input_tokens", "cache_write_tokens", "output_tokens", "completion_tokens")) + "," + ",".join(f"{d}:struct<cached_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint,cache_creation_tokens:bigint>" for d in ("input_tokens_details", "input_token_details", "prompt_tokens_details")) + ">"
_LINE = f"struct<timestamp:string,type:string,payload:struct<type:string,id:string,thread_id:string,session_id:string,forked_from_id:string,source:struct<subagent:string>,model:string,service_tier:string,thread_settings:struct<service_tier:string>,info:struct<model:string,model_name:string,service_tier:string,total_token_usage:{_USAGE},last_token_usage:{_USAGE}>>>"


def session_files(spark: SparkSession, home: str) -> DataFrame:
    """(file, line, text): the lines of sessions/**/*.jsonl and archived_sessions/*.jsonl; a folder that is missing has none.

    Files are read in line mode, so that a large log is split over tasks and its bytes are as they stand in the file. `line` orders the
    lines of a file: the split's first byte, then the row in its task."""
    from pyspark.errors import AnalysisException

    out = None
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    for folder, deep in (("sessions", "true"), ("archived_sessions", "false")):
        try:
            df = spark.read.option("recursiveFileLookup", deep).option("pathGlobFilter", "*.jsonl").text(f"{home}/{folder}").select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.col("value").alias("text"))
        except AnalysisException:
            continue
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "file string, line struct<block:bigint,row:bigint>, text string")


def sifted(text: Column) -> tuple[Column, Column]:
    """Whether a line may hold metadata, or an event or its context: marker words, looked for before any JSON is parsed."""
    marks = text.contains('"session_meta"') | text.contains('"thread_settings_applied"') | text.contains('"inter_agent_communication')
    return marks, text.contains('"turn_context"') | (text.contains('"event_msg"') & text.contains('"token_count"'))


def _usage(u: Column) -> dict[str, Column]:
    d = F.coalesce(u["input_tokens_details"], u["input_token_details"], u["prompt_tokens_details"])
    return {
        "input": first_truthy(u["input_tokens"], u["prompt_tokens"]),
        "cached": first_truthy(u["cached_input_tokens"], u["cache_read_input_tokens"], d["cached_tokens"], d["cache_read_tokens"]),
        "cache_write": first_truthy(u["cache_write_input_tokens"], u["cache_creation_input_tokens"], u["cache_write_tokens"], d["cache_write_tokens"], d["cache_creation_tokens"]),
        "output": first_truthy(u["output_tokens"], u["completion_tokens"]),
    }


def log_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """Log lines (file, text and the columns to keep) that matter, as columns: is_meta with sid and carries (whether the session holds
    another's history), is_edge (a replay boundary), model and tier where a line names them, and counts with is_total and the counters.

    Lines that are not UTF-8 or not whole JSON, as an unfinished last one, do not count.
    """
    marks, event = sifted(F.col("text"))
    e = lines.where((marks | event) & F.is_valid_utf8("text")).where(F.try_parse_json("text").isNotNull()).select("file", *keep, F.from_json("text", _LINE).alias("e"))
    p, i = F.col("e.payload"), F.col("e.payload.info")
    clean = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    sid = clean(p["id"], p["thread_id"], p["session_id"])
    carries = p["forked_from_id"].isNotNull() | F.coalesce(p["source"]["subagent"].isNotNull(), F.lit(False)) | F.coalesce(p["session_id"] != sid, F.lit(False))
    edge = (F.col("e.type") == "event_msg") & (p["type"] == "thread_settings_applied") | F.col("e.type").startswith("inter_agent_communication")
    counts = (F.col("e.type") == "event_msg") & (p["type"] == "token_count") & (i["total_token_usage"].isNotNull() | i["last_token_usage"].isNotNull())
    context = F.col("e.type") == "turn_context"
    model = F.when(context, clean(p["model"], i["model"])).when(counts, clean(i["model"], i["model_name"], p["model"]))
    tier = F.when(context, F.coalesce(p["thread_settings"]["service_tier"], p["service_tier"])).when(counts, F.coalesce(i["service_tier"], p["service_tier"]))
    usage = F.coalesce(i["total_token_usage"], i["last_token_usage"])
    flag = lambda c: F.coalesce(c, F.lit(False))
    return e.select("file", *keep, flag(F.col("e.type") == "session_meta").alias("is_meta"), sid.alias("sid"), carries.alias("carries"), flag(edge).alias("is_edge"), flag(counts).alias("counts"), normalize_model(model).alias("model"), F.when(tier.isNotNull(), service_tier(tier)).alias("tier"),
                    F.col("e.timestamp").alias("checked_at"), flag(i["total_token_usage"].isNotNull()).alias("is_total"), *(v.alias(k) for k, v in _usage(usage).items()))


def named_events(events: DataFrame, meta: DataFrame, edge: DataFrame) -> DataFrame:
    """Numbered events(file, line, index, ...) with the session that the file's last metadata names, or else the file, and an id of their
    own, each id once: where that session carries another's history, events before the last replay boundary go."""
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    d = events.join(meta, "file", "left").join(edge, "file", "left").where("not coalesce(m.carries, false) or boundary is null or line >= boundary")
    d = d.withColumn("session_id", F.coalesce("m.sid", stem)).withColumn("event_id", F.concat_ws(":", "session_id", "index"))
    return first_by_id(d.withColumn("_path", F.split("file", "/")), ["event_id"], ["_path", "index"]).drop("_path", "m", "boundary")


def token_events(lines: DataFrame) -> DataFrame:
    """Token events of log lines: event_id, session_id, checked_at, model, tier and tokens. See `log_rows` and `named_events`; numbers are
    given after deltas and before what a boundary cuts off."""
    from pyspark.sql import Window

    e = log_rows(lines, "line")
    meta = e.where("is_meta").groupBy("file").agg(F.max_by(F.struct("sid", "carries"), "line").alias("m"))
    edge = e.where("is_edge").groupBy("file").agg(F.max("line").alias("boundary"))
    c = e.where("counts or model is not null or tier is not null").withColumnsRenamed({"model": "_model", "tier": "_tier"})
    c = carry_forward(c, ["file"], ["line"], {"model": F.col("_model"), "tier": F.col("_tier")}, {"model": F.lit("unknown"), "tier": F.lit("default")}).where("counts")
    d = counter_deltas(c, ["file"], ["line"], ["input", "cached", "cache_write", "output"], "is_total")
    d = clamp_tokens(d.select("file", "line", "checked_at", "model", "tier", *(F.col(f"d_{k}").alias(k) for k in ("input", "cached", "cache_write", "output"))))
    return named_events(d.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("line"))), meta, edge)


# -- JSON sequences ---------------------------------------------------------------------------------------------------------------


def json_objects(text: str, strict: bool = False) -> list[str]:
    """Objects of back-to-back JSON, however they are laid out. If any part does not parse: an error if strict, else the text is
    read line by line and bad lines are skipped. What is not an object goes."""
    decode, at, out = json.JSONDecoder().raw_decode, 0, []
    try:
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            if at == len(text):
                break
            value, at = decode(text, at)
            out.append(value)
    except ValueError:
        if strict:
            raise
        out = []
        for line in text.splitlines():
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return [json.dumps(v) for v in out if isinstance(v, dict)]


def json_sequence(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file, pos, value): one row per object of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, i, v) for f, text in zip(pdf["file"], pdf["value"]) for i, v in enumerate(json_objects(text or "", strict))]
            yield pd.DataFrame(rows, columns=["file", "pos", "value"])

    return files.select("file", "value").mapInPandas(run, "file string, pos long, value string")


def sample_backfill(rows: DataFrame, value: str = "value") -> DataFrame:
    """Sample rows of a log, each the row itself or its nested `sample`."""
    return rows.withColumn(value, F.coalesce(F.get_json_object(value, "$.sample"), F.col(value)))


# -- manifests and packages -----------------------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, root: str, max_files: int = 10_000, max_bytes: int = 512 * 2**20) -> DataFrame:
    """(path, size, modified, sha256) of a tree; an error if it exceeds either limit, checked on the listing before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"the tree holds {n} files of {size} bytes")
    return files.select(F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def cached_manifest(spark: SparkSession, root: str, cache: DataFrame | None, now: float, max_age_s: float = 3600, max_files: int = 10_000, max_bytes: int = 512 * 2**20) -> DataFrame:
    """(path, size, modified, sha256, verified_at) of a tree, as `manifest`, from an earlier result: only files that are new, have another
    size or time, or were last read `max_age_s` seconds before `now` (seconds since 1970) or earlier are read. An error if one changes
    while it is read. The listing alone is looked at for all others; the paths to read are at most `max_files`."""
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = tree.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"the tree holds {n} files of {size} bytes")
    known = cache.where(F.col("verified_at") > now - max_age_s) if cache is not None else spark.createDataFrame([], "path string, size long, modified timestamp, sha256 string, verified_at double")
    kept = listed.join(known, ["path", "size", "modified"])
    stale = listed.join(kept, "path", "left_anti")
    paths = [r.path for r in stale.select("path").collect()]
    if not paths:
        return kept
    read = spark.read.format("binaryFile").load(paths).select("path", F.struct(F.col("length").alias("size"), F.col("modificationTime").alias("modified")).alias("seen"), F.sha2("content", 256).alias("sha256"))
    same = F.col("seen") == F.struct("size", "modified")
    digest = F.when(same, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("changed while it was read: "), "path")))
    return kept.unionByName(stale.join(read, "path").select("path", "size", "modified", digest.alias("sha256"), F.lit(float(now)).alias("verified_at")))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files to read again: new ones and those of another size or time. Unchanged files are not opened."""
    b = before.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    return now.join(b, "path", "left").where("_s is null or size <> _s or modified <> _m").drop("_s", "_m")


FLOOR = 2**20  # bytes up to which an entry may expand from any size


def zip_entries(packages: DataFrame, max_ratio: int = 200, with_manifest: bool = False) -> DataFrame:
    """(path, entry, size, sha256, problem) of zip packages: a problem names duplicates, unsafe paths or too great an expansion.

    with_manifest: the packages hold a manifest.json that lists each skill's files with their sizes and hashes. Then entries that it
    does not list, or lists otherwise, are problems, and so are files that it lists and the package lacks, skills without SKILL.md,
    and packages whose manifest is missing or unreadable."""
    import hashlib

    def declared(z: zipfile.ZipFile) -> dict[str, tuple] | None:
        try:
            m = json.loads(z.read("manifest.json"))
            return {f"skills/{skill}/{r['path']}": (r["size"], r["sha256"]) for skill, rows in m["skills"].items() for r in rows} | {f"skills/{skill}/SKILL.md": None for skill, rows in m["skills"].items() if not any(r["path"] == "SKILL.md" for r in rows)} if m["version"] == 1 else None
        except (KeyError, TypeError, ValueError, AttributeError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, "not a zip file"))
                    continue
                want = declared(z) if with_manifest else {}
                if want is None:
                    rows.append((path, "manifest.json", None, None, "no manifest"))
                    continue
                seen: set[str] = set()
                for info in z.infolist():
                    name, problem, digest = info.filename, None, None
                    if name in seen:
                        problem = "duplicate"
                    elif name.startswith("/") or ".." in name.split("/") or "\\" in name:
                        problem = "unsafe path"
                    elif info.file_size > max(FLOOR, max_ratio * info.compress_size):
                        problem = "expansion"
                    else:
                        digest = hashlib.sha256(z.read(info)).hexdigest()
                        if with_manifest and name != "manifest.json" and want.get(name) != (info.file_size, digest):
                            problem = "differs" if want.get(name) else "unexpected"
                    seen.add(name)
                    rows.append((path, name, info.file_size, digest, problem))
                rows += [(path, name, None, None, "missing") for name in sorted(set(want) - seen)]
            yield pd.DataFrame(rows, columns=["path", "entry", "size", "sha256", "problem"])

    return packages.select("path", "content").mapInPandas(run, "path string, entry string, size long, sha256 string, problem string")
