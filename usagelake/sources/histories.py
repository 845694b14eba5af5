"""Scans of stored histories: deltas, quota readings, token sessions and the cache of other machines' records.

A history is a file, or a folder of files, of JSON objects one after the other, on lines or not. Each file is read whole, in a task;
many files are read by many tasks. A path that does not exist is an empty history.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.dims import WINDOWS
from usagelake.functions.scalars import normalize_model, normalize_plan, or_unknown, to_number
from usagelake.operators.deltas import expand_grouped
from usagelake.operators.journal import valid_operation
from usagelake.operators.tokens import COUNTERS, cost_columns, in_range, today
from usagelake.sources.files import json_sequence

UNKNOWN_LABEL = "Unknown"
EVENT = "struct<checkedAt:string,window:string,model:string,accountSlotId:string,accountLabel:string,deltaPercent:double,deltaCostUsd:double>"


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value): the JSON objects of a history."""
    try:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException:
        files = spark.createDataFrame([], "file string, value string")
    return json_sequence(files)


def delta_history(spark: SparkSession, path: str) -> DataFrame:
    """Delta events, grouped rows expanded and single ones as they are; events without an account are those of an unknown one."""
    rows = _objects(spark, path)
    grouped = F.coalesce(F.get_json_object("value", "$.delta"), F.get_json_object("value", "$.events")).isNotNull()
    single = rows.where(~grouped).select(F.from_json("value", EVENT).alias("e")).select("e.*")
    columns = ["window", "checkedAt", "model", "accountSlotId", "accountLabel", "deltaPercent", "deltaCostUsd"]
    both = expand_grouped(rows.where(grouped)).select(*columns).unionByName(single.select(*columns))
    return both.withColumns({"accountSlotId": or_unknown("accountSlotId"), "accountLabel": or_unknown("accountLabel", UNKNOWN_LABEL)})


def quota_history(spark: SparkSession, path: str, samples: bool = False) -> DataFrame:
    """(checked_at, account_id, account_label, window, used_percent, reset_at, plan): one row per reading and window that is available
    and has a share. samples: rows of a sample log, whose nested sample, or the row itself, is the reading; samples that repeat earlier
    windows or were not accepted are none, unless they carry the rejected windows."""
    v = _objects(spark, path).select(F.coalesce(F.get_json_object("value", "$.sample"), F.col("value")).alias("v") if samples else F.col("value").alias("v"))
    get = lambda p: F.get_json_object("v", f"$.{p}")
    rejected = get("rejectedWindows").startswith("{") if samples else F.lit(False)
    if samples:
        old = F.coalesce(get("usingPreviousWindows") == "true", F.lit(False)) | F.coalesce(get("remoteUsage.accepted") == "false", F.lit(False))
        v = v.where(F.coalesce(rejected, F.lit(False)) | ~old)
    rejected = F.coalesce(rejected, F.lit(False))
    at = F.when(rejected, get("checkedAt")).otherwise(F.coalesce(F.nullif(get("percentCheckedAt"), F.lit("")), get("checkedAt"))) if samples else get("checkedAt")
    window = lambda w, f: F.when(rejected, get(f"rejectedWindows['{w}'].{f}")).otherwise(get(f"windows['{w}'].{f}")) if samples else get(f"windows['{w}'].{f}")
    each = F.array(*(F.struct(F.lit(w).alias("window"), to_number(window(w, "usedPercent")).alias("used_percent"), window(w, "resetAt").alias("reset_at"), normalize_plan(window(w, "plan")).alias("plan"), window(w, "unavailable").alias("gone")) for w in WINDOWS))
    rows = v.select(at.alias("checked_at"), or_unknown(get("accountSlotId")).alias("account_id"), or_unknown(get("accountLabel"), UNKNOWN_LABEL).alias("account_label"), F.explode(each).alias("w")).select("checked_at", "account_id", "account_label", "w.*")
    return rows.where("checked_at <> '' and used_percent is not null and coalesce(gone, 'false') <> 'true'").drop("gone")


COSTS = {"input_cost": "inputCostUsd", "cached_cost": "cachedInputCostUsd", "cache_write_cost": "cacheWriteInputCostUsd", "output_cost": "outputCostUsd", "total_cost": "totalCostUsd"}


SAVED = {"input": "inputTokens", "cached": "cachedInputTokens", "cache_write": "cacheWriteInputTokens", "legacy_write": "cachedOutputTokens", "output": "outputTokens"}
_TOKENS = f"struct<{', '.join(f'{c}: double' for c in (*SAVED.values(), 'requests'))}>"
SESSION = f"struct<sessionId: string, startedAt: string, updatedAt: string, accountSlotId: string, accountLabel: string, tokens: {_TOKENS}, cost: struct<{', '.join(f'{k}: double' for k in COSTS.values())}>, byModel: map<string, struct<tokens: {_TOKENS}, fastTokens: {_TOKENS}>>>"


def _ranged(saved: Column) -> Column:
    """Saved counters as a struct of totals in range, all seven of them."""
    t = in_range(*(saved[k].cast("long") for k in SAVED.values()))
    return F.struct(*(c.alias(n) for n, c in t.items()), (t["input"] + t["output"]).alias("total"), F.greatest(F.lit(0), F.coalesce(saved["requests"].cast("long"), F.lit(0))).alias("requests"))


def normalized_sessions(objects: DataFrame) -> DataFrame:
    """(session_id, started_at, updated_at, account_id, account_label, tokens, cost, by_model) of saved sessions objects(file, pos, value).

    Sessions without an id or without a tokens object are none. Counters are brought into range, with what older records call cached
    output as cache writes. Costs are those of the models' tokens at today's prices, with the surcharge of their fast tokens; a session
    without models keeps the costs that were saved, or has none. by_model: map of a model to its tokens, fast tokens and cost.
    """
    # rows are chosen by `inline`, as a filter would be pushed below the parsing and parse once more
    whole = F.filter(F.array(F.try_variant_get(F.try_parse_json("value"), "$", SESSION)), lambda o: o["tokens"].isNotNull() & (o["sessionId"] != ""))
    s = objects.select(F.inline(whole))
    # a session's models stay with it as one array; each step reads what the step before made, so that nothing is computed twice
    models = F.transform(F.filter(F.map_entries("byModel"), lambda m: m["value"].isNotNull()), lambda m: F.struct(m["key"].alias("model"), normalize_model(m["key"]).alias("name"), _ranged(m["value"]["tokens"]).alias("tokens"), F.when(m["value"]["fastTokens"].isNotNull(), _ranged(m["value"]["fastTokens"])).alias("fast")))
    priced = F.transform("models", lambda m: F.struct(m["model"].alias("model"), m["tokens"].alias("tokens"), m["fast"].alias("fast"), *(c.alias(n) for n, c in today(m["name"]).items())))

    def of(m: Column) -> Callable[[str], Column]:
        return lambda n: m["price"][n] if n.startswith("p_") else F.coalesce(m["fast"][n[2:]], F.lit(0)) if n.startswith("f_") else m["fast_multiplier"] if n == "fast_multiplier" else m["tokens"][n]

    def parts(m: Column) -> Column:
        cost = cost_columns(col=of(m))
        return F.struct(m["model"].alias("model"), m["tokens"].alias("tokens"), m["fast"].alias("fast_tokens"), F.struct(*(c.alias(n) for n, c in cost.items() if n != "total_cost")).alias("cost"))

    def rounded(m: Column) -> Column:
        total = reduce(lambda a, b: a + b, (m["cost"][n] for n in COSTS if n != "total_cost"))
        whole = {n: total if n == "total_cost" else m["cost"][n] for n in COSTS}
        return F.struct(m["model"].alias("model"), F.struct(m["tokens"].alias("tokens"), m["fast_tokens"].alias("fast_tokens"), F.struct(*(F.round(c, 8).alias(n) for n, c in whole.items())).alias("cost")).alias("v"))

    each = lambda n: F.transform("models", lambda m: m["cost"][n])
    added = lambda cs: F.aggregate(cs, F.lit(0.0), lambda a, c: a + c)
    total = F.aggregate("models", F.lit(0.0), lambda a, m: a + reduce(lambda x, y: x + y, (m["cost"][n] for n in COSTS if n != "total_cost")))
    s = s.withColumn("models", F.coalesce(models, F.array().cast(s.select(models.alias("m")).schema["m"].dataType))).withColumn("models", priced).withColumn("models", F.transform("models", parts))
    sums = F.struct(*(F.round(total if n == "total_cost" else added(each(n)), 8).alias(n) for n in COSTS))
    saved = F.struct(*(F.coalesce(F.col(f"cost.{k}"), F.lit(0.0)).alias(n) for n, k in COSTS.items()))
    return s.select(F.col("sessionId").alias("session_id"), F.col("startedAt").alias("started_at"), F.coalesce(F.nullif("updatedAt", F.lit("")), "startedAt").alias("updated_at"), or_unknown("accountSlotId").alias("account_id"), or_unknown("accountLabel", UNKNOWN_LABEL).alias("account_label"),
                    _ranged(F.col("tokens")).alias("tokens"), F.when(F.size("models") > 0, sums).otherwise(saved).alias("cost"), F.map_from_entries(F.array_sort(F.transform("models", rounded))).alias("by_model"))


def token_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The saved sessions of a history: see `normalized_sessions`."""
    return normalized_sessions(_objects(spark, path))


def session_models(sessions: DataFrame) -> DataFrame:
    """(session_id, started_at, updated_at, account_id, account_label, model, counters with fresh, total_cost): a row per session and model;
    a session without models has one, of no model."""
    flat = ["session_id", "started_at", "updated_at", "account_id", "account_label"]
    one = F.explode_outer("by_model").alias("model", "m")
    of = lambda c: F.coalesce(F.col(f"m.tokens.{c}"), F.col(f"tokens.{c}")).alias(c)
    return sessions.select(*flat, "tokens", "cost", one).select(*flat, "model", *(of(c) for c in (*COUNTERS, "fresh")), F.coalesce("m.cost.total_cost", "cost.total_cost").alias("total_cost"))


def checked_cache(cache: DataFrame) -> DataFrame:
    """cache(source_machine_id, key, kind, record, record_key, origin) as it is, or an error at the first row that is not a valid
    upsert or whose record is of another origin than the machine it came from."""
    row = cache.select(F.struct("source_machine_id", "key", "kind", "record", "record_key", "origin").alias("_row"))
    of = lambda c: F.col(f"_row.{c}")
    good = valid_operation(F.lit("upsert"), of("kind"), of("key"), of("record"), of("record_key")) & (of("source_machine_id") != "") & (of("origin") == of("source_machine_id"))
    wrong = F.raise_error(F.concat(F.lit("invalid cache entry of "), F.coalesce(of("source_machine_id"), F.lit("no machine"))))
    return row.select(F.when(good, F.col("_row")).otherwise(wrong.cast(row.schema["_row"].dataType)).alias("r")).select("r.*")


def changed_heads(heads: DataFrame, seen: DataFrame) -> DataFrame:
    """Heads of journals that moved since they were read: heads(machine_id, marker) that `seen` does not hold."""
    return heads.join(seen.select("machine_id", "marker"), ["machine_id", "marker"], "left_anti")
