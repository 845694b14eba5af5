"""Quota responses: windows out of nested JSON, and their normalized history rows.

Tasks only take a body apart (`nodes_of`): JSON nests as deep as it likes, which no column expression follows. What a node says is read by
columns over VARIANT from one table of names, `FIELDS`, so that a new spelling is a new entry there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from usagelake.dims import WINDOWS
from usagelake.functions.scalars import normalize_plan, plan_multiplier

#: Keys that mark a node as one of quota. Fixed values.
QUOTA_KEYS = (
    "balance", "code_review_rate_limit", "credits", "has_credits", "hasCredits", "individualLimit", "individual_limit", "limit_reached", "limit", "limit_window_seconds", "limitId", "limit_id", "limitName",
    "limit_name", "planType", "plan_type", "primary", "rateLimitReachedType", "rate_limit_reached_type", "overage_limit_reached", "remaining", "remainingPercent", "remaining_percent", "resetsAt", "resets_at",
    "reset_after_seconds", "reset_at", "secondary", "unlimited", "used", "usedPercent", "used_percent", "windowDurationMins", "window_minutes", "window_duration_mins", "window_duration_minutes", "window_seconds",
)
#: What the fields of a node are called, in order of preference. Fixed values.
FIELDS = {
    "minutes": ("windowDurationMins", "window_minutes", "window_duration_mins", "window_duration_minutes"),
    "seconds": ("limit_window_seconds", "window_seconds"),
    "name": ("limitName", "limit_name", "name"),
    "used_share": ("used_percent", "usedPercent"),
    "left_share": ("remaining_percent", "remainingPercent"),
    "used": ("used",),
    "limit": ("limit", "individualLimit", "individual_limit"),
    "reset": ("reset_at", "resets_at", "resetsAt"),
    "plan": ("planType", "plan_type", "plan", "accountType", "account_type", "subscriptionPlan", "subscription_plan"),
}
#: How a window is spelled in a name. Fixed values.
SPELLED = {"5h": ("5h", "5 h", "5 hour", "five hour"), "7d": ("7d", "7 d", "7 day", "weekly", "week")}
SHOWN = sorted({*QUOTA_KEYS, "name", *FIELDS["plan"]})
MATCHES = 8
_KNOWN = frozenset(QUOTA_KEYS)
_READ = frozenset(n for names in FIELDS.values() for n in names)


def nodes_of(body: str | None) -> Iterator[tuple[str, int, dict | list]]:
    """(path, level, node) of every object or list of a JSON text, parents before children, in the order of the text. A text that is none,
    or is nested deeper than the parser goes (some thousands of levels), has no nodes."""
    try:
        left = [] if body is None else [("$", 0, json.loads(body))]
    except (ValueError, RecursionError):
        left = []
    while left:
        path, level, node = left.pop()
        if isinstance(node, (dict, list)):
            yield path, level, node
            inner = [(f"{path}.{k}", level + 1, v) for k, v in node.items() if isinstance(v, (dict, list))] if isinstance(node, dict) else [(f"{path}[{i}]", level + 1, v) for i, v in enumerate(node) if isinstance(v, (dict, list))]
            left += reversed(inner)


def json_nodes(responses: DataFrame, id_col: str, body: str, quota_only: bool = False, names: frozenset[str] | None = None) -> DataFrame:
    """(row, id, path, node, level, ord, key_count): every object or list of a JSON body, however deep, or only objects that hold a quota key;
    ord counts parents before children, row tells bodies apart. Halves of surrogate pairs become question marks. names: the keys that
    nodes are written with, all if there are none; a parent is then not written with its children over again."""
    plain = lambda t: t.encode("utf-8", "replace").decode()
    shown = lambda node: {k: v for k, v in node.items() if k in names} if names and isinstance(node, dict) else node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = json.JSONEncoder(ensure_ascii=False).encode  # one for all, as json.dumps makes one a call
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column("body").to_pylist()):
                for n, (path, level, node) in enumerate(nodes_of(text)):
                    known = len(_KNOWN.intersection(node)) if isinstance(node, dict) else 0
                    if known or not quota_only:
                        at.append(i)
                        out.append((plain(path), plain(write(shown(node))), level, n, known))
                if len(out) >= 4096 or (i == b.num_rows - 1 and out):
                    take, cols = pa.array(at, pa.int64()), list(zip(*out))
                    yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("id").take(take), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())))], names=["row", "id", "path", "node", "level", "ord", "key_count"])
                    at, out = [], []

    bodies = responses.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(body).cast("string").alias("body"))
    own = _parse_datatype_string("path string, node string, level int, ord int, key_count int")
    n = bodies.mapInArrow(run, StructType([StructField("row", bodies.schema["row"].dataType), StructField("id", bodies.schema["id"].dataType), *own.fields]))
    return n.withColumn("node", F.try_parse_json("node"))


def field(node: Column, name: str) -> Column:
    """The value of the first of a field's names that a node has, even if it is null there."""
    return F.coalesce(*(F.try_variant_get(node, f"$.{n}", "variant") for n in FIELDS[name]))


def _number(v: Column) -> Column:
    d = F.try_variant_get(v, "$", "double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _share(used: Column, left: Column, amount: Column, limit: Column) -> Column:
    share = F.coalesce(used, 100.0 - left, F.when(limit > 0, amount / limit * 100.0))
    return F.when(share < 0, 0.0).otherwise(share)


def used_percent(node: Column) -> Column:
    """The used share, else what the remaining one leaves of 100, else used over limit; never below 0."""
    return _share(*(_number(field(node, f)) for f in ("used_share", "left_share", "used", "limit")))


def _read(nodes: DataFrame) -> DataFrame:
    """Nodes with what they say: minutes of the window, used_percent, reset_at and plan_text. Each step is a projection that reads every
    column of the one before more than once, so that Spark takes each value out of its variant a single time.

    minutes: whole ones, else those of the seconds, else what the name spells. reset_at: seconds since 1970 as ISO text in UTC, or the text
    itself."""
    own = ["row", "id", "path", "level", "ord", "key_count"]
    n = nodes.select(*own, *(field(F.col("node"), f).alias(f) for f in FIELDS))
    double = lambda f: F.try_variant_get(f, "$", "double").alias(f"{f}_n")
    text = lambda f: F.try_variant_get(f, "$", "string").alias(f"{f}_t")
    n = n.select(*own, *map(double, ("minutes", "seconds", "used_share", "left_share", "used", "limit", "reset")), *map(text, ("minutes", "name", "reset", "plan")),
                 *(F.schema_of_variant(f).alias(f"{f}_k") for f in ("minutes", "reset")), (F.col("minutes").isNull() | F.is_variant_null("minutes")).alias("untold"))
    finite = lambda f: F.when(~F.isnan(f"{f}_n") & (F.abs(f"{f}_n") < float("inf")), F.col(f"{f}_n"))
    n = n.withColumns({f"{f}_n": finite(f) for f in ("seconds", "used_share", "left_share", "used", "limit", "reset")})
    n = n.withColumn("named", F.trim(F.regexp_replace(F.translate(F.lower("name_t"), "_", " "), r"\s+", " ")))

    whole = F.when(F.col("minutes_k") == "STRING", F.trim("minutes_t").try_cast("long")).otherwise(F.col("minutes_n").try_cast("long"))
    seconds = F.when(F.col("untold"), (F.col("seconds_n") / 60).try_cast("long"))
    spelled = F.coalesce(*(F.when(F.coalesce(*(F.nullif(F.contains("named", F.lit(t)), F.lit(False)) for t in texts)), WINDOWS[w]) for w, texts in SPELLED.items()))
    s = F.when(~F.col("reset_k").isin("STRING", "BOOLEAN") & (F.col("reset_n") >= -62_135_596_800) & (F.col("reset_n") < 253_402_300_800), F.col("reset_n"))
    utc = F.to_utc_timestamp(F.timestamp_seconds(s), F.current_timezone())
    iso = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(s == F.floor(s), "").otherwise(F.date_format(utc, ".SSSSSS")), F.lit("Z"))
    reset = F.when(F.col("reset_k") == "STRING", F.nullif("reset_t", F.lit(""))).otherwise(iso)
    return n.select(*own, F.coalesce(whole, seconds, spelled).alias("minutes"), _share(*(F.col(f"{f}_n") for f in ("used_share", "left_share", "used", "limit"))).alias("used_percent"), reset.alias("reset_at"), F.col("plan_t").alias("plan_text"))


def quota_nodes(responses: DataFrame, id_col: str, body: str) -> DataFrame:
    """Nodes that hold a quota key, with their windows, shares, resets, plans, numbers of quota keys and ranks (from 1): those of most keys
    first, in the order of the text among equals."""
    from pyspark.sql import Window

    n = _read(json_nodes(responses, id_col, body, quota_only=True, names=_READ))
    order = Window.partitionBy("row").orderBy(F.desc("key_count"), "ord")
    return n.withColumn("rank", F.row_number().over(order)).drop("row")


def required_windows(responses: DataFrame, id_col: str, body: str) -> DataFrame:
    """One row per response and window: its node of most quota keys, the earliest among equals.

    Where only one of the two windows is found the other is filled in as unavailable with 0 used; the plan of a window without one is
    the first known plan of the response's windows, or else of its matches. A window whose node names no used share has none.
    """
    n = _read(json_nodes(responses, id_col, body, quota_only=True, names=_READ)).withColumn("place", F.struct((-F.col("key_count")).alias("k"), "ord"))
    n = n.withColumn("plan", normalize_plan("plan_text")).withColumn("plan", F.nullif("plan", F.lit("unknown")))
    value = F.struct("place", "used_percent", "reset_at", "path", "plan")
    best = {w: F.min(F.when(F.col("minutes") == minutes, value)).alias(f"w{i}") for i, (w, minutes) in enumerate(WINDOWS.items())}
    known = F.slice(F.array_sort(F.collect_list(F.struct("place", "plan"))), 1, MATCHES).alias("matches")
    g = n.groupBy("row").agg(F.first("id").alias("id"), *best.values(), known)
    found = F.array_sort(F.array_compact(F.array(*(F.col(f"w{i}") for i in range(len(WINDOWS))))))
    plans = F.filter(F.concat(F.transform(found, lambda x: x["plan"]), F.transform("matches", lambda x: x["plan"])), lambda p: p.isNotNull())
    each = F.array(*(F.struct(F.lit(w).alias("window"), F.col(f"w{i}").alias("v")) for i, w in enumerate(WINDOWS)))
    j = g.where(F.size(found) > 0).select("id", F.get(plans, F.lit(0)).alias("common"), F.explode(each).alias("e")).select("id", "common", "e.window", "e.v")
    p = F.coalesce("v.plan", "common", F.lit("unknown"))
    gone = F.col("v").isNull()
    return j.select("id", "window", F.when(gone, 0.0).otherwise(F.col("v.used_percent")).alias("used_percent"), "v.reset_at", "v.path", p.alias("plan"), plan_multiplier(p).alias("plan_multiplier"), gone.alias("unavailable"))


def top_matches(nodes: DataFrame, k: int = MATCHES) -> DataFrame:
    """The k nodes of most quota keys per response: a report."""
    return nodes.where(F.col("rank") <= k)


def history_rows(windows: DataFrame) -> DataFrame:
    """Rows fit for the quota history: known share, available window; unknown accounts are named so."""
    w = windows.where("used_percent is not null and not coalesce(unavailable, false)")
    return w.withColumns({"account_id": F.coalesce(F.nullif("account_id", F.lit("")), F.lit("unknown")), "plan": F.coalesce(normalize_plan("plan"), F.lit("unknown"))})


def accepted_samples(samples: DataFrame) -> DataFrame:
    """What of a sample enters the quota history: not a cached or rejected one, but the rejected windows where it carries them."""
    ok = F.col("rejected_windows").isNotNull() | ~F.coalesce("using_previous", F.lit(False))
    at = F.when(F.col("rejected_windows").isNotNull(), F.col("checked_at")).otherwise(F.coalesce("percent_checked_at", "checked_at"))
    return samples.where(ok).withColumns({"windows": F.coalesce("rejected_windows", "windows"), "checked_at": at})


def node_summary(nodes: DataFrame) -> DataFrame:
    """The known keys of nodes (id, path, node), and their plain values whose key ends in limit, remaining or used, as a map of texts, with
    remaining_percent = 100 - used within 0 to 100."""
    plain = lambda v: ~_kind(v).startswith("OBJECT") & ~_kind(v).startswith("ARRAY")
    shown = lambda k, v: ~F.is_variant_null(v) & (k.isin(SHOWN) | (plain(v) & F.lower(k).rlike("(limit|remaining|used)$")))
    values = F.transform_values(F.map_filter(F.try_variant_get("node", "$", "map<string,variant>"), shown), lambda _, v: _text(v))
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - used_percent(F.col("node"))))
    return nodes.select("id", "path", values.alias("summary"), F.when(used_percent(F.col("node")).isNotNull(), left).alias("remaining_percent"))
