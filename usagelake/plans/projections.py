"""Projections of samples, states and statuses: what is measured, what is kept, what is shown, and what is printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, MapType, StringType, StructField, StructType

from usagelake.dims import WINDOWS
from usagelake.functions.scalars import or_unknown, significant
from usagelake.operators.fold import fold
from usagelake.operators.tokens import normalize_totals

COUNTS = ["input", "fresh", "cached", "cache_write", "output", "total", "requests"]
#: What is kept of a state, and what of it only the debug log leaves out. Fixed values.
STATE = ["windows", "token_usage", "cost", "cost_by_model", "last_sample", "updated_at", "run_cost", "run_cost_by_model", "measured_cost_intervals", "has_runtime_cost_baseline", "remote_usage_identity", "active_account_slot_id"]
NOT_DEBUG = ["token_usage", "cost", "cost_by_model", "last_sample", "active_account_slot_id"]

#: What is shown in place of an error, whose own text may tell too much. Fixed values.
ERRORS = {"account": "Account operation failed", "projection": "Projection error", "cloud": "Cloud configuration error", "upload": "Automatic skill upload failed", "sync": "Automatic usage synchronization failed"}


def make_samples(readings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Samples of readings(counts, cost, cost_by_model) of an account: with progress since the reading before. Growth is never negative;
    tokens of a first reading have not grown, while its cost counts from 0; a model of either reading has its own growth."""
    w = Window.partitionBy(*key).orderBy(*order)
    none = F.create_map().cast("map<string,double>")
    before, now = F.coalesce(F.lag("cost_by_model").over(w), none), F.coalesce("cost_by_model", none)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tokens = {f"delta_{c}": F.coalesce(F.greatest(F.lit(0), F.col(c) - F.lag(c).over(w)), F.lit(0)) for c in COUNTS}
    cost = F.round(F.greatest(F.lit(0.0), zero(F.col("cost")) - zero(F.lag("cost").over(w))), 8)
    by_model = F.map_zip_with(now, before, lambda m, a, b: F.round(F.greatest(F.lit(0.0), zero(a) - zero(b)), 8))
    return readings.withColumns(tokens | {"cost_delta": cost, "cost_delta_by_model": by_model, "account_label": F.when(F.col("account_slot_id").isNotNull(), or_unknown("account_label", "Unknown"))})


def measured_costs(samples: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Add event_cost, event_cost_by_model and event_cost_ready: cost since the run began, which is its first reading with a cost;
    ready once two intervals were measured and the reading has a cost. Each addition is rounded to 8 digits, so it is a fold."""
    added = [StructField("event_cost", DoubleType()), StructField("event_cost_by_model", MapType(StringType(), DoubleType())), StructField("event_cost_ready", BooleanType())]

    class Run:
        def __init__(self):
            self.readings, self.cost, self.models = 0, 0.0, {}

    def step(run: Run, r) -> list[tuple]:
        has = r.cost is not None
        if has and run.readings:
            run.cost = round(run.cost + r.cost_delta, 8)
            for model, cost in r.cost_delta_by_model:
                run.models[model] = round(run.models.get(model, 0.0) + cost, 8)
        run.readings += has
        return [(*r, run.cost, sorted(run.models.items()), has and run.readings > 2)]

    return fold(samples, key, order, Run, step, StructType([*samples.schema.fields, *added]))


def compact_samples(samples: DataFrame) -> DataFrame:
    """What a state keeps of its last sample: the accepted reading and its progress, without raw responses. Saved totals are brought
    into range; an account has its label."""
    delta = samples.withColumns({c: F.coalesce(f"delta_{c}", F.lit(0)) for c in ("input", "cached", "cache_write", "output")} | {"legacy_write": F.lit(None).cast("long")}).drop("fresh")
    zero = F.coalesce("cost", F.lit(0.0))
    none = F.create_map().cast("map<string,double>")
    out = normalize_totals(delta).select("checked_at", F.coalesce(F.nullif("percent_checked_at", F.lit("")), "checked_at").alias("percent_checked_at"), "endpoint", "status", "windows", "errors", F.coalesce("using_previous", F.lit(False)).alias("using_previous"), F.struct("input", "fresh", "cached", "cache_write", "output").alias("token_delta"), zero.alias("cost"), F.coalesce("cost_delta", F.lit(0.0)).alias("cost_delta"), F.coalesce("cost_by_model", none).alias("cost_by_model"), F.coalesce("cost_delta_by_model", none).alias("cost_delta_by_model"), "account_slot_id", F.when(F.col("account_slot_id").isNotNull(), or_unknown("account_label", "Unknown")).alias("account_label"))
    return out


def compact_states(states: DataFrame, debug: bool = False) -> DataFrame:
    """What is written of a state, or of it to the debug log: the known fields that it has, run costs to 8 digits."""
    names = [c for c in STATE if c in states.columns and not (debug and c in NOT_DEBUG)]
    rounded = {"run_cost": lambda: F.round("run_cost", 8), "run_cost_by_model": lambda: F.transform_values("run_cost_by_model", lambda m, c: F.round(c, 8))}
    return states.select(*(rounded[c]().alias(c) if c in rounded else F.col(c) for c in names))


def account_status(status: DataFrame) -> DataFrame:
    """The shown status of accounts: flags are never null, an error is only said to be one, items have five fields."""
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    item = lambda a: F.struct(*(a[c].alias(c) for c in ("id", "label", "ready", "active", "cloud_state")))
    return status.select("active_account_id", flag("awaiting_login"), flag("cloud_binding_enabled"), F.when(F.coalesce("error", F.lit("")) != "", ERRORS["account"]).alias("error"), "message", F.transform(F.coalesce("items", F.array().cast(dict(status.dtypes)["items"])), item).alias("items"))


def skill_status(status: DataFrame) -> DataFrame:
    """The shown status of skills: states of projections without their paths, errors only by application."""
    item = lambda s: F.struct(s["name"].alias("name"), F.coalesce(s["assignments"], F.create_map().cast("map<string,boolean>")).alias("assignments"), F.transform_values(s["projections"], lambda app, p: F.struct(p["state"].alias("state"))).alias("projections"), F.transform_values(s["errors"], lambda app, e: F.lit(ERRORS["projection"])).alias("errors"))
    return status.select("version", F.transform("items", item).alias("items"))


def cloud_status(status: DataFrame) -> DataFrame:
    """The shown status of synchronisation: switches and counters; a failure is only said to be one."""
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    failed = lambda c, text: F.when(F.col(c).isNotNull(), text).alias(c)
    return status.select("enabled", "skills_auto_upload", "usage_data_auto_sync", "allow_optimistic_writes", flag("conditional_writes_verified"), flag("optimistic_writes_active"), F.when(F.coalesce("error", F.lit("")) != "", ERRORS["cloud"]).alias("error"), flag("upload_pending"), F.coalesce("upload_attempts", F.lit(0)).alias("upload_attempts"), failed("upload_failure", ERRORS["upload"]), "last_success_at", "next_attempt_in_seconds", failed("sync_failure", ERRORS["sync"]))


# -- console text ----------------------------------------------------------------------------------------------------------------------


def _percent(x: Column) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.concat(significant(x, 4), F.lit("%")))


def _moment(c: str) -> Column:
    """A time as it was said, with the same moment in the session's zone behind it where it is one: console output, fixed text."""
    at = F.try_to_timestamp(F.col(c))
    local = F.concat(F.col(c), F.lit(" (local "), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(")"))
    return F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(F.coalesce(local, F.col(c)))


def delta_text(events: DataFrame, windows: DataFrame | None = None, key: list[str] = ()) -> DataFrame:
    """Add line: a valid event of (checked_at, window, model, delta_percent, delta_cost, cost_percent_ratio, cumulative_percent,
    cumulative_cost, plan, multiplier). windows(key, window, percent, plan, multiplier): what each window shows now, said at the end."""
    s = lambda c, n=6: significant(F.col(c), n)
    text = [F.lit("[delta] "), _moment("checked_at"), F.lit(" "), F.col("window"), F.lit(" "), or_unknown("model"), F.lit(" +"), s("delta_percent", 4), F.lit("% / +$"), s("delta_cost"), F.lit("; ratio $"), s("cost_percent_ratio"), F.lit("/%; cumulative "), s("cumulative_percent", 4), F.lit("% / $"), s("cumulative_cost"), F.lit("; event plan "), or_unknown("plan"), F.lit(" ("), significant(F.coalesce("multiplier", F.lit(1.0)), 6), F.lit("x)")]
    if windows is None:
        return events.withColumn("line", F.concat(*text))
    if not key:
        raise ValueError("windows are those of an account: name its columns")
    now = windows.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("percent", "plan", "multiplier")))).alias("_now"))
    j = events.join(now, list(key), "left")
    for label in WINDOWS:
        w = F.col("_now")[label]
        text += [F.lit("; current " if label == next(iter(WINDOWS)) else ", "), F.lit(f"{label} "), _percent(w["percent"]), F.lit(" ["), or_unknown(w["plan"]), F.lit(" "), significant(F.coalesce(w["multiplier"], F.lit(1.0)), 6), F.lit("x]")]
    return j.withColumn("line", F.concat(*text)).drop("_now")


def warning_text(events: DataFrame) -> DataFrame:
    """The rows of a ledger with a ratio warning, with line."""
    s = lambda c: significant(F.col(c), 6)
    text = F.concat(F.lit("[warning] "), _moment("checked_at"), F.lit(" "), F.col("window"), F.lit(" "), or_unknown("model"), F.lit(" cost/percent ratio $"), s("cost_percent_ratio"), F.lit("/% deviates from average $"), s("average_ratio"), F.lit("/% ("), s("ratio_deviation"), F.lit("x)"))
    return events.where("ratio_deviation_warning").withColumn("line", text)


def special_text(events: DataFrame) -> DataFrame:
    """Add line: a special event of (checked_at, window, reason, previous_percent, current_percent, reasons)."""
    why = F.when(F.coalesce("reasons", F.lit("")) != "", F.concat(F.lit(" reasons "), F.col("reasons"))).otherwise("")
    text = F.concat(F.lit("[event] "), _moment("checked_at"), F.lit(" "), or_unknown("window", "?"), F.lit(" "), or_unknown("reason", "special-event"), F.lit("; baseline "), _percent(F.col("previous_percent")), F.lit(" -> "), _percent(F.coalesce("current_percent", "previous_percent")), why)
    return events.withColumn("line", text)
