"""Dashboard-ready views: status, statistics, filters, and the series operators of charts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.dims import WINDOWS
from usagelake.functions.scalars import duration_text, percent_text, plan_multiplier, time_left_percent
from usagelake.operators.fold import fold

#: Fields that a dashboard never shows, and those of them that may stay where they only say yes or no. Fixed values.
SENSITIVE = (
    "access_token", "account_id", "accountId", "authIdentity", "baseUrl", "boundMachineId", "configPath", "email", "encryptionPassphrase", "fingerprint", "id_token", "identity",
    "password", "privatePath", "rawResponse", "refresh_token", "remoteRoot", "revisionId", "statePath", "target", "tokens", "user_id", "username",
)
FLAGS = ("password", "encryptionPassphrase")
#: Other names whose texts are masked.
MASKED = re.compile(r"(?i)secret|password|passphrase|authorization|cookie|api_?key|credential|(?:access|auth|bearer|id|refresh)_?token")


def history_stats(events: DataFrame, synthetic: str = "synthetic") -> DataFrame:
    return events.agg(F.count("*").alias("rows"), F.count_if(F.col(synthetic)).alias("synthetic_rows"), F.count_if(~F.col(synthetic)).alias("real_rows"))


def latest_status(rows: DataFrame, key: list[str], ts: str, values: list[str]) -> DataFrame:
    """The newest row's values per key: an older reading that comes late changes nothing."""
    return rows.groupBy(*key).agg(F.max(F.struct(ts, *values)).alias("_s")).select(*key, "_s.*")


def window_line(rows: DataFrame, now: Column) -> DataFrame:
    """Text of each usage window: share used, share of time gone, time left and age of the reading."""
    minutes = F.when(F.col("window") == "5h", WINDOWS["5h"]).otherwise(WINDOWS["7d"])
    return rows.select("*", F.concat(F.col("window"), F.lit(" "), percent_text(F.col("used_percent"))).alias("display"), time_left_percent(F.col("reset_ts"), now, minutes).alias("time_percent"), duration_text(F.col("reset_ts") - now).alias("time_left"), (now - F.coalesce("percent_ts", "checked_ts")).alias("age_s"))


def without_sensitive(value: object) -> object:
    """A JSON value without its sensitive fields, however deep they lie; whole objects and lists under such a name go, too. Texts under
    other names that tell of secrets are masked."""
    if isinstance(value, dict):
        return {k: "***" if isinstance(v, str) and MASKED.search(k) else without_sensitive(v) for k, v in value.items() if k not in SENSITIVE or (k in FLAGS and isinstance(v, bool))}
    return [without_sensitive(v) for v in value] if isinstance(value, list) else value


def redact(df: DataFrame, body: str) -> DataFrame:
    """Sensitive fields of a JSON text are left out, at any depth; a text that is no JSON becomes null."""

    @F.udf("string", useArrow=True)
    def safe(text):
        try:
            return None if text is None else json.dumps(without_sensitive(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return df.withColumn(body, safe(body))


def token_summary(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Sums over chosen sessions with the share of cacheable input that was cached."""
    s = sessions.groupBy(*by).agg(F.sum("fresh").alias("fresh"), F.sum("cached").alias("cached"), F.sum("cache_write").alias("cache_write"), F.sum("output").alias("output"), F.count_distinct("session_id").alias("sessions"))
    cacheable = F.col("fresh") + F.col("cached") + F.col("cache_write")
    return s.withColumn("cache_hit_percent", F.when(cacheable > 0, F.col("cached") * 100 / cacheable))


def rebase(events: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Running sums from zero over what a filter left, without synthetic rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.where(~F.coalesce("synthetic", F.lit(False))).select("*", *(F.sum(v).over(w).alias(f"cumulative_{v}") for v in values))


def model_filter(events: DataFrame, models: list[str]) -> DataFrame:
    """Synthetic rows stay; no choice means all."""
    return events.where(F.col("model").isin(models) | F.col("synthetic")) if models else events


def account_filter(df: DataFrame, accounts: list[str], col: str = "account_id") -> DataFrame:
    return df.where(F.col(col).isin(accounts)) if accounts else df


def last_seconds(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Rows of the last `seconds` before the newest, with synthetic rows and rows without a time."""
    newest = F.unix_timestamp(events.agg(F.max(ts)).scalar())
    return events.where(F.col("synthetic") | F.col(ts).isNull() | (F.unix_timestamp(ts) >= newest - seconds))


def on_day(events: DataFrame, ts: str, day: str, zone: str = "UTC") -> DataFrame:
    """Rows of one local day, from its start to before the next one's, with synthetic rows; no rows at all if the day has no real one."""
    first = F.to_date(F.lit(day))
    midnight = lambda d: F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.lit(0), F.lit(0), F.lit(0), F.lit(zone))
    start, end = midnight(first), midnight(F.date_add(first, 1))  # instants, whatever the session's own zone
    real = (F.col(ts) >= start) & (F.col(ts) < end) & ~F.coalesce("synthetic", F.lit(False))
    some = events.where(real).limit(1).count() > 0
    return events.where(F.col("synthetic") | real) if some else events.where("false")


def curve_breaks(points: DataFrame, by: list[str], ts: str, order: list[str], value: str, slope: Column) -> DataFrame:
    """Add breaks: a gap over 4 h breaks a curve, one up to 30 min does not; between them a fall of 3 or a slope of `slope` a minute does."""
    w = Window.partitionBy(*by).orderBy(*order)
    gap = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    step = F.col(value) - F.lag(value).over(w)
    rule = F.when(gap.isNull(), False).when(gap > 4 * 3600, True).when(gap <= 1800, False).when(step <= -3, True).otherwise(F.abs(step) / (gap / 60) >= slope)
    return points.withColumn("breaks", F.coalesce(rule, F.lit(False)))


def plus_equivalent(value: Column, plan: Column) -> Column:
    return value * plan_multiplier(plan)


def dejitter(points: DataFrame, by: list[str], order: list[str], value: str, most: int = 2, total: float = 2.0) -> DataFrame:
    """Add shown: up to `most` successive falls of at most `total` below the last firm value are drawn at that value."""
    names = points.columns
    schema = ", ".join(f"{n} {t}" for n, t in points.dtypes) + ", shown double"

    class Anchor:
        at, falls = None, 0

    def step(a: Anchor, r) -> list[tuple]:
        v = getattr(r, value)
        small = a.at is not None and v < a.at and a.at - v <= total and a.falls < most
        if small:
            a.falls += 1
        else:
            a.at, a.falls = v, 0
        return [(*(getattr(r, n) for n in names), float(a.at))]

    return fold(points, by, order, Anchor, step, schema)


def dense_merge(points: DataFrame, by: list[str], order: list[str], x: str, y: str, sx: float, sy: float, radius: float = 5.0) -> DataFrame:
    """Keep a point once it is more than 4 radii from the last kept one, in scaled coordinates; the last point of a series is kept."""
    names = points.columns

    class Kept:
        last = pending = None

    def row(r) -> tuple:
        return tuple(getattr(r, n) for n in names)

    def step(k: Kept, r) -> list[tuple]:
        far = k.last is None or ((getattr(r, x) - getattr(k.last, x)) / sx) ** 2 + ((getattr(r, y) - getattr(k.last, y)) / sy) ** 2 > (4 * radius) ** 2
        if far:
            k.last, k.pending = r, None
            return [row(r)]
        k.pending = r
        return []

    return fold(points, by, order, Kept, step, points.schema, lambda k: [row(k.pending)] if k.pending is not None else [])


def due(accounts: DataFrame, interval_s: int = 600) -> DataFrame:
    """The next time any account is due."""
    return accounts.agg(F.min(F.col("last_poll_ts") + interval_s).alias("next_due"))
