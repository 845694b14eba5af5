"""Delta ledgers: percent-versus-cost events, their splits over models, and the batch derivation from raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.dims import MIN_COST_PER_PERCENT, PLAN_MULTIPLIERS, RATIO_DEVIATION, RESET_JITTER_S, WINDOWS
from usagelake.functions.scalars import deviation, deviation_warning, ratio, valid_delta
from usagelake.operators import blocks
from usagelake.operators.fold import fold


def ledger(events: DataFrame, by: list[str], model: str, order: list[str], percent: str, cost: str, hot_rows: int | None = None) -> DataFrame:
    """Running sums per group and per model of valid events, and each ratio against the average of the model's earlier events.
    Sums keep the types of the columns, so that decimals add up exactly; ratios are doubles. Groups of more than `hot_rows` rows are summed
    in blocks (see `blocks`)."""
    num = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    e = events.where(valid_delta(num(percent), num(cost)))
    names = {"cumulative_percent": percent, "cumulative_cost": cost}
    if blocks.hot(e, by, hot_rows):
        spread = blocks.running(blocks.blocked(e, by, order), by, order, names)
        e = blocks.running(spread, [*by, model], order, {f"model_{n}": c for n, c in names.items()}, {"_percent": percent, "_cost": cost}).drop("_block")
    else:
        all_ = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        own = Window.partitionBy(*by, model).orderBy(*order)
        upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
        e = e.select("*", *(F.sum(c).over(all_).alias(n) for n, c in names.items()), *(F.sum(c).over(upto).alias(f"model_{n}") for n, c in names.items()), F.sum(percent).over(before).alias("_percent"), F.sum(cost).over(before).alias("_cost"))
    r = ratio(num(cost), num(percent))
    e = e.select("*", r.alias("cost_percent_ratio"), ratio(num("_cost"), num("_percent")).alias("average_ratio")).drop("_percent", "_cost")
    dev = deviation(F.col("cost_percent_ratio"), F.col("average_ratio"))
    return e.select("*", dev.alias("ratio_deviation"), deviation_warning(dev).alias("ratio_deviation_warning"))


def zero_rows(spark: SparkSession, ledger_rows: DataFrame, window: str = "window") -> DataFrame:
    """A ledger with one synthetic zero row per window before all others."""
    zero = spark.createDataFrame([(w,) for w in WINDOWS], f"{window} string").withColumn("synthetic", F.lit(True))
    nums = ("delta_percent", "delta_cost", "cumulative_percent", "cumulative_cost")
    zero = zero.withColumns({c: F.lit(0.0) for c in nums})
    return zero.unionByName(ledger_rows.withColumn("synthetic", F.lit(False)), allowMissingColumns=True)


def last_cumulative(ledger_rows: DataFrame, by: list[str], seq: Column) -> DataFrame:
    """The state to start from: the last row's sums per group."""
    return ledger_rows.groupBy(*by).agg(F.max_by("cumulative_percent", seq).alias("cumulative_percent"), F.max_by("cumulative_cost", seq).alias("cumulative_cost"))


def proportional_split(df: DataFrame, key: list[str], part: str, weight: str, total: Column, out: str) -> DataFrame:
    """Split each key's total over its parts by weight; the last part takes the remainder. Keys without positive weight give no rows."""
    ordered = Window.partitionBy(*key).orderBy(part)
    w = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the next window, which then needs no sort of its own
    df = df.select("*", F.sum(weight).over(w).alias("_w"), F.count("*").over(w).alias("_n"), total.alias("_t")).where("_w > 0")
    share = F.col("_t") * F.col(weight) / F.col("_w")
    used = F.coalesce(F.sum(share).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.select("*", F.row_number().over(ordered).alias("_i"), used.alias("_used"))  # one sort: both see equal parts in one order
    return df.withColumn(out, F.when(F.col("_i") == F.col("_n"), F.col("_t") - F.col("_used")).otherwise(share)).drop("_w", "_t", "_n", "_i", "_used")


def attribute_cost(deltas: DataFrame, key: list[str], model: str, model_cost: str, delta_cost: str, default: str) -> DataFrame:
    """Per key, the model costs made to add up to delta_cost: what is missing goes to 'unknown', too much is scaled down, and a key
    without any positive cost and nothing missing goes to the default model. deltas: one row per key and model."""
    s = deltas.withColumn(model_cost, F.greatest(F.lit(0.0), F.coalesce(model_cost, F.lit(0.0))))
    t = s.groupBy(*key).agg(F.sum(model_cost).alias("_sum"), F.first(delta_cost).alias("_d"))
    pos = s.where(F.col(model_cost) > 0).join(t, key).withColumn(model_cost, F.when(F.col("_sum") > F.col("_d"), F.col(model_cost) * F.col("_d") / F.col("_sum")).otherwise(F.col(model_cost))).select(*key, model, model_cost)
    short = t.where("_sum < _d - 1e-8").select(*key, F.lit("unknown").alias(model), (F.col("_d") - F.col("_sum")).alias(model_cost))
    none = t.where("_sum = 0 and not (_sum < _d - 1e-8)").select(*key, F.lit(default).alias(model), F.col("_d").alias(model_cost))
    return pos.unionByName(short).groupBy(*key, model).agg(F.sum(model_cost).alias(model_cost)).unionByName(none)


def expand_grouped(rows: DataFrame, text: str = "value") -> DataFrame:
    """Flat events of grouped delta rows: key `delta` or else `events`, elements an event, a list of events, or one split over `models`.

    A split's percent is shared by cost over the models that have a name and a cost, to 8 places, the last one taking the rest; one without
    such models, without a percent or without any cost gives none. What a model says of itself stands before what the split says.
    """
    get, texts, numbers = F.try_variant_get, ("checkedAt", "model", "accountSlotId", "accountLabel"), ("deltaPercent", "deltaCostUsd")
    event = ", ".join([*(f"{c}: string" for c in texts), *(f"{c}: double" for c in numbers)])
    v = rows.select(F.try_parse_json(text).alias("v")).select(get("v", "$.window", "string").alias("window"), get("v", "$.delta", "variant").alias("delta"), get("v", "$.events", "variant").alias("events"))
    one = v.select("window", F.explode(get(F.coalesce("delta", "events"), "$", "array<variant>")).alias("item"))
    # each item leaves its variant once, with all of its fields: what is no object has none, what is no list has no elements
    one = one.select("window", "item", get("item", "$", f"struct<{event}, models: variant>").alias("e")).select("window", "item", "e", get("e.models", "$", f"array<struct<{event.replace('model: string', 'model: variant')}>>").alias("models"))

    plain = lambda m: F.struct(*(m[c].alias(c) for c in (*texts, *numbers)))
    listed = F.when(F.col("e").isNotNull(), F.array(plain(F.col("e")))).otherwise(F.filter(get("item", "$", f"array<struct<{event}>>"), lambda m: m.isNotNull()))
    named = lambda m: F.when(F.schema_of_variant(m["model"]) == "STRING", get(m["model"], "$", "string"))
    of = lambda m, c: F.coalesce(m[c], F.col(f"e.{c}")).alias(c)
    part = F.transform("models", lambda m: F.struct(of(m, "checkedAt"), named(m).alias("model"), of(m, "accountSlotId"), of(m, "accountLabel"), F.col("e.deltaPercent").alias("deltaPercent"), m["deltaCostUsd"].alias("deltaCostUsd")))
    parts = F.filter(part, lambda m: m["model"].isNotNull() & m["deltaCostUsd"].isNotNull() & ~F.isnan(m["deltaCostUsd"]))
    one = one.select("window", "models", F.when(F.col("models").isNull(), listed).otherwise(parts).alias("parts"))
    one = one.select("window", "models", "parts", F.aggregate("parts", F.lit(0.0), lambda a, m: a + m["deltaCostUsd"]).alias("cost"), F.size("parts").alias("n"))
    share = lambda m: m["deltaPercent"] * m["deltaCostUsd"] / F.col("cost")
    used = F.aggregate(F.slice("parts", 1, F.greatest(F.lit(0), F.col("n") - 1)), F.lit(0.0), lambda a, m: a + share(m))
    split = F.when(F.col("cost") > 0, F.col("parts"))
    one = one.select("window", "models", "cost", "n", F.when(F.col("models").isNull(), F.col("parts")).otherwise(split).alias("parts"), F.when(F.col("models").isNotNull() & (F.col("cost") > 0), used).alias("used"))
    own = F.transform("parts", lambda m, i: m.withField("deltaPercent", F.round(F.when(i == F.col("n") - 1, m["deltaPercent"] - F.col("used")).otherwise(share(m)), 8)))
    own = F.filter(own, lambda m: m["deltaPercent"].isNotNull())
    return one.select("window", F.inline(F.when(F.col("models").isNull(), F.col("parts")).otherwise(own)))


def pack_models(events: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """The inverse: the events of one time and window as one row, with their models where they are a split, else as a list.

    A split has two events or more, of one account, all with a model, a percent, a cost and a ratio; its sums are positive, its percents are
    proportional to cost, and its ratios (costPercentRatio, or else cost over percent) are equal, within the tolerance.
    """
    ratio_ = F.col("costPercentRatio") if "costPercentRatio" in events.columns else F.col("deltaCostUsd") / F.nullif(F.col("deltaPercent"), F.lit(0.0))
    one = F.struct("model", "accountSlotId", "deltaPercent", "deltaCostUsd", ratio_.alias("ratio"))
    g = events.groupBy("window", "checkedAt").agg(F.round(F.sum("deltaPercent"), 8).alias("p"), F.sum("deltaCostUsd").alias("c"), F.array_sort(F.collect_list(one)).alias("parts"))
    first = F.col("parts")[0]
    whole = F.forall("parts", lambda x: x["model"].isNotNull() & x["deltaPercent"].isNotNull() & x["deltaCostUsd"].isNotNull() & x["ratio"].isNotNull() & x["accountSlotId"].eqNullSafe(first["accountSlotId"]))
    even = F.forall("parts", lambda x: (F.abs(x["deltaPercent"] - F.col("p") * x["deltaCostUsd"] / F.col("c")) <= tolerance) & (F.abs(x["ratio"] - first["ratio"]) <= tolerance))
    joined = F.coalesce((F.size("parts") > 1) & whole & (F.col("p") > 0) & (F.col("c") > 0) & even, F.lit(False))
    part = lambda x, split: F.struct(x["model"].alias("model"), (F.lit(None).cast("string") if split else x["accountSlotId"]).alias("accountSlotId"), (F.lit(None).cast("double") if split else x["deltaPercent"].cast("double")).alias("deltaPercent"), x["deltaCostUsd"].cast("double").alias("deltaCostUsd"))
    return g.select("window", "checkedAt", F.when(joined, first["accountSlotId"]).alias("accountSlotId"), F.col("p").alias("deltaPercent"), F.col("c").alias("deltaCostUsd"), F.when(joined, "models").otherwise("list").alias("form"), F.when(joined, F.transform("parts", lambda x: part(x, True))).otherwise(F.transform("parts", lambda x: part(x, False))).alias("parts"))


def positive_deltas(percent: str, cost: str, *windows: DataFrame) -> DataFrame:
    """The rows of all windows together that grew in both percent and cost."""
    out = windows[0]
    for w in windows[1:]:
        out = out.unionByName(w)
    return out.where((F.col(percent) > 0) & (F.col(cost) > 0))


def new_events(now: DataFrame, before: DataFrame, identity: list[str], digits: int = 8) -> DataFrame:
    """Events whose identity, numbers rounded, is not among the earlier ones."""
    same = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in now.select(*identity).dtypes]
    keyed = now.select("*", F.struct(*same).alias("_id"))
    return keyed.join(before.select(F.struct(*same).alias("_id")).distinct(), "_id", "left_anti").drop("_id")


def retain(df: DataFrame, ts: str, now: Column, days: float | None) -> DataFrame:
    """Rows not older than `days`; rows without a time stay. None or 0 days keep all."""
    return df if not days or days <= 0 else df.where(F.col(ts).isNull() | (F.col(ts) >= now - F.make_dt_interval(F.lit(int(days)))))


def derive_events(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Ledger input of a history of any form: intervals are swept and joined by the delta rows beside them; delta rows alone go as
    they are; raw samples run through the batch state machine. rows: kind ('interval', 'delta', 'sample') and the columns of each.
    The form is a question of one row each, not a scan."""
    from usagelake.operators.reconcile import interval_events

    has = lambda kind: not rows.where(F.col("kind") == kind).limit(1).isEmpty()
    flat = ("window", "checked_at", "account_id", "model", "delta_percent", "delta_cost")
    if has("interval"):
        swept = interval_events(rows.where("kind = 'interval'"), ["window", "cycle"]).select(*flat)
        return swept.unionByName(rows.where("kind = 'delta'").select(*flat))
    if not has("sample"):
        return rows.where("kind = 'delta'").select(*flat)
    s = batch_series(rows.where("kind = 'sample'").select("account_id", "window", "checked_at", "seq", "used_percent", "plan", "multiplier", "cost", "reset_ts", "unavailable"))
    return s.withColumn("model", F.lit(None).cast("string")).select(*flat)


# -- the batch state machine ---------------------------------------------------------------------------------------------------

SERIES = "account_id string, window string, checked_at string, seq long, raw_percent double, normalized_percent double, delta_percent double, delta_cost double, cost_percent_ratio double, average_ratio double, ratio_deviation_warning boolean, cumulative_percent double, cumulative_cost double"


def _trusted(window: str, plan: str) -> bool:
    return plan in ({"7d": {"plus", "pro_lite", "pro"}, "5h": {"pro_lite", "pro"}}.get(window) or set())


class _Series:
    """State of one account and window while its samples pass in order."""

    def __init__(self):
        self.base = None  # percent, cost, reset, plan, multiplier
        self.prev = self.wait = None
        self.percent = self.cost = 0.0

    def rebase(self, s, percent: float) -> None:
        self.base, self.prev = [percent, s.cost, s.reset_ts, s.plan, s.multiplier], s.cost

    def step(self, s) -> list[tuple]:
        null = lambda x: x is None or x != x
        if s.unavailable:
            self.base = self.prev = None
            self.wait = False
            return []
        if null(s.used_percent):
            return []
        percent = s.used_percent * s.multiplier
        row = lambda dp, dc, r=None, avg=None, warn=None: (s.account_id, s.window, s.checked_at, s.seq, s.used_percent, percent, dp, dc, r, avg, warn, self.percent, self.cost)
        if self.base is None or (s.plan, s.multiplier) != tuple(self.base[3:]):
            first = self.base is None
            self.rebase(s, percent)
            self.wait = _trusted(s.window, s.plan)
            return [row(0.0, 0.0)] if first else []
        if self.wait:
            self.wait = percent <= self.base[0]
            self.rebase(s, percent)
            return []
        if percent < self.base[0]:  # a reset: the new cycle starts at zero, at the cost seen last
            self.base[:3] = [0.0, self.prev, s.reset_ts]
        out = []
        if percent > self.base[0]:
            dp, dc = percent - self.base[0], max(0.0, s.cost - self.base[1])
            if dc / dp >= MIN_COST_PER_PERCENT:
                r, avg = dc / dp, self.cost / self.percent if self.percent > 0 else None
                dev = r / avg if avg else None
                self.percent += dp
                self.cost += dc
                out.append(row(dp, dc, r, avg, dev is not None and (dev >= RATIO_DEVIATION or dev <= 1 / RATIO_DEVIATION)))
            else:
                self.wait = _trusted(s.window, s.plan)
            self.rebase(s, percent)
        else:
            if s.used_percent >= 100:
                self.base[1] = s.cost
            if not null(self.base[2]) and not null(s.reset_ts) and s.reset_ts - self.base[2] > RESET_JITTER_S:
                self.base[2] = s.reset_ts
        self.prev = s.cost
        return out


def batch_series(samples: DataFrame) -> DataFrame:
    """Delta events of samples(account_id, window, checked_at, seq, used_percent, plan, multiplier, cost, reset_ts, unavailable),
    per account and window in order of checked_at, then seq."""
    s = samples.withColumns({"plan": F.coalesce("plan", F.lit("unknown")), "multiplier": F.coalesce(F.nullif("multiplier", F.lit(0.0)), F.lit(float(PLAN_MULTIPLIERS["unknown"]))), "unavailable": F.coalesce("unavailable", F.lit(False))})
    return fold(s.where("checked_at is not null"), ["account_id", "window"], ["checked_at", "seq"], _Series, lambda st, r: st.step(r), SERIES)
