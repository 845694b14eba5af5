"""Counters to token deltas, and tokens to cost."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.dims import DEFAULT_MODEL, FAST_DEFAULT, FAST_MULTIPLIERS, PRICES
from usagelake.functions.scalars import normalize_model

COUNTERS = ["input", "cached", "cache_write", "output"]


def counter_deltas(df: DataFrame, key: list[str], order: list[str], counters: list[str], is_total: str | None = None) -> DataFrame:
    """Add d_<counter>: growth since the last cumulative row of the key, each clamped at 0; the first counts in full.

    Where is_total is false the row is itself a delta and does not move the baseline.
    """
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col(is_total) if is_total else F.lit(True)
    last = F.last(F.when(total, F.struct(*counters)), ignorenulls=True).over(before)
    df = df.withColumn("_last", last)
    delta = lambda c: F.when(total, F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col(f"_last.{c}"), F.lit(0)))).otherwise(F.col(c))
    return df.select("*", *(delta(c).alias(f"d_{c}") for c in counters)).drop("_last")


def carry_forward(df: DataFrame, key: list[str], order: list[str], values: dict[str, Column], defaults: dict[str, Column]) -> DataFrame:
    """Add each named value as last seen at or before the row, or its default."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *(F.coalesce(F.last(v, ignorenulls=True).over(upto), defaults[n]).alias(n) for n, v in values.items()))


def clamp_tokens(df: DataFrame) -> DataFrame:
    """cached <= input, cache_write <= input - cached; rows that are zero throughout go."""
    df = df.withColumn("cached", F.least("cached", "input")).withColumn("cache_write", F.least("cache_write", F.col("input") - F.col("cached")))
    return df.where(reduce(lambda a, b: a | b, (F.col(c) != 0 for c in COUNTERS)))


def first_by_id(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def totals(prefix: str = "") -> list[Column]:
    """The seven sums of token totals, as aggregate columns."""
    p = prefix
    fresh = F.greatest(F.lit(0), F.col("input") - F.col("cached") - F.col("cache_write"))
    return [F.sum("input").alias(f"{p}input_tokens"), F.sum(fresh).alias(f"{p}fresh_input_tokens"), F.sum("cached").alias(f"{p}cached_input_tokens"), F.sum("cache_write").alias(f"{p}cache_write_input_tokens"), F.sum("output").alias(f"{p}output_tokens"), F.sum(F.col("input") + F.col("output")).alias(f"{p}total_tokens"), F.count("*").alias(f"{p}requests")]


def in_range(input: Column, cached: Column, cache_write: Column, legacy_write: Column, output: Column) -> dict[str, Column]:
    """Saved counters with alias and legacy fields brought into range, and the fresh input that is left."""
    z = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    i = z(input)
    c = F.least(i, z(cached))
    w = F.least(i - c, z(F.coalesce(F.nullif(cache_write, F.lit(0)), legacy_write)))
    return {"input": i, "cached": c, "cache_write": w, "output": z(output), "fresh": i - c - w}


def normalize_totals(df: DataFrame) -> DataFrame:
    """Saved totals with alias and legacy fields (input, cached, cache_write, legacy_write, output) brought into range."""
    return df.withColumns(in_range(*map(F.col, ("input", "cached", "cache_write", "legacy_write", "output")))).drop("legacy_write")


def _prefixes(df: DataFrame, name: str) -> DataFrame:
    """(_m, _prefix): the distinct names with each of their prefixes, so that the longest or first key that starts a name is found by an
    equality join, however many keys there are."""
    models = df.select(F.col(name).alias("_m")).distinct()
    return models.select("_m", F.explode(F.transform(F.sequence(F.lit(0), F.length("_m")), lambda n: F.substring("_m", F.lit(1), n))).alias("_prefix"))


def price_by_prefix(df: DataFrame, model: str, prices: DataFrame, key: str) -> DataFrame:
    """Left join with the price row of the model itself or else of the longest key that starts it; only distinct models are looked up."""
    hit = _prefixes(df, model).join(prices, F.col("_prefix") == F.col(key))  # an equal key is the longest prefix
    best = hit.groupBy("_m").agg(F.max_by(F.struct(*prices.columns), F.length(key)).alias("_p"))
    return df.join(best, df[model].eqNullSafe(best["_m"]), "left").select(*df.columns, "_p.*")


def fast_multiplier(df: DataFrame, model: str, multipliers: DataFrame) -> DataFrame:
    """Add fast_multiplier: of the first declared prefix that starts the model, else the default."""
    hit = _prefixes(df, model).join(multipliers, F.col("_prefix") == F.col("prefix"))
    best = hit.groupBy("_m").agg(F.min_by("multiplier", "ord").alias("_x"))
    return df.join(best, df[model].eqNullSafe(best["_m"]), "left").select(*df.columns, F.coalesce("_x", F.lit(FAST_DEFAULT)).alias("fast_multiplier"))


def today(name: Column) -> dict[str, Column]:
    """price (a struct of p_input to p_output, null for an unknown model) and fast_multiplier of a model at the fixed prices, as `price_by_prefix` and `fast_multiplier` find them, without a
    join: for few prices and names that are not worth a pass of their own."""
    best = F.coalesce(*(F.when(name.startswith(k), F.lit(k)) for k in sorted(PRICES, key=len, reverse=True)))
    table = F.create_map(*(x for k, v in PRICES.items() for x in (F.lit(k), F.struct(*(F.lit(y).cast("double").alias(f"p_{c}") for c, y in zip(COUNTERS, v))))))
    x = F.coalesce(*(F.when(name.startswith(k), F.lit(m)) for k, m in FAST_MULTIPLIERS), F.lit(FAST_DEFAULT))
    return {"price": F.try_element_at(table, best), "fast_multiplier": x}


def cost_columns(fast: bool = True, col: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Costs of token sums (input, cached, cache_write, output; f_* of the fast tier) at joined prices, in USD."""
    price = {"fresh": col("p_input"), "cached": F.coalesce(col("p_cached"), col("p_input")), "cache_write": F.coalesce(col("p_cache_write"), col("p_input")), "output": col("p_output")}

    def cost(kind: str) -> Column:
        amount = lambda p: F.greatest(F.lit(0), col(f"{p}input") - col(f"{p}cached") - col(f"{p}cache_write")) if kind == "fresh" else col(f"{p}{kind}")
        base = amount("") * price[kind]
        return F.coalesce((base + amount("f_") * price[kind] * (col("fast_multiplier") - 1) if fast else base) / 1e6, F.lit(0.0))

    parts = {"input_cost": cost("fresh"), "cached_cost": cost("cached"), "cache_write_cost": cost("cache_write"), "output_cost": cost("output")}
    return parts | {"total_cost": reduce(lambda a, b: a + b, parts.values())}


def cost_by_model(events: DataFrame, prices: DataFrame, multipliers: DataFrame, by: list[str] = ()) -> DataFrame:
    """Token sums and costs per model (and further keys) of token events(model, tier, input, cached, cache_write, output)."""
    fast = lambda c: F.sum(F.when(F.col("tier") == "fast", F.col(c)).otherwise(0)).alias(f"f_{c}")
    m = events.withColumn("model", F.coalesce(F.nullif(normalize_model("model"), F.lit("")), F.lit(DEFAULT_MODEL)))
    m = m.groupBy(*by, "model").agg(*(F.sum(c).alias(c) for c in COUNTERS), *(fast(c) for c in COUNTERS), F.count("*").alias("requests"))
    p = prices.select("price_model", *(F.col(c).alias(f"p_{c}") for c in COUNTERS))
    m = fast_multiplier(price_by_prefix(m, "model", p, "price_model"), "model", multipliers)
    return m.select(*by, "model", "requests", *COUNTERS, *(c.alias(n) for n, c in cost_columns().items()))


def session_rollup(events: DataFrame, session: str, model: str, ts: str, tie: str, sums: dict[str, Column]) -> DataFrame:
    """One row per session: first and last time (ties by `tie`), and a map from model to struct of the sums."""
    per_model = events.groupBy(session, model).agg(F.min(F.struct(ts, tie)).alias("_a"), F.max(F.struct(ts, tie)).alias("_b"), *(c.alias(n) for n, c in sums.items()))
    entry = F.struct(F.col(model), F.struct(*sums).alias("v"))
    return per_model.groupBy(session).agg(F.min("_a")[ts].alias("started_at"), F.max("_b")[ts].alias("updated_at"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_model"))


def progress(now: DataFrame, before: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Growth of each value since the snapshot before, clamped at 0; keys of either side."""
    b = before.select(*key, *(F.col(v).alias(f"_b_{v}") for v in values))
    j = now.join(b, key, "full_outer")
    return j.select(*key, *(F.greatest(F.lit(0), F.coalesce(v, F.lit(0)) - F.coalesce(f"_b_{v}", F.lit(0))).alias(v) for v in values))
