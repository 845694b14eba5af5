"""Registered queries of the library over the driver's tables, each with its equivalent SQL.

In `events` the user stands for account or session, event_type for the model, value for cost, props.k (0 to 99) for a percent or
counter, ts for the time of a reading and event_id for the order of input. Money is DECIMAL before it is summed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake import dims
from usagelake.functions import scalars as Z
from usagelake.operators import attribution, deltas, journal, quota, reconcile, tokens
from usagelake.plans import projections, serving
from usagelake.session import shared_dir, spread, table
from usagelake.sources import histories
from usagelake.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Prices of event types as if they were models, per unit of k. Fixed values of this test set.
RATES = {"click": "0.10", "error": "0.00", "purchase": "1.25", "signup": "0.50", "view": "0.02"}
#: Price keys for prefix matching over part types.
PART_RATES = {"STANDARD": "1.00", "SMALL": "2.00", "MEDIUM": "3.00", "LARGE": "4.00", "ECONOMY": "5.00", "PROMO": "6.00", "STANDARD ANODIZED": "1.50", "SMALL PLATED": "2.50", "PROMO BURNISHED": "6.50", "ECONOMY ANODIZED STEEL": "5.75"}

E = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(value AS DECIMAL(18,2)) AS v, CAST(ts AS DATE) AS day FROM events)"


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def ev(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").cast("decimal(18,2)").alias("v"), F.to_date("ts").alias("day"))


def rates(spark: SparkSession, values: dict[str, str], key: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), f"{key} string, rate string").withColumn("rate", F.col("rate").cast("decimal(9,2)"))


def _values(values: dict[str, str]) -> str:
    return ", ".join(f"('{k}', CAST({v} AS DECIMAL(9,2)))" for k, v in values.items())


# -- tokens and cost --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, d AS (SELECT *, greatest(0, k - coalesce(lag(k) OVER w, 0)) AS dk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p(model, rate) AS (VALUES {_values(RATES)})
SELECT event_type AS model, count(*) AS requests, sum(dk) AS units, CAST(sum(dk * rate) AS DOUBLE) AS cost FROM d JOIN p ON event_type = model WHERE dk > 0 GROUP BY 1""")
def q_cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Counter growth per user, priced by the model of the row."""
    d = tokens.counter_deltas(ev(spark, sf), ["user_id"], ["ts", "event_id"], ["k"]).where("d_k > 0")
    d = d.join(F.broadcast(rates(spark, RATES, "model")), F.col("event_type") == F.col("model"))  # five fixed rows
    return d.groupBy("model").agg(F.count("*").alias("requests"), F.sum("d_k").alias("units"), F.sum(F.col("d_k") * F.col("rate")).cast("double").alias("cost"))


@query(f"""WITH p(key, rate) AS (VALUES {_values(PART_RATES)})
SELECT p_partkey, arg_max(key, length(key)) AS price_key, CAST(arg_max(rate, length(key)) AS DOUBLE) AS rate FROM part LEFT JOIN p ON starts_with(p_type, key) GROUP BY 1""")
def q_prefix_price(spark: SparkSession, sf: str) -> DataFrame:
    """The longest price key that starts the type."""
    p = rates(spark, PART_RATES, "key").withColumnRenamed("key", "price_key")
    return tokens.price_by_prefix(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", p, "price_key").select("p_partkey", "price_key", F.col("rate").cast("double").alias("rate"))


@query("""WITH p(ord, prefix, x) AS (VALUES (0, 'PROMO', 3.0), (1, 'PRO', 9.0), (2, 'S', 4.0), (3, 'SMALL', 5.0))
SELECT p_partkey, CAST(coalesce(arg_min(x, ord), 2.0) AS DOUBLE) AS fast_multiplier FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY 1""")
def q_first_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The first declared prefix, else a default."""
    m = spark.createDataFrame([(0, "PROMO", 3.0), (1, "PRO", 9.0), (2, "S", 4.0), (3, "SMALL", 5.0)], "ord int, prefix string, multiplier double")
    return tokens.fast_multiplier(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", m).select("p_partkey", "fast_multiplier")


@query(f"""WITH {E} SELECT event_id, user_id, greatest(0, k - coalesce(lag(k) OVER w, 0)) AS d_k FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_counter_delta(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.counter_deltas(ev(spark, sf), ["user_id"], ["ts", "event_id"], ["k"]).select("event_id", "user_id", "d_k")


@query(f"""WITH {E} SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS last_purchase FROM e""")
def q_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """W2."""
    c = tokens.carry_forward(ev(spark, sf), ["user_id"], ["ts", "event_id"], {"last_purchase": F.when(F.col("event_type") == "purchase", F.col("value"))}, {"last_purchase": F.lit(0.0)})
    return c.select("event_id", "user_id", "last_purchase")


@query(f"""WITH {E}, c AS (SELECT event_id, user_id, ts, k AS input, least(k, 30) AS cached, least(50, greatest(0, k - least(k, 30))) AS cache_write, k % 7 AS output FROM e)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS index, input, cached, cache_write, output FROM c WHERE input <> 0 OR cached <> 0 OR cache_write <> 0 OR output <> 0""")
def q_clamped_index(spark: SparkSession, sf: str) -> DataFrame:
    """Clamped counters; rows of zeros get no number."""
    e = ev(spark, sf).select("event_id", "user_id", "ts", F.col("k").alias("input"), F.lit(30).alias("cached"), F.lit(50).alias("cache_write"), (F.col("k") % 7).alias("output"))
    return tokens.clamp_tokens(e).select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("index"), *tokens.COUNTERS)


@query(f"""WITH {E} SELECT user_id, event_type, event_id, k FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def q_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A15."""
    return tokens.first_by_id(ev(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "k")


@query(f"""WITH {E}, s AS (SELECT user_id, min(ts) AS started_at, max(ts) AS updated_at FROM e GROUP BY 1)
SELECT e.user_id, any_value(started_at) AS started_at, any_value(updated_at) AS updated_at, event_type AS model, sum(k) AS units, count(*) AS requests FROM e JOIN s ON e.user_id = s.user_id GROUP BY e.user_id, event_type""")
def q_session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with a map by model, given out as rows."""
    s = tokens.session_rollup(ev(spark, sf), "user_id", "event_type", "ts", "event_id", {"units": F.sum("k"), "requests": F.count("*")})
    return s.select("user_id", "started_at", "updated_at", F.explode("by_model").alias("model", "v")).select("user_id", "started_at", "updated_at", "model", "v.units", "v.requests")


@query(f"""WITH {E} SELECT event_type, sum(k) AS input_tokens, sum(greatest(0, k - k // 2 - k // 4)) AS fresh_input_tokens, sum(k // 2) AS cached_input_tokens, sum(k // 4) AS cache_write_input_tokens, sum(k % 9) AS output_tokens, sum(k + k % 9) AS total_tokens, count(*) AS requests FROM e GROUP BY 1""")
def q_token_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    e = ev(spark, sf).select("event_type", F.col("k").alias("input"), F.expr("k div 2").alias("cached"), F.expr("k div 4").alias("cache_write"), (F.col("k") % 9).alias("output"))
    return e.groupBy("event_type").agg(*tokens.totals())


@query(f"""WITH {E}, t AS (SELECT day, event_type, sum(v) AS total FROM e GROUP BY 1, 2), n AS (SELECT max(day) AS d FROM e),
a AS (SELECT event_type, total FROM t, n WHERE day = d), b AS (SELECT event_type, total FROM t, n WHERE day = d - 1)
SELECT event_type, CAST(greatest(0, coalesce(a.total, 0) - coalesce(b.total, 0)) AS DOUBLE) AS total FROM a FULL JOIN b USING (event_type)""")
def q_progress(spark: SparkSession, sf: str) -> DataFrame:
    """J8."""
    t = ev(spark, sf).groupBy("day", "event_type").agg(F.sum("v").alias("total"))
    last = t.agg(F.max("day")).scalar()
    now, before = t.where(F.col("day") == last).select("event_type", "total"), t.where(F.col("day") == F.date_sub(last, 1)).select("event_type", "total")
    return tokens.progress(now, before, ["event_type"], ["total"]).withColumn("total", F.col("total").cast("double"))


@query(f"""WITH {E}, t AS (SELECT event_type, sum(k) AS k, sum(CASE WHEN user_id % 5 = 0 THEN k ELSE 0 END) AS f FROM e GROUP BY 1)
SELECT event_type AS model, CAST((k * 5 + f * 5 * 1.5) AS DOUBLE) / 1e6 AS input_cost FROM t""")
def q_fast_surcharge(spark: SparkSession, sf: str) -> DataFrame:
    """A4: the fast tier pays a surcharge on its share (price 5, multiplier 2.5)."""
    e = ev(spark, sf).groupBy(F.col("event_type").alias("model")).agg(F.sum("k").alias("input"), F.sum(F.when(F.col("user_id") % 5 == 0, F.col("k")).otherwise(0)).alias("f_input"))
    zero = {c: F.lit(0) for p in ("", "f_") for c in (f"{p}cached", f"{p}cache_write", f"{p}output")}
    e = e.withColumns(zero | {"p_input": F.lit(5.0), "p_cached": F.lit(None).cast("double"), "p_cache_write": F.lit(None).cast("double"), "p_output": F.lit(30.0), "fast_multiplier": F.lit(2.5)})
    return e.select("model", tokens.cost_columns()["input_cost"].alias("input_cost"))


@query(f"""WITH {E}, a AS (SELECT event_id, k AS i, k % 60 AS c, CASE WHEN k % 2 = 0 THEN 0 ELSE k % 13 END AS w, k % 17 AS l FROM e)
SELECT event_id, i AS input, least(i, c) AS cached, least(i - least(i, c), CASE WHEN w = 0 THEN l ELSE w END) AS cache_write, i - least(i, c) - least(i - least(i, c), CASE WHEN w = 0 THEN l ELSE w END) AS fresh FROM a""")
def q_saved_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Saved totals with a legacy field."""
    e = ev(spark, sf).select("event_id", F.col("k").alias("input"), (F.col("k") % 60).alias("cached"), F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("k") % 13).alias("cache_write"), (F.col("k") % 17).alias("legacy_write"), F.lit(0).alias("output"))
    return tokens.normalize_totals(e).select("event_id", "input", "cached", "cache_write", "fresh")


@query(f"""WITH {E}, p AS (SELECT event_id // 3 AS g, event_id % 3 AS i, k + 1 AS c, CASE WHEN event_id // 3 % 3 = 0 THEN 2.0 * (k + 1) ELSE k + 0.5 END AS p, CASE WHEN event_id // 3 % 4 = 1 THEN event_id % 2 ELSE 0 END AS a FROM e),
t AS (SELECT g, count(*) AS n, count(DISTINCT a) AS accounts, sum(p) AS p, sum(c) AS c FROM p GROUP BY 1),
j AS (SELECT g, n, accounts, bool_and(abs(p.p - t.p * p.c / t.c) <= 1e-8) AND max(p.c / p.p) - min(p.c / p.p) <= 1e-8 AS even FROM p JOIN t USING (g) GROUP BY ALL)
SELECT t.g AS checked_at, CASE WHEN t.n > 1 AND t.accounts = 1 AND even THEN 'models' ELSE 'list' END AS form, t.n AS parts, CAST(round(t.p, 8) AS DOUBLE) AS delta_percent FROM t JOIN j USING (g)""")
def q_pack_models(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one time as a split where accounts, percents and ratios allow it."""
    g, c = F.floor(F.col("event_id") / 3), (F.col("k") + 1).cast("double")
    p = F.when(g % 3 == 0, 2.0 * c).otherwise(F.col("k") + 0.5)
    account = F.when(g % 4 == 1, F.col("event_id") % 2).otherwise(0).cast("string")
    e = ev(spark, sf).select(F.lit("5h").alias("window"), g.alias("checkedAt"), F.concat(F.lit("m"), F.col("event_id") % 3).alias("model"), account.alias("accountSlotId"), p.alias("deltaPercent"), c.alias("deltaCostUsd"))
    return deltas.pack_models(e).select(F.col("checkedAt").alias("checked_at"), "form", F.size("parts").alias("parts"), F.col("deltaPercent").alias("delta_percent"))


@query(f"""WITH {E}, own AS (SELECT user_id % 50 AS u, event_id, k FROM e WHERE event_id % 3 = 0), other AS (SELECT user_id % 50 AS u, event_id, k, event_id % 5 = 0 AS mine FROM e WHERE event_id % 3 <> 0),
q AS (SELECT 'a' || u AS account_key, k % 7 AS checked_at, event_id AS seq, k FROM own UNION ALL SELECT CASE WHEN u % 2 = 0 THEN 'a' || u ELSE 'local:' || CASE WHEN u % 3 = 0 THEN 's' ELSE 'x' END END, k % 7, event_id, k FROM other WHERE NOT mine)
SELECT account_key, CAST(checked_at AS VARCHAR) AS checked_at, CAST(arg_max(k, seq) AS DOUBLE) AS used_percent FROM q GROUP BY 1, 2""")
def q_merged_quota(spark: SparkSession, sf: str) -> DataFrame:
    """M9: quota rows of this machine and of others' cached ones that are not its own, by account and time, the later ones winning."""
    u = F.col("user_id") % 50
    row = lambda where, account, slot, origin: ev(spark, sf).where(where).select(account.alias("account_id"), slot.alias("account_slot"), (F.col("k") % 7).cast("string").alias("checked_at"), F.lit("5h").alias("window"), F.col("k").cast("double").alias("used_percent"), F.lit("r").alias("reset_at"), F.lit("plus").alias("plan"), F.col("event_id").alias("seq"), origin.alias("origin"))
    named = F.concat(F.lit("a"), u)
    local = row("event_id % 3 = 0", named, F.lit("s"), F.lit("me"))
    cache = row("event_id % 3 <> 0", F.when(u % 2 == 0, named), F.when(u % 3 == 0, "s").otherwise("x"), F.when(F.col("event_id") % 5 == 0, "me").otherwise("you"))
    none = local.limit(0).withColumns({"record_type": F.lit("costInterval"), "record_key": F.lit("k"), "session_id": F.lit("s"), "updated_ts": F.lit(0), "total_tokens": F.lit(0), "content_hash": F.lit("h")})
    merged = reconcile.merged_datasets({"cost": none, "quota": local, "token": none}, {"cost": none, "quota": cache, "token": none}, "me")["quota"]
    return merged.select("account_key", "checked_at", "used_percent")


_A, _B = dims.PRICES["gpt-5.4"], dims.PRICES["gpt-5.6-sol"]


@query(f"""WITH {E}, s AS (SELECT event_id, k, 1000 * k AS i, least(1000 * k, 37 * k) AS c, 10 * (k % 9) AS o FROM e WHERE k % 5 <> 4),
w AS (SELECT *, least(i - c, 11 * (k % 3)) AS w FROM s),
m AS (SELECT *, ((i - c - w) * {_A[0]} + c * {_A[1]} + w * {_A[0]} + o * {_A[3]}) / 1e6 AS a, ((i - c - w) * {_B[0]} + c * {_B[1]} + w * {_B[2]} + o * {_B[3]}) / 1e6 AS b, 10 * k * {_B[0]} * 1.5 / 1e6 AS f FROM w)
SELECT 's' || event_id AS session_id, CASE WHEN k % 5 IN (0, 1) THEN 't' ELSE 'u' END AS updated_at, i AS input, i - c - w AS fresh, CASE k % 5 WHEN 3 THEN 0 ELSE 2 END AS models,
       round(CASE k % 5 WHEN 3 THEN 1.25 ELSE round(a, 8) + round(b + f, 8) END, 6) AS total_cost FROM m""")
def q_token_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Saved sessions with two models, one with fast tokens, or with none but saved costs, or without tokens."""
    tokens_ = '{"inputTokens":%d,"cachedInputTokens":%d,"cachedOutputTokens":%d,"outputTokens":%d}'
    models = '{"openai/gpt-5.4-2026-01-31":{"tokens":' + tokens_ + '},"gpt-5.6-sol":{"tokens":' + tokens_ + ',"fastTokens":{"inputTokens":%d}},"no":3}'
    one = [F.col("k") * 1000, F.col("k") * 37, F.col("k") % 3 * 11, F.col("k") % 9 * 10]
    dated = F.when((F.col("k") % 5).isin(0, 1), "t").otherwise("u")
    whole = F.format_string('{"sessionId":"s%d","startedAt":"t","updatedAt":"%s","tokens":' + tokens_ + ',"byModel":' + models + "}", "event_id", F.when(dated == "t", "").otherwise("u"), *one, *one, *one, F.col("k") * 10)
    saved = F.format_string('{"sessionId":"s%d","updatedAt":"u","tokens":' + tokens_ + ',"cost":{"totalCostUsd":1.25},"byModel":{}}', "event_id", *one)
    lost = F.format_string('{"sessionId":"s%d","byModel":{"gpt-5.4":{"tokens":{}}}}', "event_id")
    value = F.when(F.col("k") % 5 == 4, lost).when(F.col("k") % 5 == 3, saved).otherwise(whole)
    s = histories.normalized_sessions(ev(spark, sf).select(F.lit("f").alias("file"), F.col("event_id").alias("pos"), value.alias("value")))
    return s.select("session_id", "updated_at", F.col("tokens.input").alias("input"), F.col("tokens.fresh").alias("fresh"), F.size("by_model").alias("models"), F.round("cost.total_cost", 6).alias("total_cost"))


# -- runs, clusters, merges ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, s AS (SELECT *, k // 25 AS state FROM e), c AS (SELECT *, CASE WHEN state = lag(state) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1) AS next FROM c) SELECT event_id, user_id, state FROM n WHERE fresh = 1 OR next = 1""")
def q_plateau(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of runs of one state per user."""
    key, order = ["user_id"], ["ts", "event_id"]
    s = ev(spark, sf).withColumn("state", F.expr("k div 25"))
    return reconcile.run_ends(s, key, order, F.col("state") == reconcile.previous("state", key, order)).select("event_id", "user_id", "state")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT event_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT user_id, n, event_id, k, k AS anchor, 1 AS fresh FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.n, o.event_id, o.k, CASE WHEN abs(o.k - r.anchor) <= 20 THEN r.anchor ELSE o.k END, CASE WHEN abs(o.k - r.anchor) <= 20 THEN 0 ELSE 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1),
m AS (SELECT *, coalesce(lead(fresh) OVER (PARTITION BY user_id ORDER BY n), 1) AS next FROM r)
SELECT event_id, user_id, k FROM m WHERE fresh = 1 OR next = 1""")
def q_plateau_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of runs that stay within 20 of their first k."""
    s = ev(spark, sf).select("event_id", "user_id", "ts", "k")
    return reconcile.anchored_run_ends(s, ["user_id"], ["ts", "event_id"], [], "k", 20).select("event_id", "user_id", "k")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS n FROM o),
r AS (SELECT user_id, n, s, s AS anchor FROM n WHERE n = 1 UNION ALL SELECT n.user_id, n.n, n.s, CASE WHEN n.s - r.anchor <= 86400 THEN r.anchor ELSE n.s END FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1)
SELECT e.event_id, e.user_id, r.anchor AS cycle FROM e JOIN r ON e.user_id = r.user_id AND CAST(floor(epoch(e.ts)) AS BIGINT) = r.s""")
def q_anchor_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of at most a day from their first event."""
    s = ev(spark, sf).select("event_id", "user_id", F.unix_timestamp("ts").alias("s"))
    return reconcile.with_cycle(s, ["user_id"], "s", 86400).select("event_id", "user_id", "cycle")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s) AS n FROM o),
r AS (SELECT event_type, n, s, s AS anchor FROM n WHERE n = 1 UNION ALL SELECT n.event_type, n.n, n.s, CASE WHEN n.s - r.anchor <= 7200 THEN r.anchor ELSE n.s END FROM r JOIN n ON n.event_type = r.event_type AND n.n = r.n + 1)
SELECT e.event_id, e.event_type, r.anchor AS cycle FROM e JOIN r ON e.event_type = r.event_type AND CAST(floor(epoch(e.ts)) AS BIGINT) = r.s""")
def q_hot_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """A8 for keys of any size: anchors by jump pointers, cycles carried over blocks."""
    s = ev(spark, sf).select("event_id", "event_type", F.unix_timestamp("ts").alias("s"))
    return reconcile.with_cycle(s, ["event_type"], "s", 7200, hot_rows=0).select("event_id", "event_type", "cycle")


_SWEEP = f"""WITH {E}, i AS (SELECT day, event_type AS model, CAST(k AS DOUBLE) AS a, CAST(k + 1 + event_id % 5 AS DOUBLE) AS b, CAST(v / (1 + event_id % 5) AS DECIMAL(28,12)) AS rate FROM e WHERE v > 0),
p AS (SELECT day, a AS x FROM i UNION SELECT day, b FROM i), s AS (SELECT day, x, lead(x) OVER (PARTITION BY day ORDER BY x) AS y FROM p),
m AS (SELECT s.day, x, y, model, sum(rate) AS rate FROM s JOIN i ON i.day = s.day AND a <= x AND b >= y GROUP BY ALL)"""


@query(f"""{_SWEEP} SELECT day, x AS segment_start, y AS segment_end, model, round(CAST(rate AS DOUBLE), 4) AS rate FROM (SELECT *, sum(rate) OVER (PARTITION BY day, x) AS total FROM m) WHERE total >= 0.01""")
def q_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of overlapping intervals per day over elementary segments."""
    i = ev(spark, sf).select("day", F.col("event_type").alias("model"), F.col("k").cast("double").alias("a"), (F.col("k") + 1 + F.col("event_id") % 5).cast("double").alias("b"), F.col("v").cast("double").alias("cost"))
    s = reconcile.sweep(i, ["day"], "a", "b", "model", "cost")
    return s.select("day", "segment_start", "segment_end", "model", F.round(F.col("rate").cast("double"), 4).alias("rate"))


@query(f"""{_SWEEP}, z AS (SELECT * FROM (SELECT *, sum(rate) OVER (PARTITION BY day, x) AS total FROM m) WHERE total >= 0.01)
SELECT day, model, count(*) AS segments, round(sum(CAST(rate AS DOUBLE) * (y - x)), 3) AS delta_cost, round(sum((y - x) * CAST(rate AS DOUBLE) / CAST(total AS DOUBLE)), 3) AS delta_percent FROM z GROUP BY 1, 2""")
def q_interval_events(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows of the sweep, summed per day and model."""
    i = ev(spark, sf).where("v > 0").select("day", F.col("event_id").alias("seq"), F.col("ts").cast("string").alias("started_at"), F.col("ts").cast("string").alias("checked_at"), F.col("user_id").cast("string").alias("account_id"), F.col("k").cast("double").alias("start_percent"), (F.col("k") + 1 + F.col("event_id") % 5).cast("double").alias("end_percent"), F.create_map("event_type", F.col("v").cast("double")).alias("models"))
    r = reconcile.interval_events(i, ["day"])
    return r.groupBy("day", "model").agg(F.count("*").alias("segments"), F.round(F.sum("delta_cost"), 3).alias("delta_cost"), F.round(F.sum("delta_percent"), 3).alias("delta_percent"))


_HALVES = f"{E}, h AS (SELECT user_id, date_trunc('hour', ts) AS hour, CASE WHEN k % 2 = 0 THEN '5h' ELSE '7d' END AS win, k, event_id, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE event_type END AS plan FROM e)"


@query(f"""WITH {_HALVES} SELECT user_id, hour, win AS usage_window, arg_max(k, event_id) AS used_percent, coalesce(arg_max(plan, event_id) FILTER (plan <> 'unknown'), 'unknown') AS plan FROM h GROUP BY 1, 2, 3""")
def q_merge_known_plan(spark: SparkSession, sf: str) -> DataFrame:
    """M1: the last reading wins, but a known plan stays."""
    return _merge(spark, sf, True)


@query(f"""WITH {_HALVES} SELECT user_id, hour, win AS usage_window, arg_max(k, event_id) AS used_percent, arg_max(plan, event_id) AS plan FROM h GROUP BY 1, 2, 3""")
def q_merge_lastwins(spark: SparkSession, sf: str) -> DataFrame:
    """M2."""
    return _merge(spark, sf, False)


def _merge(spark: SparkSession, sf: str, known: bool) -> DataFrame:
    h = ev(spark, sf).select("user_id", F.date_trunc("hour", "ts").alias("hour"), F.when(F.col("k") % 2 == 0, "5h").otherwise("7d").alias("window"), F.col("k").alias("used_percent"), F.lit("").alias("reset_at"), F.when(F.col("k") % 3 == 0, "unknown").otherwise(F.col("event_type")).alias("plan"), F.col("event_id").alias("seq"))
    return reconcile.merge_windows(h, ["user_id", "hour"], "seq", known).drop("reset_at").withColumnRenamed("window", "usage_window")


@query(f"""WITH {E} SELECT user_id, event_type, day AS updated, k AS total_tokens, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, k DESC, lpad(CAST(event_id AS VARCHAR), 12, '0') DESC) = 1""")
def q_token_merge(spark: SparkSession, sf: str) -> DataFrame:
    """M3: latest update, then most tokens, then the largest hash (here the id)."""
    e = ev(spark, sf).select("user_id", "event_type", F.col("day").alias("updated"), F.col("day").alias("updated_ts"), F.col("k").alias("total_tokens"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("content_hash"), "event_id")
    return reconcile.merge_tokens(e, ["user_id", "event_type"]).select("user_id", "event_type", "updated", "total_tokens", "event_id")


@query(f"""WITH {E}, t AS (SELECT user_id, k // 10 AS total, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY k // 10 DESC) AS r FROM e) SELECT user_id, count(DISTINCT event_id) AS contents FROM t WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT event_id) > 1""")
def q_token_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose greatest total comes with several contents."""
    e = ev(spark, sf).select("user_id", F.lit(0).alias("updated_ts"), F.expr("k div 10").alias("total_tokens"), F.col("event_id").alias("content_hash"))
    return reconcile.token_conflicts(e, ["user_id"])


@query(f"""WITH {E}, r AS (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE 'costInterval' END AS t, user_id, k, event_id FROM e)
SELECT user_id, k, event_id FROM r WHERE t IS NULL UNION ALL SELECT user_id, k, event_id FROM r WHERE t = 'costInterval' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1""")
def q_cost_merge(spark: SparkSession, sf: str) -> DataFrame:
    """M4, F8: legacy rows stay, intervals of one key: the last."""
    e = ev(spark, sf).select("user_id", "k", "event_id", F.when(F.col("event_type") != "view", "costInterval").alias("record_type"), F.concat_ws(":", "user_id", "k").alias("record_key"))
    return reconcile.merge_costs(e, "event_id").select("user_id", "k", "event_id")


@query(f"""WITH {E} SELECT event_id, sha256('token:' || user_id || ':' || event_id) AS record_id, CASE WHEN user_id % 3 = 0 THEN 'other' ELSE 'm1' END AS origin FROM e WHERE user_id % 3 <> 0
UNION ALL SELECT event_id, 'given' AS record_id, 'other' AS origin FROM e WHERE user_id % 3 = 0""")
def q_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """M5, M6: stamped once, deterministic."""
    e = ev(spark, sf).select("event_id", "user_id", F.when(F.col("user_id") % 3 == 0, "other").alias("origin"), F.when(F.col("user_id") % 3 == 0, "given").alias("record_id"))
    once = reconcile.with_provenance(e, "token", "m1", ["user_id", "event_id"])
    return reconcile.with_provenance(once, "token", "m2", ["user_id", "event_id"]).select("event_id", "record_id", "origin")


@query(f"""WITH {E}, t AS (SELECT user_id, event_id, event_type, CASE WHEN k % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H') ELSE strftime(ts, '%Y-%m-%d') END AS told, CASE WHEN k % 3 = 0 THEN '5h' ELSE '7d' END AS w FROM e)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY told, w, event_id) AS place, row_number() OVER (PARTITION BY user_id ORDER BY told, w, event_type, event_id) AS model_place FROM t""")
def q_text_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places of ledger rows and of aggregated rows, by the texts of their times."""
    at = F.when(F.col("k") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    e = ev(spark, sf).select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("model"), at.alias("checked_at"), F.when(F.col("k") % 3 == 0, "5h").otherwise("7d").alias("window"))
    place = lambda order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return e.select(F.col("seq").alias("event_id"), place(reconcile.ledger_order()).alias("place"), place([*reconcile.interval_order("model"), F.col("seq")]).alias("model_place"))


# -- attribution -----------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, a AS (SELECT user_id, event_id, ts FROM e WHERE event_type = 'view'), b AS (SELECT user_id, ts, event_id AS signup_id, k AS signup_k FROM e WHERE event_type = 'signup')
SELECT a.event_id, a.user_id, b.signup_id, b.signup_k FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def q_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The latest signup of the user at or before each view."""
    e = ev(spark, sf)
    a = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("k").alias("signup_k"))
    return attribution.as_of(a, b, ["user_id"], "ts", "ts", ["signup_id"], ["signup_id", "signup_k"]).select("event_id", "user_id", "signup_id", "signup_k")


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS account, o_totalprice AS total FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_orderstatus AS account, o_totalprice + 1 AS total FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, coalesce(o.account, n.account) AS account, CASE WHEN n.total IS NOT NULL THEN n.total ELSE o.total END AS total FROM o FULL JOIN n USING (o_orderkey)""")
def q_sticky(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert that keeps the first account."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("account"), F.col("o_totalprice").alias("total"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("account"), (F.col("o_totalprice") + 1).alias("total"))
    return attribution.sticky_upsert(old, new, ["o_orderkey"], ["account"])


@query("""WITH m AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS id FROM customer GROUP BY 1)
SELECT s_suppkey AS login_id, coalesce(c.c_custkey, CASE WHEN m.n = 1 THEN m.id END) AS account_id FROM supplier LEFT JOIN customer c ON s_suppkey % 7 = 0 AND c.c_custkey = s_suppkey LEFT JOIN m ON m.c_nationkey = s_nationkey""")
def q_login_account(spark: SparkSession, sf: str) -> DataFrame:
    """By account id, else by an e-mail (here the nation) that is one account's only."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("login_id"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey")).alias("auth_account"), F.lit(None).cast("string").alias("auth_token_hash"), F.col("s_nationkey").cast("string").alias("email"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_custkey").alias("auth_account"), F.lit("x").alias("auth_token_hash"), F.col("c_nationkey").cast("string").alias("email"))
    return attribution.login_account(s, c.withColumn("auth_token_hash", F.lit(None).cast("string"))).select("login_id", "account_id")


@query("""SELECT c_custkey, coalesce(n_name, 'cloud-usage-' || left(c_name, 16)) AS account_label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0""")
def q_local_account(spark: SparkSession, sf: str) -> DataFrame:
    """J10."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("usage_account"))
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_name")
    mapping = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("usage_account", F.col("n_name").alias("account_slot"), F.col("n_name").alias("account_label"))
    return attribution.local_account(c, mapping).select("c_custkey", "account_label")


# -- ledgers --------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, f AS (SELECT event_id, ts, day, event_type, k, v FROM e WHERE k > 0 AND CAST(v AS DOUBLE) / k >= 0.01),
s AS (SELECT event_id, event_type, k, CAST(v AS DOUBLE) AS v, sum(k) OVER (PARTITION BY day ORDER BY ts, event_id) AS ck, CAST(sum(v) OVER (PARTITION BY day ORDER BY ts, event_id) AS DOUBLE) AS cv,
 sum(k) OVER b AS bk, CAST(sum(v) OVER b AS DOUBLE) AS bv FROM f WINDOW b AS (PARTITION BY day, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, event_type, v / k AS cost_percent_ratio, bv / bk AS average_ratio, ck AS cumulative_percent, cv AS cumulative_cost, coalesce((v / k) / (bv / bk) >= 3 OR (v / k) / (bv / bk) <= 1.0 / 3, false) AS warning FROM s""")
def q_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums per day and model, ratios against the model's earlier average."""
    led = deltas.ledger(ev(spark, sf), ["day"], "event_type", ["ts", "event_id"], "k", "v")
    return led.select("event_id", "event_type", "cost_percent_ratio", "average_ratio", "cumulative_percent", F.col("cumulative_cost").cast("double").alias("cumulative_cost"), F.col("ratio_deviation_warning").alias("warning"))


@query(f"""WITH {E}, f AS (SELECT event_id, ts, event_type, k, v FROM e WHERE k > 0 AND CAST(v AS DOUBLE) / k >= 0.01)
SELECT event_id, sum(k) OVER a AS cumulative_percent, CAST(sum(v) OVER a AS DOUBLE) AS cumulative_cost, sum(k) OVER m AS model_percent, CAST(sum(v) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / sum(k) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS average_ratio
FROM f WINDOW a AS (ORDER BY ts, event_id), m AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def q_hot_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """W4 over one key of all events, in blocks."""
    led = deltas.ledger(ev(spark, sf).withColumn("all", F.lit("all")), ["all"], "event_type", ["ts", "event_id"], "k", "v", hot_rows=0)
    return led.select("event_id", "cumulative_percent", F.col("cumulative_cost").cast("double").alias("cumulative_cost"), F.col("model_cumulative_percent").alias("model_percent"), "average_ratio")


@query(f"""WITH {E}, l AS (SELECT day, event_type, sum(k) AS p, CAST(sum(v) AS DOUBLE) AS c FROM e WHERE k > 0 AND CAST(v AS DOUBLE) / k >= 0.01 GROUP BY 1, 2) SELECT day, event_type, CAST(p AS DOUBLE) AS cumulative_percent, round(c, 4) AS cumulative_cost FROM l""")
def q_last_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """The state to go on from, per day and model."""
    e = ev(spark, sf).select("event_id", "ts", "day", "event_type", F.col("k").cast("double").alias("k"), F.col("v").cast("double").alias("v"))
    led = deltas.ledger(e, ["day"], "event_type", ["ts", "event_id"], "k", "v")
    led = led.withColumns({"cumulative_percent": F.col("model_cumulative_percent"), "cumulative_cost": F.col("model_cumulative_cost")})
    return deltas.last_cumulative(led, ["day", "event_type"], F.struct("ts", "event_id")).withColumn("cumulative_cost", F.round("cumulative_cost", 4))


@query(f"""WITH {E}, s AS (SELECT event_id, k, k % 7 AS a, k % 5 AS c FROM e)
SELECT event_id, 'a' AS model, round(CAST(k AS DOUBLE) * a / (a + c), 8) AS delta_percent, CAST(a AS DOUBLE) AS delta_cost FROM s WHERE a + c > 0
UNION ALL SELECT event_id, 'c', round(k - CAST(k AS DOUBLE) * a / (a + c), 8), CAST(c AS DOUBLE) FROM s WHERE a + c > 0
UNION ALL SELECT event_id, 'x', 1.5, 2.5 FROM s UNION ALL SELECT event_id, 'y', CAST(k AS DOUBLE), 1.0 FROM s""")
def q_grouped_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped rows with a split (one model without a cost), a list of events (one with models of its own) and a single event."""
    split = '{"checkedAt":"%d","deltaPercent":%d,"models":[{"model":"a","deltaCostUsd":%d},{"model":"b"},{"deltaCostUsd":4},7,{"model":"c","deltaCostUsd":%d}]}'
    listed = '[{"checkedAt":"%d","model":"x","deltaPercent":1.5,"deltaCostUsd":2.5,"models":[{"model":"z","deltaCostUsd":1}]},3]'
    text = F.format_string('{"window":"5h","delta":[' + split + "," + listed + ',{"checkedAt":"%d","model":"y","deltaPercent":%d,"deltaCostUsd":1}]}', "event_id", "k", F.col("k") % 7, F.col("k") % 5, "event_id", "event_id", "k")
    e = deltas.expand_grouped(ev(spark, sf).select(text.alias("value")))
    return e.select(F.col("checkedAt").cast("long").alias("event_id"), "model", F.col("deltaPercent").alias("delta_percent"), F.col("deltaCostUsd").alias("delta_cost"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, sum(q) OVER (PARTITION BY l_orderkey) AS w FROM l)
SELECT l_orderkey, round(sum(CAST(t AS DOUBLE) * CAST(q AS DOUBLE) / CAST(w AS DOUBLE)), 2) AS total, count(*) AS parts FROM s WHERE w > 0 GROUP BY 1""")
def q_split(spark: SparkSession, sf: str) -> DataFrame:
    """An order's price over its lines by quantity, the last line taking the rest; the shares add up."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    j = spread(lines, "l_orderkey").join(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("t")), F.col("l_orderkey") == F.col("o_orderkey"))
    s = deltas.proportional_split(j, ["l_orderkey"], "l_linenumber", "q", F.col("t"), "share")
    return s.groupBy("l_orderkey").agg(F.round(F.sum("share"), 2).alias("total"), F.count("*").alias("parts"))


@query(f"""WITH {E}, g AS (SELECT user_id, event_type, CAST(sum(v) AS DOUBLE) AS c, any_value(user_id % 40 * 100.0) AS d FROM e GROUP BY 1, 2), t AS (SELECT user_id, sum(greatest(c, 0)) AS s, any_value(d) AS d FROM g GROUP BY 1)
SELECT g.user_id, event_type, round(CASE WHEN s > t.d THEN c * t.d / s ELSE c END, 3) AS c FROM g JOIN t USING (user_id) WHERE c > 0
UNION ALL SELECT user_id, 'unknown', round(d - s, 3) FROM t WHERE s < d - 1e-8 UNION ALL SELECT user_id, 'none', round(d, 3) FROM t WHERE s = 0 AND NOT s < d - 1e-8""")
def q_attribute_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Model costs made to add up to a total; shortfalls go to 'unknown', excess is scaled down."""
    g = ev(spark, sf).groupBy("user_id", "event_type").agg(F.sum("v").cast("double").alias("c")).withColumn("d", F.col("user_id") % 40 * 100.0)
    return deltas.attribute_cost(g, ["user_id"], "event_type", "c", "d", "none").withColumn("c", F.round("c", 3))


@query(f"""WITH {E} SELECT event_id, user_id FROM e a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.k = a.k AND b.event_type = a.event_type)""")
def q_new_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose identity was not seen before."""
    e = ev(spark, sf)
    return deltas.new_events(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "k", "event_type"]).select("event_id", "user_id")


@query(f"""WITH {E} SELECT event_id FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 7 DAY""")
def q_retention(spark: SparkSession, sf: str) -> DataFrame:
    """F7, relative to the newest row."""
    e = ev(spark, sf).select("event_id", "ts")
    return deltas.retain(e, "ts", e.agg(F.max("ts")).scalar(), 7).select("event_id")


@query(f"""WITH {E} SELECT event_id, day, event_type, CAST(k AS DOUBLE) AS k FROM e WHERE k > 0 AND v > 0""")
def q_positive_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """positive deltas of both windows together."""
    e = ev(spark, sf).select("event_id", "day", "event_type", F.col("k").cast("double").alias("k"), "v")
    odd, even = e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0")
    return deltas.positive_deltas("k", "v", odd, even).drop("v")


_SERIES = f"""WITH RECURSIVE {E}, s AS (SELECT user_id, event_id, ts, CAST(k AS DOUBLE) AS p, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT user_id, n, event_id, ts, p, c, p AS bp, c AS bc, c AS prev, CAST(0 AS DOUBLE) AS dp, CAST(0 AS DOUBLE) AS dc, CAST(0 AS DOUBLE) AS sp, CAST(0 AS DOUBLE) AS sc, CAST(NULL AS DOUBLE) AS avg, true AS told FROM s WHERE n = 1
 UNION ALL SELECT user_id, n, event_id, ts, p, c, CASE WHEN p > b0 THEN p ELSE b0 END, CASE WHEN p > b0 THEN c ELSE b1 END, c, p - b0, greatest(0.0, c - b1),
  CASE WHEN ok THEN sp + (p - b0) ELSE sp END, CASE WHEN ok THEN sc + greatest(0.0, c - b1) ELSE sc END, CASE WHEN sp > 0 THEN sc / sp END, ok
 FROM (SELECT *, p > b0 AND greatest(0.0, c - b1) / CASE WHEN p > b0 THEN p - b0 END >= 0.01 IS TRUE AS ok FROM (
  SELECT s.user_id, s.n, s.event_id, s.ts, s.p, s.c, CASE WHEN s.p < r.bp THEN 0.0 ELSE r.bp END AS b0, CASE WHEN s.p < r.bp THEN r.prev ELSE r.bc END AS b1, r.sp, r.sc FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1)))"""


@query(f"""{_SERIES} SELECT CAST(user_id AS VARCHAR) AS account_id, '5h' AS "window", strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS checked_at, event_id AS seq, p AS raw_percent, p AS normalized_percent, dp AS delta_percent, dc AS delta_cost,
 CASE WHEN n > 1 THEN dc / dp END AS cost_percent_ratio, avg AS average_ratio, CASE WHEN n > 1 THEN coalesce(avg <> 0 AND (dc / dp / avg >= 3 OR dc / dp / avg <= 1.0 / 3), false) END AS ratio_deviation_warning, sp AS cumulative_percent, sc AS cumulative_cost FROM r WHERE told""")
def q_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """W7 over (k, running cost) per user: a fold. The SQL follows the rules that a plan without trusted percents and with times of its
    own for resets can meet; unit tests carry the others."""
    return deltas.batch_series(_samples(spark, sf))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of users as accounts, with their running cost and its shares by event type; types without a rate are in the cost alone."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    by_model = F.create_map(*(c for m in RATES for c in (F.lit(m), F.sum(F.when(F.col("event_type") == m, F.col("v"))).over(w).cast("double"))))
    return ev(spark, sf).select(F.col("user_id").cast("string").alias("account_id"), F.lit("5h").alias("window"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("checked_at"), F.col("event_id").alias("seq"), F.col("k").cast("double").alias("used_percent"), F.lit("unknown").alias("plan"), F.lit(1.0).alias("multiplier"), F.sum("v").over(w).cast("double").alias("cost"), F.unix_timestamp("ts").cast("double").alias("reset_ts"), F.lit(False).alias("unavailable"), F.to_json(F.map_filter(by_model, lambda m, c: c.isNotNull())).alias("cost_by_model"))


@query()
def q_live_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The live machine over all samples at once; a test holds the stream against it."""
    return live.batch(live_samples(_samples(spark, sf)))


def live_samples(s: DataFrame) -> DataFrame:
    win = F.to_json(F.create_map(F.lit("5h"), F.struct("used_percent", "plan", "multiplier", F.col("reset_ts").alias("reset"))))
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("checked_at", "seq")).cast("long")
    return s.select("account_id", n.alias("seq"), "checked_at", win.alias("windows"), "cost", "cost_by_model", F.lit(True).alias("cost_ready"), F.lit("x").alias("identity"), F.lit(None).cast("string").alias("confirmed"))


@query(f"""WITH {E}, r AS (SELECT user_id AS poll_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, k FROM e), b AS (SELECT *, lag(k) OVER (PARTITION BY poll_id ORDER BY attempt) AS p FROM r WHERE attempt <= 5)
SELECT poll_id, min(attempt) FILTER ((attempt = 1 AND abs(k - 50) <= 25) OR coalesce(abs(k - p) <= 25, false)) AS accepted, max(attempt) AS attempts FROM b GROUP BY 1""")
def q_arbitration(spark: SparkSession, sf: str) -> DataFrame:
    """The first believable of five responses."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    r = ev(spark, sf).select(F.col("user_id").alias("poll_id"), n.alias("attempt"), F.col("k").alias("percent"), F.lit(50).alias("previous_percent"), F.lit(25).alias("threshold"))
    return live.arbitrate(r)


@query(f"""WITH {E}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, k FROM e QUALIFY a <= 5),
f AS (SELECT *, CASE WHEN k <= 60 THEN 0 ELSE 1 END AS bad FROM r), g AS (SELECT *, sum(bad) OVER (PARTITION BY user_id ORDER BY a) AS run FROM f), l AS (SELECT user_id, run, sum(1 - bad) AS n FROM g GROUP BY 1, 2)
SELECT user_id AS poll_id, max(n) >= 3 OR (SELECT bool_or(k = 0) FROM r WHERE r.user_id = l.user_id AND a = 1) AS confirmed FROM l GROUP BY user_id""")
def q_confirm_reset(spark: SparkSession, sf: str) -> DataFrame:
    """T5: three consistent responses in a row of five, or a direct zero."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    r = ev(spark, sf).select(F.col("user_id").alias("poll_id"), n.alias("attempt"), F.col("k").alias("percent"), F.lit(0).alias("reset_ts"), F.lit(60).alias("limit_percent"))
    return live.confirm_reset(r)


@query(f"""WITH {E}, d AS (SELECT *, greatest(0, v - lag(v) OVER w) AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(coalesce(sum(g) OVER w, 0) AS DOUBLE) AS run_cost, count(g) OVER w >= 2 AS ready FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_run_cost(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    r = live.run_costs(ev(spark, sf), ["user_id"], ["ts", "event_id"], "v")
    return r.select("event_id", F.col("run_cost").cast("double").alias("run_cost"), "ready")


@query(f"""WITH {E}, r AS (SELECT event_id, sum(k) OVER w AS total, k, lag(k) OVER w AS was, CAST(sum(v) OVER w AS DOUBLE) AS cost, event_type, lag(event_type) OVER w AS model, value, lag(value) OVER w AS paid FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, lag(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM r JOIN (SELECT event_id, user_id, ts FROM e) USING (event_id))
SELECT event_id, greatest(0, coalesce(k - was, 0)) AS delta_input, round(greatest(0, coalesce(cost, 0) - coalesce(before, 0)), 8) AS cost_delta,
 round(greatest(0, CASE WHEN event_type = model THEN value - paid ELSE value END), 8) AS own_cost_delta, model IS NULL OR model = event_type AS one_model FROM c""")
def q_samples(spark: SparkSession, sf: str) -> DataFrame:
    """P10: progress of samples since the one before, of tokens, cost and cost by model."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    zero = {c: F.lit(0) for c in projections.COUNTS if c != "input"}
    e = ev(spark, sf).withColumns({"input": F.col("k"), "cost": F.sum("v").over(w).cast("double"), "cost_by_model": F.create_map("event_type", "value"), "account_slot_id": F.lit("s"), "account_label": F.lit("")} | zero)
    s = projections.make_samples(e, ["user_id"], ["ts", "event_id"])
    return s.select("event_id", "delta_input", "cost_delta", F.try_element_at("cost_delta_by_model", F.col("event_type")).alias("own_cost_delta"), (F.size("cost_delta_by_model") == 1).alias("one_model"))


# -- change data -------------------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, CASE WHEN a.o_orderstatus IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS NULL OR b.o_orderstatus IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def q_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What to publish."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    published = o.where("o_orderkey % 3 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return journal.diff(o.where("o_orderkey % 4 <> 0"), published, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(f"""WITH {E}, o AS (SELECT user_id, event_type, event_id, k FROM e WHERE event_type IN ('purchase', 'error')), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, -1 AS k FROM (SELECT DISTINCT user_id FROM e) WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, k FROM l WHERE event_type = 'purchase'""")
def q_cdc(spark: SparkSession, sf: str) -> DataFrame:
    """M7: purchases are upserts, errors deletes; the last one of a user counts."""
    e = ev(spark, sf)
    ops = e.where(F.col("event_type").isin("purchase", "error")).select("user_id", "k", "event_id", F.when(F.col("event_type") == "purchase", "upsert").otherwise("delete").alias("action"))
    return journal.replay(e.select("user_id").distinct().withColumn("k", F.lit(-1)), ops, ["user_id"], "event_id")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, k + 1 AS size, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT user_id, n, event_id, 1 AS c, size AS used, 0 AS batch FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN r.c >= 5 OR r.used + o.size > 200 THEN 1 ELSE r.c + 1 END, CASE WHEN r.c >= 5 OR r.used + o.size > 200 THEN o.size ELSE r.used + o.size END, CASE WHEN r.c >= 5 OR r.used + o.size > 200 THEN r.batch + 1 ELSE r.batch END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, user_id, CAST(batch AS BIGINT) AS batch FROM r""")
def q_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy batches of at most 5 rows or 200 bytes."""
    o = ev(spark, sf).select("user_id", "event_id", "ts", (F.col("k") + 1).alias("size"))
    return journal.batches(o, ["user_id"], ["ts", "event_id"], "size", 5, 200).select("event_id", "user_id", "batch")


@query(f"""WITH {E} SELECT event_id FROM e WHERE event_type IN ('view', 'click') AND k BETWEEN 1 AND 80 AND k % 2 = 0""")
def q_valid_operations(spark: SparkSession, sf: str) -> DataFrame:
    """F12."""
    e = ev(spark, sf)
    ops = e.select("event_id", F.when(F.col("event_type").isin("view", "click"), "upsert").otherwise("patch").alias("action"), F.lit("token").alias("kind"), F.repeat(F.lit("x"), F.col("k")).alias("key"), F.when(F.col("k") % 2 == 0, F.repeat(F.lit("x"), F.col("k"))).alias("record_key"), F.lit("{}").alias("record"))
    return journal.valid_operations(ops).where(F.length("key") <= 80).select("event_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS body FROM orders WHERE o_orderkey % 6 <> 0""")
def q_journal(spark: SparkSession, sf: str) -> DataFrame:
    """K8, K9: what is read after a checkpoint, a change with deletes, a compaction, another change with deletes, and a compaction; the key
    and the value have names that say nothing."""
    import uuid

    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders")
    body = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    of = lambda where, body: o.where(where).select(F.col("o_orderkey").cast("string").alias("id"), body.alias("k_body"))
    for step, now in enumerate((of("true", F.col("o_orderstatus")), of("o_orderkey % 3 <> 0", body), of("o_orderkey % 6 <> 0", body))):
        journal.publish(now, path, "m", ["id"], ["k_body"], expected=step - 1)
        if step:
            journal.compact(spark, path, "m")
    return journal.read_journal(spark, path, "m").select(F.col("id").alias("key"), F.col("k_body").alias("body"))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey, 'R' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0), d AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0)
SELECT o_orderkey, coalesce(l.o_orderstatus, r.o_orderstatus) AS o_orderstatus FROM l FULL JOIN r USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)""")
def q_merge_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots, one first, less what is deleted and not cleared."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    remote = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("R"))
    return journal.merge_with_deletions(o.where("o_orderkey % 2 = 0"), remote, o.where("o_orderkey % 5 = 0"), o.where("o_orderkey % 35 = 0"), ["o_orderkey"], True)


@query(f"""WITH {E}, m AS (SELECT user_id % 10 AS machine, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS sequence FROM e), h AS (SELECT machine, max(sequence) AS head FROM m GROUP BY 1)
SELECT CAST(machine AS VARCHAR) AS machine_id, sequence, machine % 4 = 1 AS needs_checkpoint FROM m JOIN h USING (machine) WHERE sequence > 3""")
def q_chunk_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks from the head back to the cursor; every fourth machine's chain is broken at the cursor."""
    m = ev(spark, sf).select((F.col("user_id") % 10).alias("machine"), "event_id")
    w = Window.partitionBy("machine").orderBy("event_id")
    c = m.select(F.col("machine").cast("string").alias("machine_id"), "machine", F.row_number().over(w).alias("sequence"), F.col("event_id").cast("string").alias("chunk_id"), F.lag(F.col("event_id").cast("string")).over(w).alias("parent_id"))
    third = c.where("sequence = 3").select("machine_id", F.when(F.col("machine") % 4 != 1, F.col("chunk_id")).otherwise("gone").alias("cursor_chunk"))
    heads = c.groupBy("machine_id").agg(F.max_by("chunk_id", "sequence").alias("head_chunk")).withColumn("cursor_sequence", F.lit(3)).join(third, "machine_id")
    return journal.chunk_chain(c, heads).select("machine_id", "sequence", "needs_checkpoint")


# -- quota and JSON ------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E} SELECT event_id, '5h' AS usage_window, CAST(k AS DOUBLE) AS used_percent, false AS unavailable, CASE WHEN k % 3 = 0 THEN 'plus' WHEN k % 3 = 1 THEN 'pro_lite' ELSE 'pro' END AS plan FROM e
UNION ALL SELECT event_id, '7d', CASE WHEN k % 4 = 0 THEN 0.0 ELSE CAST(100 - k AS DOUBLE) END, k % 4 = 0, CASE WHEN k % 3 = 0 THEN 'plus' WHEN k % 3 = 1 THEN 'pro_lite' ELSE 'pro' END FROM e""")
def q_json_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Windows out of nested JSON, with missing ones filled in."""
    plan = F.element_at(F.array(F.lit("plus"), F.lit("pro-lite"), F.lit("Pro")), F.col("k") % 3 + 1)
    other = F.col("k") % 4 == 0  # the second window is not one of the two
    snake = F.format_string('{"planType":"%s","rate_limit":{"a":[{"used_percent":%d,"limit_window_seconds":18000}],"b":{"remaining_percent":%d,"window_minutes":%d}}}', plan, "k", "k", F.when(other, 7).otherwise(10080))
    camel = F.format_string('{"planType":"%s","rate_limit":{"a":[{"usedPercent":%d,"windowDurationMins":300}],"b":{"remainingPercent":%d,"window_duration_minutes":%d}}}', plan, "k", "k", F.when(other, 7).otherwise(10080))
    named = F.format_string('{"plan_type":"%s","rate_limit":{"a":[{"usedPercent":%d,"limitName":"Five_hour"}],"b":{"remainingPercent":%d,"limit_name":"%s"}}}', plan, "k", "k", F.when(other, "daily").otherwise("Weekly"))
    e = ev(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, snake).when(F.col("event_id") % 3 == 1, camel).otherwise(named).alias("body"))
    return quota.required_windows(e, "event_id", "body").select(F.col("id").alias("event_id"), F.col("window").alias("usage_window"), "used_percent", "unavailable", "plan")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'promo') THEN 'promo' ELSE 'other' END AS tier, regexp_replace(lower(p_brand), '#', '') AS brand FROM part""")
def q_text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Z1, Z2-like text rules: a model name after its last slash, without a date."""
    p = table(spark, sf, "part")
    name = Z.normalize_model(F.concat(F.lit("Vendor/"), F.regexp_replace("p_brand", "#", ""), F.lit("-2024-01-31")))
    return p.select("p_partkey", F.when(F.lower("p_type").contains("promo"), "promo").otherwise("other").alias("tier"), name.alias("brand"))


#: Texts of plans and what they stand for.
PLAN_TEXTS = {"ChatGPT Pro-Lite": "pro_lite", "PRO": "pro", "chat_plus": "plus", "team": "unknown", "Max 5x": "pro_lite", "5_X": "pro_lite", "Pro Light": "pro_lite", "pro 5": "pro_lite", "20x": "pro", "max-20-x": "pro", "pro plus": "plus", "plus 20x": "pro", "": "unknown", "PROLITE": "pro_lite"}


@query(f"""WITH {E}, p(i, plan) AS (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PLAN_TEXTS.values()))})
SELECT event_id, plan, CAST(k AS DOUBLE) * CASE plan WHEN 'pro_lite' THEN 5 WHEN 'pro' THEN 20 ELSE 1 END AS plus_equivalent FROM e JOIN p ON k % {len(PLAN_TEXTS)} = i""")
def q_plan_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Z3, V8."""
    texts = F.array(*map(F.lit, PLAN_TEXTS))
    e = ev(spark, sf).select("event_id", "k", Z.normalize_plan(F.element_at(texts, F.col("k") % len(PLAN_TEXTS) + 1)).alias("plan"))
    return e.select("event_id", "plan", serving.plus_equivalent(F.col("k").cast("double"), F.col("plan")).alias("plus_equivalent"))


@query(f"""WITH {E}, s AS (SELECT event_id, 'mail' || (user_id % 5) AS email, CASE WHEN k % 3 = 0 THEN user_id % 2 END AS a, CASE WHEN k % 4 = 0 THEN user_id % 3 END AS b FROM e),
i AS (SELECT event_id, coalesce(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) AS account_id, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN email END AS email FROM s)
SELECT event_id, account_id, email, account_id IS NOT NULL AND (account_id <> '1' OR email <> 'mail1') AS changed FROM i""")
def q_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Identities of responses and logins, and whether they differ from a known one."""
    text = lambda c: c.cast("string")
    a, b = F.when(F.col("k") % 3 == 0, text(F.col("user_id") % 2)), F.when(F.col("k") % 4 == 0, text(F.col("user_id") % 3))
    mail = F.when(a.isNotNull() | b.isNotNull(), F.concat(F.lit("mail"), text(F.col("user_id") % 5)))
    e = ev(spark, sf).select("event_id", Z.remote_identity(F.create_map(F.lit("account_id"), a, F.lit("email"), mail), F.create_map(F.lit("account_id"), b)).alias("i"))
    known = F.struct(F.lit(None).cast("string").alias("user_id"), F.lit("1").alias("account_id"), F.lit("mail1").alias("email"), F.lit(None).cast("string").alias("plan_type"))
    return e.select("event_id", "i.account_id", "i.email", Z.identity_changed(known, F.col("i")).alias("changed"))


# -- serving -----------------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {E}, l AS (SELECT event_id, k - lag(k) OVER w AS step, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN gap IS NULL THEN false WHEN gap > 14400 THEN true WHEN gap <= 1800 THEN false WHEN step <= -3 THEN true ELSE abs(step) / (gap / 60.0) >= 0.5 END AS breaks FROM l""")
def q_break(spark: SparkSession, sf: str) -> DataFrame:
    """V7."""
    return serving.curve_breaks(ev(spark, sf), ["user_id"], "ts", ["ts", "event_id"], "k", F.lit(0.5)).select("event_id", "breaks")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e),
r AS (SELECT user_id, n, event_id, k AS a, 0 AS falls FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, o.event_id, CASE WHEN o.k < r.a AND r.a - o.k <= 2 AND r.falls < 2 THEN r.a ELSE o.k END, CASE WHEN o.k < r.a AND r.a - o.k <= 2 AND r.falls < 2 THEN r.falls + 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT event_id, CAST(a AS DOUBLE) AS shown FROM r""")
def q_dejitter(spark: SparkSession, sf: str) -> DataFrame:
    """V6."""
    return serving.dejitter(ev(spark, sf).select("user_id", "event_id", "ts", "k"), ["user_id"], ["ts", "event_id"], "k").select("event_id", "shown")


@query(f"""WITH RECURSIVE {E}, o AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS x, CAST(k AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM e),
r AS (SELECT *, x AS lx, y AS ly, true AS far FROM o WHERE n = 1 UNION ALL SELECT user_id, event_id, x, y, n, CASE WHEN far THEN x ELSE lx END, CASE WHEN far THEN y ELSE ly END, far
 FROM (SELECT o.*, r.lx, r.ly, ((o.x - r.lx) / 3600.0) ** 2 + ((o.y - r.ly) / 1.0) ** 2 > 400 AS far FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT user_id, event_id, x, y FROM r QUALIFY far OR n = max(n) OVER (PARTITION BY user_id)""")
def q_dense_merge(spark: SparkSession, sf: str) -> DataFrame:
    """V5: a fold."""
    p = ev(spark, sf).select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("x"), F.col("k").cast("double").alias("y"))
    return serving.dense_merge(p, ["user_id"], ["x", "event_id"], "x", "y", 3600.0, 1.0)


@query(f"""WITH {E} SELECT event_id, sum(k) OVER w AS cumulative_k, CAST(sum(v) OVER w AS DOUBLE) AS cumulative_v FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_rebase(spark: SparkSession, sf: str) -> DataFrame:
    """V1, V2."""
    e = serving.model_filter(ev(spark, sf).withColumns({"synthetic": F.lit(False), "model": F.col("event_type")}), ["view", "click"])
    return serving.rebase(e, ["user_id"], ["ts", "event_id"], ["k", "v"]).select("event_id", "cumulative_k", F.col("cumulative_v").cast("double").alias("cumulative_v"))


@query(f"""WITH {E}, s AS (SELECT event_type, sum(k - k // 2 - k // 4) AS fresh, sum(k // 2) AS cached, sum(k // 4) AS cache_write, sum(k % 9) AS output, count(DISTINCT user_id) AS sessions FROM e GROUP BY 1)
SELECT *, cached * 100 / (fresh + cached + cache_write) AS cache_hit_percent FROM s""")
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A12, V10."""
    e = ev(spark, sf).select("event_type", F.col("user_id").alias("session_id"), (F.col("k") - F.expr("k div 2") - F.expr("k div 4")).alias("fresh"), F.expr("k div 2").alias("cached"), F.expr("k div 4").alias("cache_write"), (F.col("k") % 9).alias("output"))
    return serving.token_summary(e, ["event_type"])


@query(f"""WITH {E} SELECT count(*) AS rows, count(*) FILTER (k = 0) AS synthetic_rows, count(*) FILTER (k <> 0) AS real_rows FROM e""")
def q_history_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A9."""
    return serving.history_stats(ev(spark, sf).withColumn("synthetic", F.col("k") == 0))


@query(f"""WITH {E} SELECT user_id, max(ts) AS ts, arg_max(k, ts) AS k, arg_max(event_id, ts) AS event_id FROM e GROUP BY 1""")
def q_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """O9, T9."""
    return serving.latest_status(ev(spark, sf), ["user_id"], "ts", ["k", "event_id"])


@query(f"""WITH {E} SELECT event_id FROM e WHERE k = 7 OR floor(epoch(ts)) >= (SELECT max(floor(epoch(ts))) FROM e) - 86400""")
def q_last_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """V4."""
    return serving.last_seconds(ev(spark, sf).withColumn("synthetic", F.col("k") == 7), "ts", 86400).select("event_id")


@query(f"""WITH {E}, d AS (SELECT CAST(min(ts) AS DATE) + 1 AS first FROM e)
SELECT event_id FROM e, d WHERE k = 7 OR (ts >= first + INTERVAL 300 MINUTE AND ts < first + INTERVAL 1740 MINUTE)""")
def q_on_day(spark: SparkSession, sf: str) -> DataFrame:
    """V4: a day of another zone, five hours behind."""
    e = ev(spark, sf).withColumn("synthetic", F.col("k") == 7)
    day = e.select(F.date_add(F.min("ts").cast("date"), 1).cast("string")).first()[0]
    return serving.on_day(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", day, "-05:00").select("event_id")


@query(f"""WITH {E}, s AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS spell FROM s), x AS (SELECT user_id, spell, min(ts) AS since, max(ts) AS until, min(event_type) AS event_type FROM g GROUP BY 1, 2)
SELECT user_id, since, until, event_type FROM x WHERE floor(epoch(until)) - floor(epoch(since)) >= 3600""")
def q_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Values that stayed the same for an hour."""
    return live.debounced(ev(spark, sf), ["user_id"], "ts", "event_type", 3600)


# -- additions beyond the reference: what Spark has built in ------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price, count(*) AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def q_price_report(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where("l_shipdate <= date '1998-09-02'")
    d = lambda c, p=18: F.col(c).cast(f"decimal({p},2)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(d("l_quantity")).cast("double").alias("sum_qty"), F.sum(d("l_extendedprice")).cast("double").alias("sum_base_price"), F.sum(d("l_extendedprice") * (1 - d("l_discount", 4))).cast("double").alias("sum_disc_price"), F.count("*").alias("count_order"))


@query("""SELECT o_orderkey FROM orders a WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = a.o_orderkey AND b.o_orderkey % 3 = 0 AND b.o_orderstatus = a.o_orderstatus AND b.o_orderkey % 5 <> 0)""")
def q_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """What differs from what is here."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    here = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderstatus")))
    return journal.to_fetch(o.where("o_orderkey % 2 = 0"), here, ["o_orderkey"], "o_orderstatus").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)""")
def q_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that no order of some referrers names."""
    stored = table(spark, sf, "customer").select("c_custkey")
    return journal.unreferenced(stored, table(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(f"""WITH {E}, s AS (SELECT day, event_id, 10 + k AS size, sum(10 + k) OVER (ORDER BY day DESC, event_id DESC) AS run FROM e) SELECT event_id FROM s WHERE run <= 200000""")
def q_newest_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the newest rows within a budget of bytes."""
    from usagelake.sources.sinks import newest_suffix

    return newest_suffix(ev(spark, sf).select("day", "event_id", "k"), ["day", "event_id"], F.col("k") + 9, 200000).select("event_id")


@query("""SELECT l_linestatus, l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_linestatus, l_returnflag)""")
def q_cube(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").cube("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT o_orderkey, rank() OVER w AS rnk, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def q_ranks(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w.orderBy("o_orderdate", "o_orderkey")).alias("quarter"))


@query(f"""WITH {E} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS since, event_type, count(*) AS n, sum(k) AS k FROM e GROUP BY 1, 2""")
def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling event-time windows: an addition; the reference's cycles come with the data."""
    return ev(spark, sf).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k")).select(F.col("w.start").alias("since"), "event_type", "n", "k")


@query("""SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0""")
def q_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey").intersect(table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_custkey"))
