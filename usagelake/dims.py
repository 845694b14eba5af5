"""Fixed dimensions of usage analytics, as plain values and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values. USD per million tokens: input, cached input (None: as input), cache write (None: as input), output.
PRICES = {
    "gpt-5.6-sol": (5.0, 0.5, 6.25, 30.0),
    "gpt-5.6-terra": (2.5, 0.25, 3.125, 15.0),
    "gpt-5.6-luna": (1.0, 0.1, 1.25, 6.0),
    "gpt-5.5": (5.0, 0.5, None, 30.0),
    "chat-latest": (5.0, 0.5, None, 30.0),
    "gpt-5.5-pro": (30.0, None, None, 180.0),
    "gpt-5.4": (2.5, 0.25, None, 15.0),
    "gpt-5.4-mini": (0.75, 0.075, None, 4.5),
    "gpt-5.4-nano": (0.2, 0.02, None, 1.25),
    "gpt-5.4-pro": (30.0, None, None, 180.0),
    "gpt-5.3-codex": (1.75, 0.175, None, 14.0),
    "gpt-5-codex": (1.75, 0.175, None, 14.0),
    "gpt-5.2-codex": (1.75, 0.175, None, 14.0),
    "codex-auto-review": (1.75, 0.175, None, 14.0),
}
# Fixed values. Multiplier of the fast tier by the first matching prefix, in this order.
FAST_MULTIPLIERS = (("gpt-5.4", 2.0), ("gpt-5.5", 2.5), ("gpt-5.6", 2.5))
FAST_DEFAULT = 2.0
# Fixed values. Usage windows in minutes, plan multipliers, and thresholds.
WINDOWS = {"5h": 300, "7d": 10080}
PLAN_MULTIPLIERS = {"plus": 1, "pro_lite": 5, "pro": 20, "unknown": 1}
MIN_COST_PER_PERCENT = 0.01
RATIO_DEVIATION = 3.0
RESET_JITTER_S = 60
DEFAULT_MODEL = "gpt-5.5"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "price_model string, input double, cached double, cache_write double, output double")


def fast_multipliers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, m) for i, (p, m) in enumerate(FAST_MULTIPLIERS)], "ord int, prefix string, multiplier double")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in PLAN_MULTIPLIERS.items()], "plan string, multiplier double")
