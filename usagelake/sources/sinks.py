"""Sinks: appends, capped and grouped logs, swaps of several tables at once, and sealed envelopes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def newest_suffix(df: DataFrame, order: list[str], size: Column, budget: int) -> DataFrame:
    """The newest rows whose sizes, a line end each, add up to at most the budget.

    Two levels: sums per coarse bucket of the leading order column decide which buckets stay whole, and only the bucket that the
    budget cuts is ordered row by row, so that no single task orders the log. Use a date or hour as the first order column.
    """
    day = order[0]
    per = df.groupBy(day).agg(F.sum(size + 1).alias("_b"))
    per = per.withColumn("_from_newest", F.sum("_b").over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)))  # one row per bucket
    j = df.join(per.withColumn("_over", F.col("_from_newest") - F.col("_b")), day)
    whole = j.where(F.col("_from_newest") <= budget)
    cut = j.where((F.col("_from_newest") > budget) & (F.col("_over") < budget))
    w = Window.partitionBy(day).orderBy(*(F.desc(c) for c in order[1:])).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_run", F.sum(size + 1).over(w)).where(F.col("_run") + F.col("_over") <= budget)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def capped_append(spark: SparkSession, old: DataFrame | None, new: DataFrame, order: list[str], limit: int = 50 * 2**20) -> DataFrame:
    """What a capped log holds after an append: all of it, or past the limit its newest four fifths of the limit."""
    both = new if old is None else old.unionByName(new)
    size = F.octet_length(F.to_json(F.struct(*both.columns)))
    total = both.agg(F.sum(size + 1)).first()[0] or 0
    return both if total <= limit else newest_suffix(both, order, size, limit * 8 // 10)


def grouped_history(events: DataFrame, by: list[str] = ("accountSlotId",)) -> DataFrame:
    """JSON objects of a window's events in order, one per account (`by`) and day, so that none holds a whole history; a reader takes
    objects of one window one after the other."""
    e = F.struct("checkedAt", "model", "accountSlotId", "accountLabel", "deltaPercent", "deltaCostUsd")
    g = events.groupBy("window", *by, F.left("checkedAt", F.lit(10)).alias("day")).agg(F.array_sort(F.collect_list(e)).alias("delta"))
    return g.select("window", *by, "day", F.to_json(F.struct("window", "delta")).alias("value"))


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write several tables and make them visible together: each goes to a folder of a new version, then one marker file names it.

    A failure before the marker leaves the version before in force. Files are written and listed by Spark only.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    marker = spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    marker.coalesce(1).write.mode("append").parquet(f"{root}/_versions")
    return version


def read_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    version = spark.read.parquet(f"{root}/_versions").orderBy(F.desc("at")).first().version
    return {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}


def seal(body: Column, key: Column, header: Column) -> Column:
    """An AES-256-GCM envelope with the header authenticated, and the plain text's size and hash for the reader to check."""
    return F.struct(F.aes_encrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), header).alias("sealed"), header.alias("header"), F.octet_length(body).alias("size"), F.sha2(body, 256).alias("sha256"))


def unseal(envelope: Column, key: Column) -> Column:
    """The plain text; null where it is not whole."""
    body = F.try_aes_decrypt(envelope["sealed"], key, F.lit("GCM"), F.lit("DEFAULT"), envelope["header"])
    return F.when((F.octet_length(body) == envelope["size"]) & (F.sha2(body, 256) == envelope["sha256"]), body)
