"""Two-level running values against windows over whole keys, with keys of many blocks, nulls and ties."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from usagelake.operators import attribution, blocks, deltas, reconcile


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "HOT_ROWS", 100)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice("xyz"), rng.randrange(5), rng.randrange(1, 90) if rng.random() < 0.7 else None) for i in rng.sample(range(n * 3), n)]


def test_values_over_blocks_are_those_of_one_window(spark, small):
    df = spark.createDataFrame(rows_of(900), "k string, t int, m string, p int, v int")
    cut = blocks.blocked(df, ["k"], ["t"])
    assert cut.select("_block").distinct().count() > 15 and cut.groupBy("_block").count().agg(F.max("count")).first()[0] < 150
    got = blocks.running(cut, ["k"], ["t"], {"s": "v"}, {"b": "v"}, {"l": "v"}, {"n": "v"})
    w = Window.partitionBy("k").orderBy("t")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("*", F.sum("v").over(upto).alias("s"), F.sum("v").over(past).alias("b"), F.last("v", True).over(upto).alias("l"), F.lead("v").over(w).alias("n"))
    assert sorted(map(str, got.drop("_block").collect())) == sorted(map(str, want.collect()))


def test_hot_ledger_as_of_and_sweep(spark, small):
    raw = spark.createDataFrame(rows_of(900), "k string, t int, m string, p int, v int")
    e = raw.select("k", "t", "m", F.col("p").cast("decimal(18,2)").alias("p"), F.col("v").cast("decimal(18,2)").alias("v"))
    same = lambda f: (sorted(map(str, f(10**9).collect())), sorted(map(str, f(None).collect())))
    for f in (
        lambda n: deltas.ledger(e, ["k"], "m", ["t"], "p", "v", n),
        lambda n: attribution.as_of(raw, raw.where("v > 40").select("k", (F.col("t") + 1).alias("at"), F.col("v").alias("seen")), ["k"], "t", "at", ["seen"], ["seen"], n),
        lambda n: reconcile.sweep(raw.select("k", F.col("t").cast("double").alias("a"), (F.col("t") + F.col("p") * 7).cast("double").alias("z"), "m", F.col("v").cast("double").alias("c")), ["k"], "a", "z", "m", "c", n),
    ):
        whole, cut = same(f)
        assert whole == cut and len(whole) > 100


def test_no_task_reads_more_than_its_share_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 1_000)
    monkeypatch.setattr(blocks, "HOT_ROWS", 50_000)
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}  # tasks of few rows stay apart
    old = {k: spark.conf.get(k, None) for k in own}
    e = spark.range(200_000).select(F.lit("one").alias("k"), F.col("id").alias("t"), F.lit("m").alias("m"), F.lit(1).cast("decimal(18,2)").alias("p"), F.lit(2).cast("decimal(18,2)").alias("v"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        led = deltas.ledger(e, ["k"], "m", ["t"], "p", "v")
        assert led.agg(F.max("cumulative_percent"), F.max("model_cumulative_cost"), F.count_distinct("t")).first() == (200_000, 400_000, 200_000)
        assert led.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200_000 / 20
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert blocks.blocked(e, ["k"], ["t"]).groupBy("_block").count().agg(F.max("count")).first()[0] < 200_000 / 20


def test_hot_anchors_by_jump_pointers(spark, small):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", None]), rng.randrange(4000), 1) for _ in range(1500)]
    for kind in ("long", "double"):
        v = spark.createDataFrame(rows, "k string, t long, n int").withColumn("t", F.col("t").cast(kind))
        for tolerance in (0, 7, 60, 10**6):
            folded = sorted(map(str, reconcile.anchors(v, ["k"], "t", tolerance, 10**9).collect()))
            assert sorted(map(str, reconcile.anchors(v, ["k"], "t", tolerance).collect())) == folded and folded
            cycles = lambda n: sorted(map(str, reconcile.with_cycle(v, ["k"], "t", tolerance, n).collect()))
            assert tolerance == 0 or cycles(10**9) == cycles(None)
