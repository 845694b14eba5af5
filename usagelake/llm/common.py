"""Helpers shared by the training-data operators: written stages, blocked groups and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.session import shared_dir

_log: ContextVar[list[str] | None] = ContextVar("written", default=None)
_kept: dict[tuple, object] = {}
MOST_BITS = 1 << 29  # places of a filter that goes to every task: 64 MB
SALTS = 16
HOT = 200  # edges of a centre, and a thousandth of all, from which on they are dealt to several tasks


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks. Only the operator that ran last keeps anything, so that the tables
    of a pipeline's stages do not add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return freed memory to the system, where the C library can: an idle worker, or a driver after a fit, holds no more than it uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether a place (from 1) is set in the bitmap of its bucket."""
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1


def perhaps(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """df with _maybe: false only where key is none of ids (one column of longs). What is true is joined exactly by the caller; all else
    need not move. The filter is a bitmap of 16 places an id, at most MOST_BITS: its size does not grow with the data beyond 64 MB, and a
    fuller one lets more rows through, no wrong ones."""
    name = ids.columns[0]
    n = ids.count()
    bits = min(MOST_BITS, 1 << max(15, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(bits)) + 1
    spot = place(F.col(name))
    maps = ids.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_map"))
    j = df.withColumn("_place", place(key))
    j = j.join(F.broadcast(maps), F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")
    return j.select(*df.columns, F.coalesce(_bit(F.col("_map"), F.col("_place")), F.lit(False)).alias("_maybe"))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage ends here, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (log := _log.get()) is not None:
        log.append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete at the end what `written` wrote inside, but for the paths that were taken off the list. Results of operators read such
    tables, so write a result inside: `with scratch(spark): near_duplicates(docs).write.parquet(path)`."""
    token = _log.set(log := [])
    try:
        yield log
    finally:
        _log.reset(token)
        discard(spark, *log)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written stages that no later read needs."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def each_group(keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function over a partition sorted by `keys`: fn gets the rows of one key at a time, without a Python call per small batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(c[a] for c in cols)
                if held and key != held_key:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                held_key = key
        if held:
            yield from fn(pa.Table.from_batches(held))
            held = []
        give_back()

    return run


def block_pairs(df: DataFrame, id_col: str, n_blocks: str) -> DataFrame:
    """Deal the rows of a group to blocks by a hash of their id, and each row to every pair of blocks that holds its own.

    Adds blk, bi <= bj. A group of n rows thus becomes n_blocks*(n_blocks+1)/2 tasks of bounded size instead of one unbounded task;
    each pair of rows meets in exactly one of them.
    """
    df = df.withColumn("blk", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.col(n_blocks)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col(n_blocks).cast("int") - 1), lambda j: F.struct(F.least("blk", j).alias("bi"), F.greatest("blk", j).alias("bj")))
    return df.withColumn("_p", F.explode(pairs)).select("*", "_p.bi", "_p.bj").drop("_p")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same connectivity as (a, b), at most one per node: what a task sends on instead of all its links."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = inv[: len(a)], inv[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) with component the smallest node reachable; edges(src, dst) of longs. Nodes without edges have no row.

    Alternating large-star and small-star steps: minima are aggregated before the shuffle, and the edges of a hot centre (there are at
    most a thousand) are dealt to SALTS tasks, to each of which the centre's minimum goes. Each round is written to the shared folder.
    Joins are merge joins, as the small files of a round would make Spark broadcast many more rows than their size tells.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e, path = written(e, name)
    seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while seen[0]:
        hot = [r.v for r in e.groupBy("v").count().where(F.col("count") > max(HOT, seen[0] // 1000)).select("v").collect()] if seen[0] > HOT else []
        low = e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        if hot:
            low = low.withColumn("s", F.explode(F.when(F.col("n").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
            dealt = e.withColumn("salt", F.when(F.col("v").isin(hot), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).otherwise(0))
            met = dealt.join(low.hint("merge"), (dealt.v == low.n) & (dealt.salt == low.s), "left")
        else:
            met = e.join(low.hint("merge"), e.v == low.n, "left")
        large = met.select("u", F.coalesce("m", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt, new_path = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), name)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        e, path = nxt, new_path
        if tuple(now) == tuple(seen):
            break
        seen = now
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("s")).select("s.*").distinct()
