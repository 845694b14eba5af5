"""Running sums, last values and next values over a key of any size: two levels, so that no task orders a hot key alone.

A window over a key puts its rows into one task. `blocked` cuts the rows by ranges of key and order instead, into blocks of a bounded size;
`running` takes each value over a block by a window of the block, and over the blocks before (or after) it by a window over one row a
block. Both together are what the window over the key says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from usagelake.session import materialized

HOT_ROWS = 1_000_000  # rows of a key from which on it is cut into blocks
BLOCK_ROWS = 250_000  # rows that a block has on average


def hot(df: DataFrame, by: list[str], rows: int | None = None) -> bool:
    """Whether a key has more rows than one task should order: a count before the shuffle, of the key's columns alone."""
    most = df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) > (HOT_ROWS if rows is None else rows)


def blocked(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """df with _block, the number of the range of (by, order) that a row is in. Rows that are equal in both share a block. Written to the
    shared folder, so that a block is the same rows for everything that is computed from it."""
    n = max(2, -(-df.count() // (BLOCK_ROWS if rows is None else rows)))
    return materialized(df.repartitionByRange(n, *by, *order).withColumn("_block", F.spark_partition_id()), "blocks")[0]


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str | Column] = {}, before: dict[str, str | Column] = {}, lasts: dict[str, str] = {}, nexts: dict[str, str] = {}) -> DataFrame:
    """A blocked df with, per key in rising order (nulls first): sums up to the row, sums before it (null at first), the last value that is
    not null up to the row, and the next row's value."""
    inner = Window.partitionBy(*by, "_block").orderBy(*order)
    upto, past = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    col = lambda c: F.col(c) if isinstance(c, str) else c
    place = F.struct(*order)
    added = {**{f"s{i}": c for i, c in enumerate(sums.values())}, **{f"b{i}": c for i, c in enumerate(before.values())}}
    values = [F.sum(col(c)).alias(f"_{n}") for n, c in added.items()]
    values += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_l{i}") for i, c in enumerate(lasts.values())]
    values += [F.min_by(F.struct(c), place).alias(f"_n{i}") for i, c in enumerate(nexts.values())]
    per = df.groupBy(*by, "_block").agg(*values) if values else df.select(*by, "_block").distinct()
    outer = Window.partitionBy(*by).orderBy("_block")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_block").alias("_kb"), *(F.sum(f"_{n}").over(earlier).alias(f"_p{n}") for n in added),
                      *(F.last(f"_l{i}", True).over(earlier).alias(f"_pl{i}") for i in range(len(lasts))), *(F.lead(f"_n{i}").over(outer).alias(f"_pn{i}") for i in range(len(nexts))))
    same = F.col("_block") == F.col("_kb")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))

    def both(a: Column, name: str) -> Column:
        b, kind = F.col(f"_p{name}"), per.schema[f"_{name}"].dataType
        if isinstance(kind, DecimalType):  # one digit less on each side, so that the sum keeps its places
            a, b = (x.cast(DecimalType(min(37, kind.precision), kind.scale)) for x in (a, b))
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).cast(kind)

    out = [both(F.sum(col(c)).over(upto), f"s{i}").alias(n) for i, (n, c) in enumerate(sums.items())]
    out += [both(F.sum(col(c)).over(past), f"b{i}").alias(n) for i, (n, c) in enumerate(before.items())]
    out += [F.coalesce(F.last(c, True).over(upto), F.col(f"_pl{i}")).alias(n) for i, (n, c) in enumerate(lasts.items())]
    out += [F.coalesce(F.lead(F.struct(c)).over(inner), F.col(f"_pn{i}"))[c].alias(n) for i, (n, c) in enumerate(nexts.items())]
    return df.join(base, same).select(*df.columns, *out)
