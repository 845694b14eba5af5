"""Spans of regular-expression matches as columns: (start, end) in code points, without Python.

`regexp_extract_all` gives the matches and `split` what lies between them, both leftmost and non-overlapping, so positions are running
sums of lengths. Running sums and extremes go by doubling steps over whole arrays, and pieces of a text are taken from blocks of it, so
that a text with very many matches takes n log n steps. Patterns should use possessive quantifiers: they then take linear time and no
stack on long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE_SPAN = "struct<m:string,start:int,end:int>"
SPAN = f"array<{ONE_SPAN}>"
STEPS = [1 << k for k in range(31)]
BLOCK = 512  # code points in a block of a text
BLOCKS = rf"(?s).{{1,{BLOCK}}}"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """Running results of `both` (associative, null for nothing ignored by coalesce) over an array: after step d, an element covers the 2d before it."""

    def step(acc: Column, d: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= d, both(F.get(acc, i - d), x)).otherwise(x))

    return bound(values, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, STEPS)), lambda d: d < F.size(v)), v, step))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def spans(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<m, start, end>> of the pattern's matches in order; only_if: a cheap test that any match needs."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.struct(m.alias("m"), (F.length(b) + F.length(m)).alias("step")))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())  # without the text after the last match

    def placed(p: Column) -> Column:
        return F.zip_with(p, running_sum(F.transform(p, lambda x: x["step"])), lambda x, e: F.struct(x["m"].alias("m"), (e - F.length(x["m"])).alias("start"), e.alias("end")))

    return F.coalesce(F.when(only_if, bound(pairs, placed)), F.array().cast(SPAN))


def clear_of(some: Column, taken: Column) -> Column:
    """The spans (m, start, end) of `some` that overlap none of `taken`, by start."""

    def marked(s: Column, k: int) -> Column:
        return F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["m"].alias("m")))

    def free(events: Column) -> Column:
        last_end = running(F.transform(events, lambda e: F.when(e["k"] == 0, e["end"]).otherwise(0)), F.greatest)
        next_start = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["k"] == 0, e["start"]).otherwise(2**31 - 1))), F.least))
        near = F.zip_with(last_end, next_start, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        kept = F.zip_with(events, near, lambda e, n: F.struct(e["m"].alias("m"), e["start"].alias("start"), e["end"].alias("end"), ((e["k"] == 1) & (n["a"] <= e["start"]) & (n["b"] >= e["end"])).alias("ok")))
        return F.transform(F.filter(kept, lambda x: x["ok"]), lambda x: F.struct(x["m"].alias("m"), x["start"].alias("start"), x["end"].alias("end")))

    both = bound(F.array_sort(F.concat(marked(taken, 0), marked(some, 1))), free)
    return F.when((F.size(some) == 0) | (F.size(taken) == 0), some).otherwise(both).cast(SPAN)


def blocks(text: Column) -> Column:
    """The text as an array of blocks, of which `piece` takes pieces without reading the text from its start."""
    return F.regexp_extract_all(text, F.lit(BLOCKS), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive, from 0) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
    return F.substring(near, (start - first * BLOCK + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test: from the right, every second digit is doubled and its digits added."""
    ds = F.transform(F.reverse(F.split(number, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + d) % 10 == 0


def redacted(text: Column, s: Column, mark: str) -> Column:
    """text with the union of the spans (array<struct<start, end>>) replaced by `mark`, overlapping ones once."""

    def whole(x: Column) -> Column:
        end = running(F.transform(x["s"], lambda y: y["end"]), F.greatest)

        def rest(e: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), e)  # the end of all earlier spans
            gaps = F.filter(F.zip_with(x["s"], before, lambda y, b: F.struct(b.alias("b"), y["start"].alias("a"))), lambda g: g["a"] >= g["b"])
            tail = piece(x["parts"], F.element_at(e, -1), F.lit(BLOCK) * (F.size(x["parts"]) + 1))
            return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(piece(x["parts"], g["b"], g["a"]), F.lit(mark))), ""), tail)

        return bound(end, rest)

    ordered = F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return F.when(F.size(s) == 0, text).otherwise(bound(F.struct(ordered.alias("s"), blocks(text).alias("parts")), whole))
