"""Reconciling what several machines saw: run compaction, keyed merges, anchored clusters and the interval sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.dims import MIN_COST_PER_PERCENT, RESET_JITTER_S
from usagelake.operators import blocks
from usagelake.operators.fold import fold
from usagelake.session import materialized
from usagelake.sources import markers


def run_ends(df: DataFrame, key: list[str], order: list[str], same: Column) -> DataFrame:
    """The first and last row of each run. `same` compares a row with the one before it: use previous(c, ...) for its columns."""
    w = Window.partitionBy(*key).orderBy(*order)
    d = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("_next_new", F.coalesce(F.lead("_new").over(w), F.lit(1)))
    return d.where("_new = 1 or _next_new = 1").drop("_new", "_next_new")


def previous(c: str, key: list[str], order: list[str]) -> Column:
    return F.lag(c).over(Window.partitionBy(*key).orderBy(*order))


def anchored_run_ends(df: DataFrame, key: list[str], order: list[str], state: list[str], drifting: str, tolerance: float) -> DataFrame:
    """The first and last row of each run in which every row equals the run's first in `state` and differs from it by at most
    `tolerance` in `drifting`. Unlike run_ends, slow drift ends a run."""
    names = df.columns
    null = lambda x: x is None or x != x

    class Run:
        first = last = None
        n = 0

    def same(a, b) -> bool:
        x, y = getattr(a, drifting), getattr(b, drifting)
        near = (null(x) and null(y)) or (not null(x) and not null(y) and abs(x - y) <= tolerance)
        return near and all((null(getattr(a, c)) and null(getattr(b, c))) or getattr(a, c) == getattr(b, c) for c in state)

    def row(r) -> tuple:
        return tuple(getattr(r, c) for c in names)

    def end(run: Run) -> list[tuple]:
        return [row(run.last)] if run.n > 1 else []

    def step(run: Run, r) -> list[tuple]:
        if run.first is not None and same(run.first, r):
            run.last, run.n = r, run.n + 1
            return []
        out = end(run) + [row(r)]
        run.first, run.n = r, 1
        return out

    return fold(df, key, order, Run, step, df.schema, end)


def anchors(values: DataFrame, key: list[str], value: str, tolerance: float = RESET_JITTER_S, hot_rows: int | None = None) -> DataFrame:
    """(key, anchor): a value more than `tolerance` after its cluster's first starts a new cluster. Only distinct values are looked at; keys of
    more than `hot_rows` of them are not folded by one task but followed by jump pointers."""

    class Last:
        at = None

    names = [*key, "anchor"]
    source = values.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("anchor")).distinct()
    if blocks.hot(source, key, hot_rows):
        return _jumped_anchors(source, key, tolerance)

    def step(last: Last, r) -> list[tuple]:
        if last.at is not None and r.anchor - last.at <= tolerance:
            return []
        last.at = r.anchor
        return [tuple(getattr(r, c) for c in names)]

    return fold(source, key, ["anchor"], Last, step, source.schema)


def _jumped_anchors(source: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """The anchors among distinct values. The next anchor after a value is the least value more than `tolerance` above it: a value carried back
    over blocks of the values and of where each looks from. Anchors are what is reached from each key's least value; a round joins what is
    reached with jumps of twice the length of the round before, so n anchors take some log2(n) joins over all tasks."""
    kind = dict(source.dtypes)["anchor"]
    look = source.select(*key, (-(F.col("anchor") + F.lit(tolerance).cast(kind))).alias("_at"), F.lit(0).alias("_o"), F.col("anchor").alias("_from"), F.lit(None).cast(kind).alias("_v"))
    there = source.select(*key, (-F.col("anchor")).alias("_at"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_from"), F.col("anchor").alias("_v"))
    order = ["_at", "_o"]  # falling values: what was met before is greater; a value equal to where one looks from comes after it
    seen = blocks.running(blocks.blocked(look.unionByName(there), key, order), key, order, lasts={"to": "_v"}).where("_o = 0 and to is not null")
    mark = lambda df: df.select(*(F.col(c) for c in key), "anchor")
    jump, path = materialized(seen.select(*key, F.col("_from").alias("anchor"), "to"), "anchor-jumps")
    reach, at = materialized(source.groupBy(*key).agg(F.min("anchor").alias("anchor")), "anchors")
    spark, size, stale = source.sparkSession, reach.count(), [path, at]

    def joined(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
        """left with `to` of the jump from its column, for equal keys, nulls among them."""
        r = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.col("anchor").alias("_from"), F.col("to").alias("_to"))
        same = F.col(col) == F.col("_from")
        for i, c in enumerate(key):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        return left.join(r, same)

    while True:
        more = joined(reach, jump, "anchor").select(*key, F.col("_to").alias("anchor"))
        reach, at = materialized(mark(reach.unionByName(more).distinct()), "anchors")
        if (n := reach.count()) == size:
            break
        size = n
        jump, path = materialized(joined(jump, jump, "to").select(*key, "anchor", F.col("_to").alias("to")), "anchor-jumps")
        stale += [at, path]
    markers.delete(spark, *(x for x in stale if x != at))
    return reach


def with_cycle(df: DataFrame, key: list[str], value: str, tolerance: float = RESET_JITTER_S, hot_rows: int | None = None) -> DataFrame:
    """Add cycle: the anchor of the row's cluster, found with a running last value over rows and anchors; null values have none. Keys of more
    than `hot_rows` rows go in blocks."""
    a = anchors(df, key, value, tolerance, hot_rows)
    marks = a.select(*key, F.col("anchor").alias(value), F.col("anchor").alias("_a"), F.lit(0).alias("_o"))
    both = df.withColumns({"_a": F.lit(None).cast(dict(a.dtypes)["anchor"]), "_o": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    if blocks.hot(both, key, hot_rows):
        both = blocks.running(blocks.blocked(both, key, [value, "_o"]), key, [value, "_o"], lasts={"_last": "_a"}).drop("_block")
    else:
        w = Window.partitionBy(*key).orderBy(F.col(value).asc_nulls_first(), "_o").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_last", F.last("_a", True).over(w))
    return both.withColumn("cycle", F.when(F.col(value).isNotNull(), F.col("_last"))).where("_o = 1").drop("_a", "_o", "_last")


def sweep(intervals: DataFrame, key: list[str], start: str, end: str, model: str, cost: str, hot_rows: int | None = None) -> DataFrame:
    """(key, segment_start, segment_end, model, cost, rate): costs of overlapping intervals summed over elementary segments.

    Each interval is two marks of its rate; running sums over the marks give the rate of every segment without comparing intervals
    with each other. Rates are decimals, so that what is added is subtracted exactly. Segments under the least rate go. A key of more
    than `hot_rows` marks is summed in blocks (see `blocks`).
    """
    i = intervals.where((F.col(end) > F.col(start)) & (F.col(cost) > 0)).withColumn("_r", (F.col(cost) / (F.col(end) - F.col(start))).cast("decimal(28,12)"))
    marks = i.select(*key, F.col(model).alias("model"), F.explode(F.array(F.struct(F.col(start).alias("at"), F.col("_r").alias("r"), F.lit(1).alias("n")), F.struct(F.col(end).alias("at"), (-F.col("_r")).alias("r"), F.lit(-1).alias("n")))).alias("m"))
    marks = marks.groupBy(*key, "model", F.col("m.at").alias("at")).agg(F.sum("m.r").alias("r"), F.sum("m.n").alias("n"))
    # a model's rate is constant from one of its own marks to the next: only the key's segments inside such a run are made
    if blocks.hot(marks, key, hot_rows):
        marks = blocks.blocked(marks, key, ["at"])
        points = blocks.running(marks.select(*key, "at", "_block").distinct(), key, ["at"], {"i": F.lit(1).cast("long")}, nexts={"segment_end": "at"})
        placed = marks.join(points.select(*key, "at", "i"), [*key, "at"])
        runs = blocks.running(placed, [*key, "model"], ["at"], {"rate": "r", "active": "n"}, nexts={"to": "i"}).select(*key, "model", "i", "to", "rate", "active")
        points = points.drop("_block")
    else:
        order = Window.partitionBy(*key).orderBy("at")
        points = marks.select(*key, "at").distinct().select(*key, "at", F.row_number().over(order).alias("i"), F.lead("at").over(order).alias("segment_end"))
        own = Window.partitionBy(*key, "model").orderBy("at")
        run = own.rowsBetween(Window.unboundedPreceding, 0)
        runs = marks.join(points.select(*key, "at", "i"), [*key, "at"]).select(*key, "model", "i", F.lead("i").over(own).alias("to"), F.sum("r").over(run).alias("rate"), F.sum("n").over(run).alias("active"))
    runs = runs.where("active > 0 and to is not null")
    seg = runs.select(*key, "model", "rate", F.explode(F.sequence("i", F.col("to") - 1)).alias("i")).join(points.withColumnRenamed("at", "segment_start"), [*key, "i"]).select(*key, "model", "segment_start", "segment_end", "rate")
    seg = seg.withColumn("total_rate", F.sum("rate").over(Window.partitionBy(*key, "segment_start")))
    return seg.where(F.col("total_rate") >= MIN_COST_PER_PERCENT).withColumn("cost", F.col("rate").cast("double") * (F.col("segment_end") - F.col("segment_start")))


def interval_events(intervals: DataFrame, key: list[str]) -> DataFrame:
    """The sweep as ledger rows: percent of a segment shared by cost (the last model takes the rest), seen at the earliest time that
    an interval ending there was checked or one starting there began, else the earliest check of an active interval, and named by
    the active row of least seq. intervals: key, seq, started_at, checked_at, account_id, start_percent, end_percent, models (map)."""
    from usagelake.operators.deltas import proportional_split

    flat = intervals.select(*key, "seq", "start_percent", "end_percent", F.explode("models").alias("model", "cost"))
    seg = sweep(flat, key, "start_percent", "end_percent", "model", "cost")
    ends = intervals.where("end_percent > start_percent")
    seen = ends.select(*key, F.col("end_percent").alias("segment_end"), F.col("checked_at").alias("at")).unionByName(ends.select(*key, F.col("start_percent").alias("segment_end"), F.col("started_at").alias("at"))).where("at is not null").groupBy(*key, "segment_end").agg(F.min("at").alias("seen_at"))
    # whole percents as cells keep the range join an equi-join: a segment meets the intervals of its own cell only
    span = seg.select(*key, "segment_start", "segment_end").distinct().withColumn("cell", F.floor("segment_start"))
    cells = ends.select("*", F.explode(F.sequence(F.floor("start_percent"), F.floor("end_percent"))).alias("cell"))
    active = span.join(cells, [*key, "cell"]).where("start_percent <= segment_start and end_percent >= segment_end").groupBy(*key, "segment_start").agg(F.min("checked_at").alias("first_check"), F.min_by("account_id", "seq").alias("account_id"))
    seg = seg.join(seen, [*key, "segment_end"], "left").join(active, [*key, "segment_start"])
    seg = proportional_split(seg, [*key, "segment_start"], "model", "cost", F.col("segment_end") - F.col("segment_start"), "delta_percent")
    return seg.select(*key, F.coalesce("seen_at", "first_check").alias("checked_at"), "account_id", "model", "delta_percent", F.col("cost").alias("delta_cost"), F.col("total_rate").cast("double").alias("cost_percent_ratio"))


# -- keyed merges ----------------------------------------------------------------------------------------------------------------


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order. Ranked before the shuffle as well (window group limit), so a hot key sends few rows."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def merge_windows(rows: DataFrame, key: list[str], seq: str, known_plan: bool) -> DataFrame:
    """Quota rows(key, window, used_percent, reset_at, plan, seq) of one key and window: the last wins; with known_plan a known plan
    is not replaced by an unknown one."""
    plan = F.max_by(F.when(F.col("plan") != "unknown", F.col("plan")), F.when(F.col("plan") != "unknown", F.col(seq)))
    last = F.max_by("plan", seq)
    return rows.groupBy(*key, "window").agg(F.max_by("used_percent", seq).alias("used_percent"), F.max_by("reset_at", seq).alias("reset_at"), (F.coalesce(plan, last) if known_plan else last).alias("plan"))


def merge_tokens(rows: DataFrame, key: list[str]) -> DataFrame:
    """Token sessions: the latest update, then the most tokens, then the largest content hash."""
    return latest(rows, key, [F.desc("updated_ts"), F.desc("total_tokens"), F.desc("content_hash")])


def token_conflicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose winning update and total come with more than one content."""
    top = rows.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("updated_ts"), F.desc("total_tokens")))).where("_r = 1")
    return top.groupBy(*key).agg(F.count_distinct("content_hash").alias("contents")).where("contents > 1")


def merge_costs(rows: DataFrame, seq: str) -> DataFrame:
    """Rows that are no intervals as they are; intervals of one record key: the last."""
    return rows.where("record_type <> 'costInterval' or record_type is null").unionByName(latest(rows.where("record_type = 'costInterval'"), ["record_key"], [F.desc(seq)]))


def record_key(kind: Column, *identity: Column) -> Column:
    """A deterministic record id: the hash of its kind and identity."""
    return F.sha2(F.concat_ws(":", kind, *(F.coalesce(c.cast("string"), F.lit("")) for c in identity)), 256)


def account_key(account_id: Column, slot: Column) -> Column:
    return F.coalesce(F.nullif(account_id, F.lit("")), F.concat(F.lit("local:"), F.coalesce(slot, F.lit("unknown"))))


def content_hash(*cols: str) -> Column:
    """A canonical hash of columns: equal rows have equal hashes. It is not the hash of another system's JSON text."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def with_provenance(df: DataFrame, kind: str, machine: str, identity: list[str]) -> DataFrame:
    """Stamp rows that have no origin with this machine and a record id; stamped rows stay as they are."""
    own = F.col("origin").isNull()
    return df.withColumns({"record_id": F.when(own, record_key(F.lit(kind), *map(F.col, identity))).otherwise(F.col("record_id")), "origin": F.coalesce("origin", F.lit(machine))})


def own_records(df: DataFrame, machine: str) -> DataFrame:
    """What this machine publishes: of its own origin, not local only, without labels."""
    return df.where((F.col("origin") == machine) & ~F.coalesce("local_only", F.lit(False))).drop("account_label")


def merged_view(local: DataFrame, cache: DataFrame, machine: str) -> DataFrame:
    """Token sessions of all machines: own rows and other machines' cached ones, one per account and session."""
    both = local.unionByName(cache.where(F.col("origin") != machine), allowMissingColumns=True)
    return merge_tokens(both.withColumn("account_key", account_key(F.col("account_id"), F.col("account_slot"))), ["account_key", "session_id"])


def merged_datasets(local: dict[str, DataFrame], cache: dict[str, DataFrame], machine: str, accounts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The merged view of all three datasets: cost, quota and token rows of this machine and, from the cache, of the others.

    Cached rows take the slot and label that `accounts` (account_id, account_slot, account_label) gives their account; those of other
    accounts keep their own. Cost rows need record_type, record_key and seq, quota rows checked_at, window and seq, token rows what
    `merge_tokens` needs, and all of them origin, account_id and account_slot.
    """

    def both(kind: str) -> DataFrame:
        other = cache[kind].where(F.col("origin") != machine)
        if accounts is not None:
            mapped = accounts.select("account_id", F.struct("account_slot", "account_label").alias("_to"))
            own = lambda c: F.coalesce(F.col(f"_to.{c}"), F.col(c) if c in other.columns else F.lit(None).cast("string")).alias(c)
            rest = [c for c in other.columns if c not in ("account_slot", "account_label")]
            other = other.join(mapped, "account_id", "left").select(*rest, own("account_slot"), own("account_label"))
        return local[kind].unionByName(other, allowMissingColumns=True).withColumn("account_key", account_key(F.col("account_id"), F.col("account_slot")))

    return {"cost": merge_costs(both("cost"), "seq"), "quota": merge_windows(both("quota"), ["account_key", "checked_at"], "seq", False), "token": merge_tokens(both("token"), ["account_key", "session_id"])}


def resolved_accounts(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """rows whose account id still stands for a slot of this machine (`local:`) with the account that the slot has now, by accounts
    (account_slot, account_id); their record id and origin go, so that they are stamped anew. Others stay as they are."""
    known = accounts.where(F.col("account_id").isNotNull() & ~F.col("account_id").startswith("local:")).select("account_slot", F.col("account_id").alias("_now"))
    j = rows.join(known, "account_slot", "left").withColumn("_new", F.coalesce(F.col("account_id").startswith("local:") & F.col("_now").isNotNull(), F.lit(False)))
    value = {"account_id": F.col("_now"), "record_id": F.lit(None), "origin": F.lit(None)}
    return j.select(*(F.when(F.col("_new"), value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in rows.columns))


def quota_order(ts: str = "checked_ts", raw: str = "checked_at", account: str = "account_slot") -> list[Column]:
    """The order of quota rows: those without a time last, then by time, by the text of the time, and by account."""
    return [F.col(ts).isNull(), F.coalesce(ts, F.lit(0)), F.col(raw), F.col(account)]


def ledger_order(seq: str = "seq") -> list[Column]:
    """The order of a ledger: by the text of the time, not the time itself, then by window; `seq` keeps the order of input among equals."""
    return [F.col("checked_at"), F.col("window"), F.col(seq)]


def interval_order(last: str = "record_key") -> list[Column]:
    """The order of cost intervals by time text, window and key; of aggregated rows with last='model'."""
    return [F.col("checked_at"), F.col("window"), F.col(last)]
