"""Journals: publication as a compare-and-set, keys of any name, the compaction policy, and chains of parents."""

import random

import duckdb
import pytest

from usagelake.operators import journal
from usagelake.sources import markers

KV = (["id"], ["k_weight"])


def of(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id string, k_weight long")


def state(spark, path):
    return {r.id: r.k_weight for r in journal.read_journal(spark, path, "m").collect()}


def test_the_key_is_the_journals_own(spark, tmp_path):
    path = str(tmp_path / "j")
    for rows, n in (({"a": 1, "b": 1}, 2), ({"a": 2, "b": 1}, 1), ({"a": 2}, 1)):
        assert journal.publish(of(spark, rows), path, "m", *KV) == n and state(spark, path) == rows
    with pytest.raises(ValueError, match="key"):
        journal.publish(of(spark, {"a": 2}), path, "m", ["k_weight"], ["id"])
    journal.compact(spark, path, "m")
    assert state(spark, path) == {"a": 2}


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("step", ["data", "link", "pointer"])
def test_of_two_publishers_one_gets_a_conflict_and_no_record_goes(spark, tmp_path, monkeypatch, step, first):
    path, begun = str(tmp_path / "j"), {} if first else {"w": 0}
    if begun:
        journal.publish(of(spark, begun), path, "m", *KV)
    real_create, real_stored, busy = markers.create, journal._stored, []

    def other():  # the second publisher does all its work while the first is at this step
        if not busy:
            busy.append(step)
            journal.publish(of(spark, begun | {"y": 2}), path, "m", *KV)

    def create(s, name, text):
        if f"/{step}s/" in name:
            other()
        return real_create(s, name, text)

    def stored(*a):
        if step == "data":
            other()
        return real_stored(*a)

    monkeypatch.setattr(markers, "create", create)
    monkeypatch.setattr(journal, "_stored", stored)
    with pytest.raises(journal.Conflict):
        journal.publish(of(spark, begun | {"x": 1}), path, "m", *KV)
    assert busy and state(spark, path) == begun | {"y": 2}
    n = len(markers.names(spark, f"{path}/machine=m/data"))
    assert n == len(markers.names(spark, f"{path}/machine=m/links")) == len(begun) + 1
    busy.clear()
    change = lambda now: of(spark, {"x": 1}).unionByName(now.where("id <> 'x'")) if now is not None else of(spark, {"x": 1})
    monkeypatch.setattr(journal, "_stored", real_stored)
    monkeypatch.setattr(markers, "create", real_create)
    assert journal.publish_changes(spark, change, path, "m", *KV) == 1 and state(spark, path) == begun | {"x": 1, "y": 2}


def test_publish_changes_tries_again_after_a_conflict(spark, tmp_path, monkeypatch):
    path, real, busy = str(tmp_path / "j"), markers.create, []
    journal.publish(of(spark, {"w": 0}), path, "m", *KV)

    def create(s, name, text):
        if "/pointers/" in name and not busy:
            busy.append(1)
            journal.publish(of(spark, {"w": 0, "y": 2}), path, "m", *KV)
        return real(s, name, text)

    monkeypatch.setattr(markers, "create", create)
    assert journal.publish_changes(spark, lambda now: now.unionByName(of(spark, {"x": 1})), path, "m", *KV, attempts=2) == 1
    assert state(spark, path) == {"w": 0, "x": 1, "y": 2} and journal.head(spark, path, "m") == 2


def test_publish_compacts_by_the_policy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "COMPACT_CHUNKS", 3)
    path, rows = str(tmp_path / "j"), {str(i): i for i in range(50)}
    for k in range(4):
        journal.publish(of(spark, {i: v + k for i, v in rows.items()}), path, "m", *KV)
    revision, at = journal.pointer(spark, path, "m")
    assert at["tail_chunks"] == 0 and at["sequence"] == 3 and revision == 4 and len(markers.names(spark, f"{path}/machine=m/data")) == 1
    assert state(spark, path) == {i: v + 3 for i, v in rows.items()}
    monkeypatch.setattr(journal, "should_compact", lambda *a: False)
    for k in range(4, 8):
        journal.publish(of(spark, {i: v + k for i, v in rows.items()}), path, "m", *KV)
    assert journal.pointer(spark, path, "m")[1]["tail_chunks"] == 4 and len(markers.names(spark, f"{path}/machine=m/data")) == 5


def test_readers_catch_up_by_the_chain_or_from_the_checkpoint(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journal.catch_up(spark, path, "m", None)[0] is None
    journal.publish(of(spark, {"a": 1, "b": 1}), path, "m", *KV)
    ops, cursor, whole = journal.catch_up(spark, path, "m", None)
    assert whole and {(r.id, r.k_weight, r._action) for r in ops.collect()} == {("a", 1, "upsert"), ("b", 1, "upsert")}
    assert journal.catch_up(spark, path, "m", cursor) == (None, cursor, False)
    for rows in ({"a": 2, "b": 1}, {"a": 3}, {"a": 3, "c": 1}):
        journal.publish(of(spark, rows), path, "m", *KV)
    ops, new, whole = journal.catch_up(spark, path, "m", cursor)
    assert not whole and {(r.id, r.k_weight, r._action) for r in ops.collect()} == {("a", 3, "upsert"), ("b", None, "delete"), ("c", 1, "upsert")}
    journal.compact(spark, path, "m")
    ops, _, whole = journal.catch_up(spark, path, "m", cursor)
    assert whole and {(r.id, r.k_weight) for r in ops.collect()} == {("a", 3), ("c", 1)}
    assert journal.catch_up(spark, path, "m", new)[2]  # its head is of before the compaction


def test_chains_with_gaps_forks_and_lost_parents_against_recursive_sql(spark):
    rng, chunks, heads = random.Random(4), [], []
    for m in range(30):
        ids = [f"{m}-{i}" for i in range(rng.randrange(1, 40))]
        parent = {c: ids[i - 1] if i else None for i, c in enumerate(ids)}
        sequence = {c: 3 * i for i, c in enumerate(ids)}  # gaps
        for k in range(rng.randrange(4)):  # forks
            at = rng.choice(ids)
            parent[f"{m}-f{k}"], sequence[f"{m}-f{k}"] = at, sequence[at] + 1
        lost = rng.choice(ids) if m % 3 == 0 else None
        chunks += [(f"m{m}", c, p, sequence[c]) for c, p in parent.items() if c != lost]
        there = [c for c in parent if c != lost]
        if there:
            head = max(there, key=lambda c: sequence[c])
            cursor = rng.choice([None, *there])
            heads.append((f"m{m}", head, cursor, None if cursor is None else sequence[cursor]))
    c = spark.createDataFrame(chunks, "machine_id string, chunk_id string, parent_id string, sequence long")
    h = spark.createDataFrame(heads, "machine_id string, head_chunk string, cursor_chunk string, cursor_sequence long")
    got = sorted(tuple(r) for r in journal.chunk_chain(c, h).collect())
    con = duckdb.connect()
    cdf, hdf = c.toPandas(), h.toPandas()  # noqa: F841
    hdf["cursor_sequence"] = hdf["cursor_sequence"].astype("Int64")
    con.register("c", cdf)
    con.register("h", hdf)
    want = con.sql("""WITH RECURSIVE e AS (SELECT c.*, cursor_chunk, parent_id IS NOT DISTINCT FROM cursor_chunk AS met FROM c JOIN h USING (machine_id) WHERE sequence > coalesce(cursor_sequence, -1)),
        walk AS (SELECT e.* FROM e JOIN h ON e.machine_id = h.machine_id AND e.chunk_id = h.head_chunk UNION ALL SELECT e.* FROM walk JOIN e ON e.machine_id = walk.machine_id AND e.chunk_id = walk.parent_id)
        SELECT machine_id, chunk_id, sequence, NOT bool_or(met) OVER (PARTITION BY machine_id) FROM walk""").fetchall()
    assert got == sorted(want) and {r[3] for r in got} == {True, False}


def test_a_long_chain_is_written_a_fixed_number_of_times(spark, monkeypatch):
    """Rows that go through the shared folder are a small multiple of the chunks, whatever the length of the chain."""
    n, rows, write = 6000, [], journal.materialized

    def counted(df, name):
        out = write(df, name)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(journal, "materialized", counted)
    c = spark.range(n).selectExpr("'m' machine_id", "cast(id as string) chunk_id", "if(id = 0, null, cast(id - 1 as string)) parent_id", "id sequence")
    h = spark.createDataFrame([("m", str(n - 1), None, None)], "machine_id string, head_chunk string, cursor_chunk string, cursor_sequence long")
    got = journal.chunk_chain(c, h).groupBy("needs_checkpoint").count().collect()
    assert [tuple(r) for r in got] == [(False, n)]
    assert sum(rows) <= 4 * n


def test_chains_over_many_blocks_with_copies_cycles_and_mixed_sequences(spark):
    rng, chunks, heads = random.Random(9), set(), []
    for m in range(6):
        ids = [f"c{i}" for i in range(60)]
        order = list(range(60))
        if m % 2:
            rng.shuffle(order)  # links that jump about in sequence
        for i, c in enumerate(ids):
            chunks.add((f"m{m}", c, ids[i - 1] if i else (ids[20] if m == 4 else None), order[i]))
            if rng.random() < 0.3:  # branches beside the chain
                chunks.add((f"m{m}", f"b{i}", c, order[i] + 1))
        if m in (2, 3):  # a chunk of two rows with parents of their own
            chunks |= {(f"m{m}", "c40", "b-1", order[40] + 7), (f"m{m}", "b-1", "c2", order[39])}
        heads.append((f"m{m}", "c59", None, None))
    c = spark.createDataFrame(sorted(chunks, key=str), "machine_id string, chunk_id string, parent_id string, sequence long")
    h = spark.createDataFrame(heads, "machine_id string, head_chunk string, cursor_chunk string, cursor_sequence long")
    want = []
    for m, head, _, _ in heads:
        own = [r for r in chunks if r[0] == m]
        reached, new = set(), {head}
        while new:
            reached |= new
            new = {r[2] for r in own if r[1] in new} & {r[1] for r in own} - reached
        rows = [r for r in own if r[1] in reached]
        want += [(m, r[1], r[3], all(r[2] is not None for r in rows)) for r in rows]
    for size in (7, 100, 100_000):
        assert sorted(tuple(r) for r in journal.chunk_chain(c, h, block_rows=size).collect()) == sorted(want)
