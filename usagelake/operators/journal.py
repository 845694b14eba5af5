"""Change data: snapshot diffs, batches, replay, journals and their compaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from usagelake.operators.blocks import BLOCK_ROWS
from usagelake.operators.fold import fold
from usagelake.operators.reconcile import content_hash, latest
from usagelake.session import materialized
from usagelake.sources import markers

MAX_KEY, MAX_RECORD, MAX_DEPTH, BATCH_OPS, BATCH_BYTES, COMPACT_CHUNKS = 512, 256 * 1024, 12, 500, 512 * 1024, 128


def diff(now: DataFrame, published: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, action): upsert what is new or differs by hash, delete what is published and no more there."""
    n = now.select(*key, content_hash(*values).alias("_n"))
    p = published.select(*key, content_hash(*values).alias("_p"))
    action = F.when(F.col("_n").isNull(), "delete").when(F.col("_p").isNull() | (F.col("_n") != F.col("_p")), "upsert")
    return n.join(p, key, "full_outer").select(*key, action.alias("action")).where("action is not null")


def json_depth(text: Column) -> Column:
    """How many objects and lists the innermost value of a JSON text lies in: brackets outside of strings, counted."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "0"), r"\{\s*\}|\[\s*\]", "0")
    brackets = F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(brackets, zero, step, lambda a: a["most"])


def valid_operation(action: Column, kind: Column, key: Column, record: Column, record_key: Column) -> Column:
    """Whether an operation is of a known action and kind, with a key of bounded length that is its record's own, and a record of bounded
    size and depth; false where any of them is null."""
    text = F.coalesce(record, F.lit(""))
    small = (F.octet_length(text) <= MAX_RECORD) & (json_depth(text) <= MAX_DEPTH)
    good = action.isin("upsert", "delete") & kind.isin("cost", "quota", "token") & F.length(key).between(1, MAX_KEY) & small & (key == record_key) & ((action == "delete") | record.isNotNull())
    return F.coalesce(good, F.lit(False))


def valid_operations(ops: DataFrame) -> DataFrame:
    """Operations that are valid: see `valid_operation`."""
    return ops.where(valid_operation(*map(F.col, ("action", "kind", "key", "record", "record_key"))))


def batches(ops: DataFrame, stream: list[str], order: list[str], size: str, max_ops: int = BATCH_OPS, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Add batch: operations of a stream in order, a new batch where the next would exceed either bound."""
    at = ops.columns.index(size)
    schema = ", ".join(f"{n} {t}" for n, t in ops.dtypes) + ", batch long"

    class Open:
        n = used = batch = 0

    def step(b: Open, r) -> list[tuple]:
        add = r[at]
        if b.n and (b.n >= max_ops or b.used + add > max_bytes):
            b.n = b.used = 0
            b.batch += 1
        b.n, b.used = b.n + 1, b.used + add
        return [(*r, b.batch)]

    return fold(ops, stream, order, Open, step, schema)


def replay(base: DataFrame, ops: DataFrame, key: list[str], seq: str, action: str = "action", reset: DataFrame | None = None, origin: str = "origin") -> DataFrame:
    """base after ordered operations: the last one of a key counts. reset: origins whose earlier rows go first."""
    if reset is not None:
        base = base.join(reset, origin, "left_anti")
    last = latest(ops, key, [F.desc(seq)])
    kept = base.join(last.select(*key), key, "left_anti")
    return kept.unionByName(last.where(F.col(action) == "upsert").select(*base.columns))


def _in_blocks(links: DataFrame, follow: Callable[[pa.Table, list[int | None]], list], out: str) -> DataFrame:
    """links(block, machine_id, chunk_id, parent_id, many, ...) with the column `out` that `follow` gives of a partition's rows and, for each, the
    place of its parent in its block (None where it is not there, or has many rows). A task holds its
    partition, of some few blocks of bounded size."""
    schema = StructType([*links.schema.fields, *_parse_datatype_string(out).fields])
    shape = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(parts):
            t = pa.Table.from_batches(rows)
            block, machine, chunk, parent, many = (t.column(c).to_pylist() for c in ("block", "machine_id", "chunk_id", "parent_id", "many"))
            at = {(b, m, c): i for i, (b, m, c, x) in enumerate(zip(block, machine, chunk, many)) if c is not None and not x}
            up = [None if p is None else at.get((b, m, p)) for b, m, p in zip(block, machine, parent)]
            found = follow(t, up)
            yield from t.append_column(shape.field(len(shape) - 1), pa.array(found, shape.types[-1])).cast(shape).to_batches(10_000)

    return links.mapInArrow(run, schema)


def _exits(t: pa.Table, up: list[int | None]) -> list[str | None]:
    """For each row the first chunk on its way back that is not in the block; none where the way ends, or goes round."""
    parent, out, state = t.column("parent_id").to_pylist(), [None] * len(up), bytearray(len(up))
    for i in range(len(up)):
        way, j = [], i
        while not state[j]:
            state[j] = 1
            way.append(j)
            if up[j] is None:
                out[j], state[j] = parent[j], 2
                break
            j = up[j]
        end = out[j] if state[j] == 2 else None
        for k in way:
            out[k], state[k] = end, 2
    return out


def _passed(t: pa.Table, up: list[int | None]) -> list[bool]:
    """The rows on the ways back from those that are reached from outside of the block."""
    out = [False] * len(up)
    for i, start in enumerate(t.column("start").to_pylist()):
        j = i if start else None
        while j is not None and not out[j]:
            out[j], j = True, up[j]
    return out


def chunk_chain(chunks: DataFrame, heads: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(machine_id, chunk_id, sequence, needs_checkpoint): the chunks from each machine's head back to its cursor, by parent links, for replay
    in rising sequence.

    chunks(machine_id, chunk_id, parent_id, sequence), heads(machine_id, head_chunk, cursor_chunk, cursor_sequence); a null cursor is the
    beginning. A chain that ends elsewhere (a parent that is lost, or a branch that passes by the cursor) needs a checkpoint; chunks of
    other branches are not in it. Links are cut into blocks by ranges of machine and sequence. A task follows those within its block, so
    that only the chunks that a link enters a block by are left, some one a block and branch. These are followed by doubling: a round
    joins what is reached with jumps of twice the length of the round before. A second pass over the blocks marks what lies between. Each
    row is thus shuffled and written a fixed number of times, however long the chains are; a chunk_id of several rows is followed by
    doubling alone, and links that jump about in sequence cost as many rounds as doubling over all of them.
    """
    spark, at = chunks.sparkSession, ["machine_id", "chunk_id"]
    edge, own = materialized(chunks.join(heads, "machine_id").where("sequence > coalesce(cursor_sequence, -1)").select("machine_id", "chunk_id", "parent_id", "sequence", F.col("parent_id").eqNullSafe(F.col("cursor_chunk")).alias("met")), "chain-links")
    n = max(2, -(-edge.count() // block_rows))
    copies = edge.groupBy(*at).agg(F.count("*").alias("_n")).where("_n > 1").select(*at, F.lit(True).alias("many"))
    cut = edge.join(copies, at, "left").withColumn("many", F.coalesce("many", F.lit(False))).repartitionByRange(n, "machine_id", "sequence", "chunk_id").withColumn("block", F.spark_partition_id())
    edge, path = materialized(_in_blocks(cut, _exits, "to string"), "chain-blocks")
    stale = [own, path]

    first = heads.select("machine_id", F.col("head_chunk").alias("chunk_id"))
    entered = edge.where("to is not null").select("machine_id", F.col("to").alias("chunk_id")).distinct().unionByName(first).distinct()
    gates, path = materialized(edge.select(*at, "to").join(entered, at, "left_semi"), "chain-gates")
    stale.append(path)
    known, jump = gates.select(*at), gates.where("to is not null")
    reach, path = materialized(first.join(known, at, "left_semi"), "chain-reach")
    stale.append(path)
    size = reach.count()
    while True:
        step = reach.join(jump, at).select("machine_id", F.col("to").alias("chunk_id")).join(known, at, "left_semi")
        reach, path = materialized(reach.unionByName(step).distinct(), "chain-reach")
        stale.append(path)
        if (now := reach.count()) == size:
            break
        size = now
        ahead = jump.select("machine_id", F.col("to").alias("chunk_id"), F.col("chunk_id").alias("_from"))
        jump, path = materialized(ahead.join(jump, at).select("machine_id", F.col("_from").alias("chunk_id"), "to"), "chain-jumps")
        stale.append(path)
    started = edge.drop("to").join(reach.distinct().withColumn("start", F.lit(True)), at, "left").withColumn("start", F.coalesce("start", F.lit(False)))
    walked, _ = materialized(_in_blocks(started.repartition(n, "block"), _passed, "passed boolean").where("passed").select(*at, "sequence", "met"), "chain-walked")
    markers.delete(spark, *stale)
    whole = walked.groupBy("machine_id").agg(F.max("met").alias("_met"))
    return walked.join(whole, "machine_id").select(*at, "sequence", (~F.col("_met")).alias("needs_checkpoint"))


def should_compact(chunks: int, tail_bytes: int, checkpoint_bytes: int, new_bytes: int) -> bool:
    """Whether to write a new checkpoint: a long tail, and a quarter of the bytes saved."""
    return chunks >= COMPACT_CHUNKS and new_bytes <= 0.75 * (checkpoint_bytes + tail_bytes)


class Conflict(Exception):
    """Another publication took the place of this one in the journal."""


def _own(path: str, machine: str) -> str:
    return f"{path}/machine={machine}"


def pointer(spark: SparkSession, path: str, machine: str) -> tuple[int, dict | None]:
    """(revision, pointer) of a machine's journal: the newest of its pointer files, -1 and None before the first. A pointer names the head
    and the checkpoint that its chain begins with, the key and values of the records, and the tail's numbers of chunks and bytes."""
    own = _own(path, machine)
    found = markers.names(spark, f"{own}/pointers")
    return (int(found[-1]), json.loads(markers.read(spark, f"{own}/pointers/{found[-1]}"))) if found else (-1, None)


def head(spark: SparkSession, path: str, machine: str) -> int | None:
    """The sequence of the last publication of a machine, None before the first."""
    at = pointer(spark, path, machine)[1]
    return at and at["sequence"]


def _links(spark: SparkSession, own: str) -> dict[str, tuple[str | None, int]]:
    """Parent and sequence of all publications since the last compaction, those that lost their race among them: no head leads to these.
    One small row a publication, whatever it holds."""
    rows = spark.read.text(f"{own}/links", wholetext=True).select(F.from_json("value", "struct<chunk_id:string,parent_id:string,sequence:long>").alias("l"))
    return {r.chunk_id: (r.parent_id, r.sequence) for r in rows.select("l.*").toLocalIterator()}


def _chain(spark: SparkSession, own: str, at: dict, until: str) -> list[str] | None:
    """The publications after `until` up to a pointer's head, newest first; None where the head's chain does not lead there."""
    links, chunk, out = _links(spark, own), at["head"], []
    while chunk != until:
        if chunk not in links:
            return None
        out.append(chunk)
        chunk = links[chunk][0]
    return out


def chunked(ops: DataFrame, key: list[str], max_ops: int = BATCH_OPS, max_bytes: int = BATCH_BYTES, lane_ops: int = 100_000) -> DataFrame:
    """Add lane and batch: operations in chunks of at most `max_ops` and `max_bytes`. Lanes by key hash hold some `lane_ops` each and
    are cut by tasks of their own, so that no task orders a whole publication."""
    lanes = max(1, -(-ops.count() // lane_ops))
    sized = ops.withColumns({"lane": F.pmod(F.xxhash64(*key), F.lit(lanes)).cast("int"), "_size": F.octet_length(F.to_json(F.struct(*ops.columns)))})
    return batches(sized.withColumnRenamed("_size", "size"), ["lane"], key, "size", max_ops, max_bytes).drop("size")


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def _stored(spark: SparkSession, own: str, rows: DataFrame) -> tuple[str, int, int]:
    """Write rows as a publication of a new name, read back and compared: (name, rows, bytes). Nothing leads to it yet."""
    name = uuid.uuid4().hex
    target = f"{own}/data/publication={name}"
    rows = rows.cache()
    try:
        told = _digest(rows)
        rows.write.parquet(target)
        if _digest(spark.read.parquet(target).select(rows.columns)) != told:
            raise OSError(f"{target} does not hold what was written")
    finally:
        rows.unpersist()
    return name, told[0], markers.size(spark, target)


def _point(spark: SparkSession, path: str, machine: str, revision: int, at: dict) -> None:
    """Make a pointer the machine's newest, if none came since the revision before it: the compare-and-set of a publication."""
    if not markers.create(spark, f"{_own(path, machine)}/pointers/{revision:012d}", json.dumps(at)):
        raise Conflict(f"revision {revision} of {machine} was published meanwhile")
    if markers.read(spark, f"{_own(path, machine)}/pointers/{revision:012d}") != json.dumps(at):
        raise OSError(f"the pointer of {machine} does not say what was written")


def publish(now: DataFrame, path: str, machine: str, key: list[str], values: list[str], expected: int | None = None) -> int:
    """Append what changed since the last publication to a journal of Parquet files; returns the number of operations.

    The first publication is a checkpoint, later ones are chunks (lane and batch tell them apart) of bounded numbers of operations and
    bytes. Each is written under a name of its own and linked to its parent; then a pointer file of the next revision is created, which
    only one publisher can do: another one that saw the same head gets Conflict, and what it wrote goes. Conflict is raised too where
    the journal is not at `expected`. Key and values are those of the first publication. A tail that grew long is compacted if that
    saves enough (`should_compact`).
    """
    if taken := {"_action", "_sequence", "lane", "batch"} & {*key, *values}:
        raise ValueError(f"names of the journal itself: {taken}")
    spark, own = now.sparkSession, _own(path, machine)
    revision, at = pointer(spark, path, machine)
    if expected is not None and expected != (-1 if at is None else at["sequence"]):
        raise Conflict(f"the journal of {machine} is at {at and at['sequence']}, not at {expected}")
    if at is None:
        out, seq = now.select(*key, *values, F.lit("upsert").alias("_action")), 0
    else:
        if (at["key"], at["values"]) != (list(key), list(values)):
            raise ValueError(f"the journal of {machine} has the key {at['key']} and the values {at['values']}")
        changed = diff(now, _state(spark, path, machine, at), key, values).withColumnRenamed("action", "_action")
        out, seq = changed.join(now.select(*key, *values), key, "left").select(*key, *values, "_action"), at["sequence"] + 1
    rows = chunked(out.withColumn("_sequence", F.lit(seq).cast("long")), key)
    name, n, size = _stored(spark, own, rows)
    if at is not None and not n:
        markers.delete(spark, f"{own}/data/publication={name}")
        return 0
    link = f"{own}/links/{name}"
    markers.create(spark, link, json.dumps({"chunk_id": name, "parent_id": at and at["head"], "sequence": seq}))
    if at is None:
        new = {"sequence": 0, "head": name, "checkpoint": name, "checkpoint_sequence": 0, "checkpoint_bytes": size, "tail_chunks": 0, "tail_bytes": 0, "key": list(key), "values": list(values)}
    else:
        chunks = spark.read.parquet(f"{own}/data/publication={name}").select("lane", "batch").distinct().count()
        new = at | {"sequence": seq, "head": name, "tail_chunks": at["tail_chunks"] + chunks, "tail_bytes": at["tail_bytes"] + size}
    try:
        _point(spark, path, machine, revision + 1, new)
    except Conflict:
        markers.delete(spark, link, f"{own}/data/publication={name}")
        raise
    if new["tail_chunks"] >= COMPACT_CHUNKS:
        _compacted(spark, path, machine, revision + 1, new, policy=True)
    return n


def publish_changes(spark: SparkSession, change: Callable[[DataFrame | None], DataFrame], path: str, machine: str, key: list[str], values: list[str], attempts: int = 5) -> int:
    """Publish what `change` makes of the published records; where another publisher was faster, again from what is published then."""
    for k in range(attempts):
        at = head(spark, path, machine)
        try:
            return publish(change(read_journal(spark, path, machine)), path, machine, key, values, -1 if at is None else at)
        except Conflict:
            if k == attempts - 1:
                raise
    return 0


def _replayed(spark: SparkSession, own: str, at: dict, publications: list[str]) -> DataFrame:
    """The last operation of every key over some publications, with its action."""
    rows = spark.read.parquet(*(f"{own}/data/publication={p}" for p in publications))
    return latest(rows, at["key"], [F.desc("_sequence")]).select(*at["key"], *at["values"], "_action")


def _state(spark: SparkSession, path: str, machine: str, at: dict) -> DataFrame:
    own = _own(path, machine)
    tail = _chain(spark, own, at, at["checkpoint"])
    if tail is None:
        raise OSError(f"the chain of {machine} does not lead to its checkpoint")
    return _replayed(spark, own, at, [at["checkpoint"], *tail]).where("_action = 'upsert'").drop("_action")


def read_journal(spark: SparkSession, path: str, machine: str) -> DataFrame | None:
    """The published records of a machine, or None if there are none yet."""
    at = pointer(spark, path, machine)[1]
    return at and _state(spark, path, machine, at)


def catch_up(spark: SparkSession, path: str, machine: str, cursor: dict | None) -> tuple[DataFrame | None, dict | None, bool]:
    """(operations, new cursor, from the checkpoint): what a reader that applied all up to `cursor` (chunk_id, sequence) has to apply, with
    _action upsert or delete. None where nothing was published since. Where the chain does not lead back to the cursor, as after a
    compaction, all records come as upserts and the reader's own go first."""
    _, at = pointer(spark, path, machine)
    if at is None or (cursor and cursor["chunk_id"] == at["head"]):
        return None, cursor, False
    own, new = _own(path, machine), {"chunk_id": at["head"], "sequence": at["sequence"]}
    if cursor is not None and (tail := _chain(spark, own, at, cursor["chunk_id"])):
        return _replayed(spark, own, at, tail), new, False
    return _state(spark, path, machine, at).withColumn("_action", F.lit("upsert")), new, True


def merge_with_deletions(local: DataFrame, remote: DataFrame, deletions: DataFrame, cleared: DataFrame, key: list[str], local_wins: bool) -> DataFrame:
    """Two snapshots by key, one side's rows first; keys deleted and not cleared since go."""
    first, second = (local, remote) if local_wins else (remote, local)
    both = first.unionByName(second.join(first.select(*key), key, "left_anti"))
    return both.join(deletions.select(*key).exceptAll(cleared.select(*key)), key, "left_anti")


def compact(spark: SparkSession, path: str, machine: str) -> None:
    """Write the state of a machine's journal as a checkpoint, whatever that saves, and delete what it replaces."""
    revision, at = pointer(spark, path, machine)
    if at is not None and at["head"] != at["checkpoint"]:
        _compacted(spark, path, machine, revision, at, policy=False)


def _compacted(spark: SparkSession, path: str, machine: str, revision: int, at: dict, policy: bool) -> None:
    """Point a machine's journal at a checkpoint of its state under the same sequence, then delete the publications before it. A checkpoint
    that the policy finds too large goes again; so does one whose place another publication took, as that is in the tail then."""
    own, zero = _own(path, machine), F.lit(0)
    state = _state(spark, path, machine, at).select("*", F.lit("upsert").alias("_action"), F.lit(at["sequence"]).cast("long").alias("_sequence"), zero.alias("lane"), zero.cast("long").alias("batch"))
    name, _, size = _stored(spark, own, state)
    if policy and not should_compact(at["tail_chunks"], at["tail_bytes"], at["checkpoint_bytes"], size):
        markers.delete(spark, f"{own}/data/publication={name}")
        return
    markers.create(spark, f"{own}/links/{name}", json.dumps({"chunk_id": name, "parent_id": None, "sequence": at["sequence"]}))
    try:
        _point(spark, path, machine, revision + 1, at | {"head": name, "checkpoint": name, "checkpoint_sequence": at["sequence"], "checkpoint_bytes": size, "tail_chunks": 0, "tail_bytes": 0})
    except Conflict:
        markers.delete(spark, f"{own}/links/{name}", f"{own}/data/publication={name}")
        return
    for old in [c for c, (_, sequence) in _links(spark, own).items() if sequence <= at["sequence"] and c != name]:
        markers.delete(spark, f"{own}/data/publication={old}", f"{own}/links/{old}")


def split_origin(df: DataFrame, machine: str) -> tuple[DataFrame, DataFrame]:
    """(own, foreign): rows of this machine or of none, and rows that belong in the cache of another's."""
    own = F.coalesce(F.col("origin") == machine, F.lit(True))
    return df.where(own), df.where(~own)


def to_fetch(remote: DataFrame, local: DataFrame, key: list[str], digest: str = "sha256") -> DataFrame:
    """Packages to fetch: not here, or here with another hash."""
    return remote.join(local.select(*key, digest), [*key, digest], "left_anti")


def unreferenced(stored: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """Stored packages that nothing refers to."""
    return stored.join(references.select(*key).distinct(), key, "left_anti")
