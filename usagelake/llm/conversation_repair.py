"""Repair of conversations whose turns were lost, emptied, cut, repeated or mislabelled.

Three steps, each of its own use:

1. `faults`: rows by turn, each with its first fault: blank, duplicate (role and text seen earlier in the conversation) or truncated.
   Column expressions only; no text leaves its row, only its digest.
2. `plan`: per conversation a forward Viterbi pass over four grammar states (start, after system, after user, after assistant) that
   carries for each state the cheapest edits so far as (cost, audit string): Keep, Rerole, Delete, and after each turn's layer at most two
   Inserts. Strings of equal cost are compared by the rank of what they grew from and the letters added since, and are held as one byte a
   state and turn that leads back, so a conversation of n turns takes time and 4 bytes in proportion to n, not to its square. That works
   because two audits of a layer hold the same number of turns and end with one: neither can be the start of the other.
3. `repaired`: texts and audits meet in order and stream through a machine that holds one row; it emits the repaired turns.

Costs: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 for each truncated row that is not deleted; blank and duplicate rows must be deleted.
The result's roles, by their first letters, match `(s?(ua)+)?`; among edits of equal cost the ASCII-least audit wins.

Edge cases: null roles, texts and, for `damaged`, ids are one space; a null conversation id is a conversation; null turns come first;
rows of one turn are ordered by role, then by the digest of role and text, so ties and repeated rows have one order; a conversation
without rows, or of none but deleted ones, has no repaired turns; an empty table gives no rows; other columns are ignored, whatever
their names. A conversation is one task's stream: its length is bounded by time, not by memory for its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import written

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads, from each state it may follow.
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LETTERS = "KRD"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): every row with the damage that crc32 of `conv_id:turn` deals it; of 20 remainders 0 loses the
    row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's. Lost rows stay, marked and without text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("deal"))
    text = F.when(F.col("deal").isin(0, 1), "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("deal") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("deal") == 0).alias("lost"), times.alias("_")).drop("_")


def _clean(rows: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    out = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.coalesce(lost, F.lit(False)).alias("lost"))
    return out.withColumn("said", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, said, lost, fault): fault is blank, duplicate, truncated or null; lost rows have none and hide nothing."""
    light = _clean(rows).select("conv_id", "turn", "role", "said", "lost", (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), F.col("text").rlike(rf"[^{SPACE}.!?][{SPACE}]*\z").alias("cut"))
    before = F.row_number().over(Window.partitionBy("conv_id", "lost", "said").orderBy("turn"))
    fault = F.when(F.col("lost"), None).when(F.col("blank"), "blank").when(before > 1, "duplicate").when(F.col("cut"), "truncated")
    return light.repartition("conv_id").select("conv_id", "turn", "role", "said", "lost", fault.alias("fault"), before.alias("before"))


class Viterbi:
    """One conversation's forward pass: `turn` for each row, then `best`."""

    def __init__(self) -> None:
        self.steps = bytearray()  # four bytes a turn: letter, inserts before it and the state it came from
        self.now = {START: (0, 0)}  # state -> (cost, rank of its audit among those of this layer)

    def opened(self) -> dict[int, tuple[int, int, str, int]]:
        """The states that inserts reach from this layer's: state -> (cost, rank, inserts, where from)."""
        out = {s: (c, r, "", s) for s, (c, r) in self.now.items()}
        for _ in range(2):
            for s, (c, r, added, origin) in list(out.items()):
                for to in (USER,) if s != USER else (ASSISTANT,):
                    way = (c + INSERT, r, added + "I", origin)
                    if len(way[2]) <= 2 and (to not in out or way < out[to]):
                        out[to] = way
        return out

    def turn(self, initial: str, fault: str | None) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for s, (c, r, added, origin) in self.opened().items():
            ways = [(s, c + DELETE, "D")]
            if fault in (None, "truncated"):
                if s in FOLLOWS.get(initial, ()):
                    ways.append((FOLLOWS[initial][s], c + KEEP + more, "K"))
                ways.append((ASSISTANT if s == USER else USER, c + REROLE + more, "R"))
            for to, cost, letter in ways:
                way = (cost, r, added + letter, origin)
                if to not in best or way < best[to]:
                    best[to] = way
        layer, order = [0, 0, 0, 0], sorted(best, key=lambda s: best[s][1:3])
        for s, (_, _, letters, origin) in best.items():
            layer[s] = LETTERS.index(letters[-1]) | (len(letters) - 1) << 2 | origin << 4
        self.steps += bytes(layer)
        self.now = {s: (best[s][0], rank) for rank, s in enumerate(order)}

    def best(self) -> tuple[int, str]:
        ends = self.opened()
        cost, _, added, s = min(ends[e] for e in (START, ASSISTANT) if e in ends)
        back = [added]
        for at in range(len(self.steps) - 4, -1, -4):
            step = self.steps[at + s]
            back.append("I" * (step >> 2 & 3) + LETTERS[step & 3])
            s = step >> 4
        return cost, "".join(reversed(back))


def plan(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for every conversation of rows."""
    found = faults(rows)
    kind = found.schema["conv_id"].dataType.simpleString()
    light = found.select("conv_id", "lost", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "said", "before").sortWithinPartitions("conv_id", "turn", "role", "said", "before")
    light = light.select("conv_id", "lost", F.col("turn").cast("long").alias("turn"), "initial", "fault")
    names = ["turns", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_, conv = False, None
        path, count, seen, low, last, initial = Viterbi(), dict.fromkeys(names, 0), 0, None, None, None

        def close() -> None:
            cost, audit = path.best()
            gaps = last - low + 1 - seen if seen else 0
            out.append((conv, *({**count, "gaps": gaps, "cost": cost}[k] for k in names), audit))

        def give() -> Iterator[pa.RecordBatch]:
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:-1]), pa.array(cols[-1], pa.string())], names=["conv_id", *names, "audit"])
                out.clear()

        for b in batches:
            id_type = b.schema.field("conv_id").type
            for own, lost, turn, letter, fault in zip(*(c.to_pylist() for c in b.columns)):
                if not open_ or own != conv:
                    if open_:
                        close()
                    open_, conv = True, own
                    path, count, seen, low, last, initial = Viterbi(), dict.fromkeys(names, 0), 0, None, None, None
                if lost:
                    continue
                count["turns"] += 1
                if fault:
                    count[fault] += 1
                if turn is not None and turn != last:
                    seen, low, last = seen + 1, turn if low is None else low, turn
                if initial is not None and initial + letter not in ("su", "ua", "au"):
                    count["illegal"] += 1
                initial = letter
                path.turn(letter, fault)
            if len(out) > 5000:
                yield from give()
        if open_:
            close()
            yield from give()

    return light.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, text, edit): the repaired turns, in order within each partition; inserted ones have no turn."""
    texts = _clean(rows).where("not lost").select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "said", "text")
    audits = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("said"), F.col("audit").alias("text"))
    met = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "said").drop("said")
    kind = plans.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, conv, position = "", 0, START, None, 0

        def inserts() -> Iterator[tuple]:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                state = ASSISTANT if state == USER else USER
                yield conv, position, None, "assistant" if state == ASSISTANT else "user", "", "I"
                at, position = at + 1, position + 1

        for b in batches:
            out: list[tuple] = []
            for own, row_kind, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if row_kind == 0:
                    out += inserts()  # what the conversation before still lacks
                    audit, at, state, conv, position = text, 0, START, own, 0
                    continue
                out += inserts()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = ASSISTANT if state == USER else SYSTEM if edit == "K" and state == START and role[:1] == "s" else USER
                out.append((conv, position, turn, role if edit == "K" else "assistant" if state == ASSISTANT else "user", text, edit))
                position += 1
            if b.num_rows:
                id_type = b.schema.field("conv_id").type
            if out:
                yield _turns(out, id_type)
        if out := list(inserts()):
            yield _turns(out, id_type)

    return met.mapInArrow(run, f"conv_id {kind}, position long, turn long, role string, text string, edit string")


def _turns(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "position", "turn", "role", "text", "edit"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `repaired` turns, straight from their stream: SHA-256 of `role:text` lines, joined by line ends."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, out, id_type = None, None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            id_type = b.schema.field("conv_id").type
            for own, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = own, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (id_type, pa.string()))], names=["conv_id", "repaired_sha256"])
                out = []
        if sha:
            out.append((conv, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (id_type, pa.string()))], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def summary(rows: DataFrame) -> DataFrame:
    """The plan of every conversation with the digest of its repaired turns; that of no turns is the empty string's."""
    plans, _ = written(plan(rows), "repair-plans")
    done = digests(repaired(rows, plans)).withColumnRenamed("conv_id", "_conv")
    out = plans.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
