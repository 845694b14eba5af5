"""Conversation repair against exhaustive search, with the edge cases of its docstring."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from usagelake.llm import conversation_repair as repair
from usagelake.llm import queries

ROW = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text
        out += [(conv, turn, "user" if deal == 4 else role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    return out


def in_order(rows):
    said = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], said(r)))


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Every audit of up to three inserts between turns, by exhaustion: (cost, audit, repaired rows)."""

    @functools.lru_cache(None)
    def full(i, state, inserted):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        if inserted < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in {("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    out += [(c + 5, "I" + a, ((new, ""), *t)) for c, a, t in [full(i, new[0], inserted + 1)] if c < 10**6]
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, t = full(i + 1, state, 0)
            out.append((c + 2, "D" + a, t))
            if faults[i] in (None, "truncated"):
                more = 5 if faults[i] else 0
                for new, edit, cost in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    if (state, new[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        c, a, t = full(i + 1, new[:1], 0)
                        out.append((c + cost + more, edit + a, ((new, text), *t)))
        return min(out, default=(10**6, "", ()))

    return full(0, "", 0)


def expected(rows):
    ids = {r[0] for r in rows}
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for i in ids:
        mine = in_order(by[i])
        found = faults_of(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        first = [r[2][:1] for r in mine]
        cost, audit, done = cheapest(mine, tuple(found))
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in done))
        counts = [found.count(k) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[i] = (len(mine), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def found(spark, rows):
    got = repair.summary(repair.damaged(spark.createDataFrame(rows, ROW))).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_random_conversations_against_exhaustive_search(spark):
    rng = random.Random(7)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "why", " \t\n", "", None, "Long text. cut", "a?  ", "é…", "x\x00."]
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles if rng.random() < 0.4 else roles[:3]), rng.choice(texts)))
    assert found(spark, rows) == expected(rows)


def test_ties_repeats_nulls_and_clashing_names(spark):
    rows = [(None, None, "user", "a."), (None, None, "user", "a."), (None, 3, "assistant", None), (1, 5, "user", "same."), (1, 5, "user", "same."), (1, 5, "assistant", "same."), (2, None, None, None)]
    assert found(spark, rows) == expected(rows)
    clash = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("x") for c in ("audit", "lost", "said", "fault", "kind", "cost", "position", "_conv")})
    got = repair.summary(repair.damaged(clash)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    none = repair.summary(repair.damaged(spark.createDataFrame([], ROW)))
    assert none.count() == 0


def test_one_long_conversation_and_very_long_texts(spark):
    rows = [(7, i, "user", f"{i} " + "word " * (40_000 if i == 3 else 3) + ".") for i in range(3000)]
    got = found(spark, rows)[7]
    want = in_order(damage(rows))
    path = repair.Viterbi()
    for r, f in zip(want, faults_of(want)):
        path.turn(r[2][:1], f)
    assert (got[6], got[7]) == path.best() and got[7].count("I") + len(want) == len(got[7]) and len(path.steps) == 4 * len(want)


def test_repaired_turns_are_the_operators_output(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", "Ask?"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, ROW)
    plans = repair.plan(df)
    turns = repair.repaired(df, plans).orderBy("conv_id", "position").collect()
    for r in plans.collect():
        cost, audit, done = cheapest([x for x in rows if x[0] == r.conv_id], tuple(faults_of([x for x in rows if x[0] == r.conv_id])))
        assert (r.cost, r.audit) == (cost, audit) and [(t.role, t.text) for t in turns if t.conv_id == r.conv_id] == list(done)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()}
    assert got == expected(rows)
