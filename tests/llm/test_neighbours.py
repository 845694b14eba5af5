"""Approximate nearest neighbours against brute force: recall, exact scores, and the edge cases of the docstring."""

import numpy as np
from pyspark.sql import functions as F

from usagelake.llm import neighbours, queries

ROW = "vec_id long, embedding array<double>"


def brute(rows, is_query, k=20):
    by_id = {}
    for i, v in rows:
        if i is not None and v is not None:
            by_id.setdefault(i, []).append(v)
    usable = {i: np.array(min(vs), float) for i, vs in ((i, [v for v in vs]) for i, vs in by_id.items()) if len(min(vs)) and None not in min(vs) and np.isfinite(min(vs)).all() and np.any(min(vs))}
    out = {}
    for q, x in usable.items():
        if is_query(q):
            found = sorted((-float(x @ y), i) for i, y in usable.items() if i != q and len(y) == len(x))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def found(df, is_query, **more):
    out = {}
    for r in neighbours.nearest(df, is_query, **more).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all(abs(a - b) <= 1e-9 * max(1, abs(b)) for q in got for (_, a), (_, b) in zip(got[q], want[q]))


def test_edge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]),
            (8, []), (None, [1.0, 1.0]), (9, [-1.0, 0.5]), (60, [1.0, 2.0, 3.0]), (61, [1.0, 2.0, 2.0]), (80, [5.0]), (10, [0.5, 9.0]), (10, [0.5, 9.0]), (11, [3.0, 1.0]), (11, [0.1, 1.0])]
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("x") for c in ("node", "u", "h", "v", "norm", "query", "ids", "score", "rank", "label")})
    same(found(df, F.col("vec_id") % 20 == 0), brute(rows, lambda i: i % 20 == 0))
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert found(df, F.col("vec_id") == 80) == {}


def test_a_third_of_copies_and_lengths_that_differ(spark):
    rng = np.random.default_rng(5)
    copy = rng.normal(size=8).tolist()
    rows = [(i, copy if i % 3 == 0 else (rng.normal(size=8) * rng.uniform(0.2, 5)).tolist()) for i in range(900)]
    same(found(spark.createDataFrame(rows, ROW), F.col("vec_id") % 20 == 0), brute(rows, lambda i: i % 20 == 0))


def test_recall_where_leaves_alone_do_not_suffice(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 24))
    x[:1500] = x[0] + 0.05 * x[:1500]  # one crowd of near copies
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    monkeypatch.setattr(neighbours, "LEAF", 256)
    df = spark.createDataFrame(rows, ROW).repartition(8)
    got, want = found(df, F.col("vec_id") % 50 == 0), brute(rows, lambda i: i % 50 == 0)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.97 and np.mean(hits[30:]) >= 0.95
    score = {q: x @ x[q] for q in got}
    assert all(abs(s - score[q][i]) < 1e-9 for q in got for i, s in got[q]) and all(a[1] >= b[1] for v in got.values() for a, b in zip(v, v[1:]))


def test_descent_improves_the_first_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    points = spark.createDataFrame([(i, bytearray(np.append(v, 0).astype(np.float16).tobytes())) for i, v in enumerate(x)], "node long, u binary")
    s = x @ x.T
    np.fill_diagonal(s, -9)
    truth = np.argsort(-s, axis=1)[:, :10]
    recall = lambda g: np.mean([len(set(r.ids[:10]) & set(truth[r.node].tolist())) / 10 for r in g.collect()])
    first, last = (recall(neighbours.nn_descent(points, rounds=k)) for k in (0, 4))
    assert last > 0.9 > first


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in queries.op12_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_queries_from_outside_start_from_seeds(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1200, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    half = lambda m, last: [bytearray(np.append(v, last).astype(np.float16).tobytes()) for v in m]
    points = spark.createDataFrame(list(enumerate(half(x, 0))), "node long, u binary")
    q = rng.normal(size=(30, 12))
    q /= np.linalg.norm(q, axis=1)[:, None]
    graph = neighbours.nn_descent(points)
    rows, table = neighbours.stored(graph)
    asked = spark.createDataFrame([(i, b, None) for i, b in enumerate(half(q, 0))], "query long, q binary, start long")
    seeds = points.orderBy(F.xxhash64("node")).limit(64)
    found = {r.query: set(r.ids[:10]) for r in neighbours.search(rows, asked, seeds).collect()}
    spark.sql(f"DROP TABLE {table}")
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(found[i] & set(truth[i].tolist())) / 10 for i in range(30)]) > 0.97
