"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries walk it greedily.

1. Points: equal vectors are one point, named by its smallest id, with its smallest ids kept for ties. A component is added that
   lifts all points to the length of the longest one, so that the largest inner product with a query is the smallest angle; the graph
   is built on these lifted points in half precision.
2. First lists: a few passes cut the points by random hyperplanes (thresholds are medians of a bounded sample) into leaves of some
   LEAF points, larger leaves by a hash, and compare each leaf's points with each other; each point keeps its DEGREE best.
3. Descent: each round joins the neighbours (and at most DEGREE sampled reverse neighbours) of a point with each other, all points at
   once: a point's neighbours learn of their neighbours' neighbours. Only pairs with an entry of the last round are compared, only
   scores above a point's worst entry are sent back. It ends when few entries are new.
4. Search: each query keeps its best `beam` points and expands all that it has not expanded, by a join with the graph, whose rows hold
   the neighbours' vectors beside their ids and are stored in buckets, so that only the queries' rows move; it ends when few of the
   beams' points are left to expand. A query starts from its own point or, if the graph has none, from the best of some seeds.
5. The best of each beam, all whose score in half precision may still be among the k best, are scored in double precision on the
   original vectors; copies are given back by their smallest ids.

Result lists are approximate (recall is measured against brute force in tests and README); every score is exact. Sampling reverse
neighbours and ending the descent change what is found, never what is indexed: every point is in the graph.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; repeated rows
of one id are one vector, the smallest; vectors of different lengths are not compared; fewer candidates than k give shorter lists;
ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import discard, give_back, written
from usagelake.session import shared_dir

DEGREE = 20
LEAF = 2048
PASSES = 5
ROUNDS = 4
FRESH = 0.05  # share of new entries below which the descent ends
OPEN = 0.02  # share of unexpanded beam entries below which the search ends
BEAM = 256
SEEDS = 512  # points that a query without one of its own is compared with first, and
ENTRIES = 16  # how many of them, the best, it starts from
SAMPLE = 20_000  # points that the hyperplanes' medians are taken from
LISTS = "ids array<long>, scores array<float>"


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 4000) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition sorted by key: some `most` rows each, more only where one group has more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            held.append(part)
            n += part.num_rows
            if n >= most:
                t = pa.Table.from_batches(held)
                k = t.column(key).to_numpy()
                cut = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] else 0
                if cut:
                    yield t.slice(0, cut)
                    rest = t.slice(cut).combine_chunks()
                    held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(np.float32)


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    col = t.column(name).combine_chunks()
    size = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), size)


def _lists(values: np.ndarray, upto: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values, kind))


def best_of(node: np.ndarray, other: np.ndarray, score: np.ndarray, flag: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best others of each node, each once (with its lowest flag), by falling score and rising id: nodes, offsets, places."""
    o = np.lexsort((-score, flag, other, node))
    first = np.ones(len(o), bool)
    first[1:] = (node[o][1:] != node[o][:-1]) | (other[o][1:] != other[o][:-1])
    o = o[first]
    o = o[np.lexsort((other[o], -score[o], node[o]))]
    names, start = np.unique(node[o], return_index=True)
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    o = o[rank < k]
    return names, np.append(np.searchsorted(node[o], names), len(o)), o


def _valid(vectors: list) -> list[bytes | None]:
    out: list[bytes | None] = []
    for v in vectors:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.array(v, np.float64)
        out.append(None if x is None or not np.isfinite(x).all() or not x.any() else x.tobytes())
    return out


def vectors_of(embeddings: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v, norm) of the rows that take part: v is the vector's doubles as bytes."""
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col("embedding").isNotNull()).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _valid(b.column("embedding").to_pylist())
            norm = [None if x is None else float(np.linalg.norm(np.frombuffer(x))) for x in v]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(v, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "v", "norm"])

    return rows.mapInArrow(run, "vec_id long, v binary, norm double").where("v is not null")


def lifted(raw: list[bytes], longest: float, query: bool = False) -> list[bytes]:
    """Vectors over the longest length, with the component that brings them to length one (0 for queries), in half precision."""
    out = []
    for x in raw:
        y = np.frombuffer(x) / longest
        if query:
            y = y / np.linalg.norm(y)
        rest = 0.0 if query else math.sqrt(max(0.0, 1 - float(y @ y)))
        out.append(np.append(y, rest).astype(np.float16).tobytes())
    return out


def _first_lists(points: DataFrame, n: int, degree: int) -> DataFrame:
    """(node, ids, scores) for every pass and point of more than one: its best in its leaf."""
    bits = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    sample = points.select("node", "u").orderBy(F.xxhash64("node")).limit(SAMPLE).toArrow().column("u").to_pylist() if bits else []
    by_len: dict[int, list[bytes]] = {}
    for u in sample:
        by_len.setdefault(len(u), []).append(u)
    planes = {size: np.random.default_rng([11, size]).normal(size=(size // 2, PASSES * bits)).astype(np.float32) for size in by_len}
    median = {size: np.median(_matrix(us) @ planes[size], axis=0) for size, us in by_len.items()}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("u").to_pylist()
            leaf = np.zeros((len(raw), PASSES), np.int64)
            by_len: dict[int, list[int]] = {}
            for i, u in enumerate(raw):
                by_len.setdefault(len(u), []).append(i)
            for size, at in by_len.items():
                if size in planes and bits:
                    side = (_matrix([raw[i] for i in at]) @ planes[size] > median[size]).reshape(len(at), PASSES, bits)
                    leaf[at] = side @ (1 << np.arange(bits, dtype=np.int64))
                leaf[at] = leaf[at] * 1009 + size
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(leaf.tolist(), pa.list_(pa.int64()))], names=["node", "leaf"])

    passes = 1 if not bits else PASSES
    keys = points.select("node", "u").mapInArrow(keyed, "node long, leaf array<long>").select("node", F.posexplode(F.slice("leaf", 1, passes)).alias("pass", "leaf"))
    keys, path = written(keys, "neighbour-leaves")
    size = keys.groupBy("pass", "leaf").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node", "pass"), F.ceil(F.col("size") / (1.5 * LEAF))).alias("part")
    met = keys.join(size, ["pass", "leaf"]).select("node", F.xxhash64("pass", "leaf", part).alias("block")).join(points.select("node", "u"), "node").select("block", "node", "u")
    met = met.repartition("block").sortWithinPartitions("block")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block", LEAF):
            block, node, raw = t.column("block").to_numpy(), t.column("node").to_numpy(), t.column("u").to_pylist()
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            for a, z in zip(cuts, np.append(cuts[1:], len(block))):
                if z - a < 2:
                    continue
                x, own = _matrix(raw[a:z]), node[a:z]
                k = min(degree, len(own) - 1)
                for at in range(0, len(own), 512):
                    s = x[at : at + 512] @ x.T
                    s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    upto = np.arange(len(s) + 1) * k
                    yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 512]), _lists(own[top].ravel(), upto, pa.int64()), _lists(np.take_along_axis(s, top, 1).ravel(), upto, pa.float32())], names=["node", "ids", "scores"])
        give_back()

    return met.mapInArrow(compared, f"node long, {LISTS}")


def _merged(graph: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """The graph with better entries from found (node, ids, scores); entries that were not in it are fresh."""
    none = F.lit(None)
    both = graph.select("node", "u", "ids", "scores", F.lit(False).alias("new")).unionByName(found.select("node", none.cast("binary").alias("u"), "ids", "scores", F.lit(True).alias("new")))
    met = both.repartition("node").sortWithinPartitions("node", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            other, row = _flat(t, "ids")
            score, _ = _flat(t, "scores")
            name = t.column("node").to_numpy()
            new = t.column("new").to_numpy()
            own = ~new
            names, upto, o = best_of(name[row], other, score, new[row].astype(np.int8), degree)
            # every point has one row of its own; those without any entry keep an empty list
            points, raw = name[own], t.column("u").take(pa.array(np.flatnonzero(own)))
            at = np.searchsorted(names, points)
            known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == points) if len(names) else np.zeros(len(points), bool)
            size = np.zeros(len(points), np.int64)
            size[known] = np.diff(upto)[at[known]]
            ends = np.concatenate([[0], np.cumsum(size)])
            yield pa.RecordBatch.from_arrays([pa.array(points), raw.combine_chunks(), _lists(other[o], ends, pa.int64()), _lists(score[o], ends, pa.float32()), _lists(new[row][o], ends, pa.bool_())], names=["node", "u", "ids", "scores", "fresh"])
        give_back()

    return met.mapInArrow(run, f"node long, u binary, {LISTS}, fresh array<boolean>")


def _members(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """(centre, member, fresh): of every point its neighbours and at most `degree` of the points whose neighbour it is, fresh ones first."""
    edge = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))
    order = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("node", F.lit(seed)))
    back = edge.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).select(F.col("other").alias("centre"), F.col("node").alias("member"), "fresh")
    return edge.select(F.col("node").alias("centre"), F.col("other").alias("member"), "fresh").unionByName(back)


def _descended(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """(node, ids, scores): what the members of each point learn of each other."""
    worst = F.when(F.size("scores") >= degree, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float"))
    point = graph.select(F.col("node").alias("member"), "u", worst.alias("worst"))
    met = _members(graph, degree, seed).join(point, "member").select("centre", "member", "fresh", "u", "worst").repartition("centre").sortWithinPartitions("centre", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "centre"):
            centre, member = t.column("centre").to_numpy(), t.column("member").to_numpy()
            fresh, worst = t.column("fresh").to_numpy(), t.column("worst").to_numpy()
            raw = t.column("u").to_pylist()
            again = np.zeros(len(member), bool)
            again[1:] = (centre[1:] == centre[:-1]) & (member[1:] == member[:-1])
            if again.any():
                where = np.cumsum(~again) - 1
                fresh = np.bincount(where, fresh) > 0
                keep = np.flatnonzero(~again)
                centre, member, worst, raw = centre[keep], member[keep], worst[keep], [raw[i] for i in keep.tolist()]
            lens = np.array([len(u) for u in raw])
            for size in np.unique(lens).tolist():
                own = np.flatnonzero(lens == size)
                group, rank = np.unique(centre[own], return_inverse=True)[1], np.zeros(len(own), np.int64)
                start = np.searchsorted(group, np.arange(group.max() + 1))
                rank = np.arange(len(own)) - start[group]
                shape = group.max() + 1, rank.max() + 1
                x = np.zeros((*shape, size // 2), np.float32)
                x[group, rank] = _matrix([raw[i] for i in own.tolist()])
                name, new, least = np.full(shape, -1), np.zeros(shape, bool), np.full(shape, np.inf, np.float32)
                name[group, rank], new[group, rank], least[group, rank] = member[own], fresh[own], worst[own]
                there = np.zeros(shape, bool)
                there[group, rank] = True
                s = x @ x.transpose(0, 2, 1)
                use = (s > least[:, :, None]) & there[:, None, :] & there[:, :, None] & (new[:, :, None] | new[:, None, :])
                use[:, np.arange(shape[1]), np.arange(shape[1])] = False
                g, i, j = np.nonzero(use)
                if len(g):
                    a, b, sc = name[g, i], name[g, j], s[g, i, j]
                    names, upto, o = best_of(a, b, sc, np.zeros(len(a), np.int8), degree)
                    yield pa.RecordBatch.from_arrays([pa.array(names), _lists(b[o], upto, pa.int64()), _lists(sc[o], upto, pa.float32())], names=["node", "ids", "scores"])
        give_back()

    return met.mapInArrow(run, f"node long, {LISTS}")


def nn_descent(points: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(node, u, ids, scores, fresh) from points (node, u): each point's `degree` nearest found, nearest first; written."""
    spark, n = points.sparkSession, points.count()
    empty = [F.array().cast(t).alias(c) for c, t in (("ids", "array<long>"), ("scores", "array<float>"))]
    graph, path = written(_merged(points.select("node", "u", *empty), _first_lists(points, n, degree), degree), "neighbour-graph")
    for k in range(rounds):
        fresh = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("ids"))).first()
        if not fresh[0] or fresh[0] < FRESH * fresh[1]:
            break
        graph, new_path = written(_merged(graph, _descended(graph, degree, k), degree), "neighbour-graph")
        discard(spark, path)
        path = new_path
    return graph


def stored(graph: DataFrame, degree: int = DEGREE) -> tuple[DataFrame, str]:
    """(node, ids, us): the graph with sampled reverse edges and the neighbours' vectors, in buckets by node in the shared folder, and
    the name of their table."""
    spark = graph.sparkSession
    edges = graph.withColumn("fresh", F.transform("ids", lambda _: F.lit(False)))
    met = _members(edges, degree, 99).select("centre", "member").distinct().join(graph.select(F.col("node").alias("member"), "u"), "member")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.select("centre", "member", "u").repartition(buckets, "centre").sortWithinPartitions("centre", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "centre"):
            centre, member, raw = t.column("centre").to_numpy(), t.column("member").to_numpy(), t.column("u").to_pylist()
            names, start = np.unique(centre, return_index=True)
            upto = np.append(start, len(centre))
            yield pa.RecordBatch.from_arrays([pa.array(names), _lists(member, upto, pa.int64()), pa.array([b"".join(raw[a:z]) for a, z in zip(upto[:-1], upto[1:])], pa.binary())], names=["node", "ids", "us"])
        give_back()

    name = f"neighbour_rows_{uuid.uuid4().hex}"
    fat = met.mapInArrow(run, "node long, ids array<long>, us binary")  # a task's rows are one bucket's already
    fat.write.bucketBy(buckets, "node").sortBy("node").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def search(rows: DataFrame, queries: DataFrame, seeds: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, ids, scores): the best `beam` points that each query of (query, q, start) finds by greedy search over stored rows."""
    spark = queries.sparkSession
    entry = seeds.toArrow()
    names, raw = entry.column("node").to_numpy(), entry.column("u").to_pylist()

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, scores = [], []
            for q, start in zip(b.column("q").to_pylist(), b.column("start").to_pylist()):
                if start is not None:  # only its own: what all queries shared would be a hot key of the join
                    ids.append([start])
                    scores.append([np.inf])
                    continue
                same = np.array([i for i, u in enumerate(raw) if len(u) == len(q)], np.int64)
                s = _matrix([raw[i] for i in same]) @ _matrix([q])[0] if len(same) else np.zeros(0, np.float32)
                best = np.argsort(-s, kind="stable")[:ENTRIES]
                ids.append(names[same[best]].tolist())
                scores.append(s[best].tolist())
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("q"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32())), pa.array([[False] * len(x) for x in ids], pa.list_(pa.bool_()))], names=["query", "q", "ids", "scores", "done"])

    kind = f"query long, q binary, {LISTS}, done array<boolean>"
    state, path = written(queries.mapInArrow(begun, kind), "neighbour-search")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                p = pa.Table.from_batches([b.slice(at, 500)])
                other, row = _flat(p, "ids")
                q, us = p.column("q").to_pylist(), p.column("us").to_pylist()
                score = np.full(len(other), -np.inf, np.float32)
                lens = np.array([len(x) for x in q])
                for size in np.unique(lens).tolist():
                    own = np.flatnonzero(lens == size)
                    of = np.repeat(np.arange(len(own)), np.bincount(row, minlength=len(q))[own])
                    x = np.frombuffer(b"".join(us[i] for i in own.tolist()), np.float16).reshape(-1, size // 2).astype(np.float32)
                    score[np.isin(row, own)] = np.einsum("ij,ij->i", x, _matrix([q[i] for i in own.tolist()])[of])
                keep = score > p.column("worst").to_numpy()[row]
                query = p.column("query").to_numpy()[row][keep]
                if len(query):
                    found, upto, o = best_of(query, other[keep], score[keep], np.zeros(len(query), np.int8), beam)
                    yield pa.RecordBatch.from_arrays([pa.array(found), _lists(other[keep][o], upto, pa.int64()), _lists(score[keep][o], upto, pa.float32())], names=["query", "ids", "scores"])
        give_back()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "query"):
            other, row = _flat(t, "ids")
            score, _ = _flat(t, "scores")
            done, _ = _flat(t, "done")
            name, old = t.column("query").to_numpy(), t.column("old").to_numpy()
            found, upto, o = best_of(name[row], other, score, 1 - done.astype(np.int8), beam + 1)
            q = t.column("q").take(pa.array(np.flatnonzero(old)))
            yield pa.RecordBatch.from_arrays([pa.array(found), q.combine_chunks(), _lists(other[o], upto, pa.int64()), _lists(score[o], upto, pa.float32()), _lists(done[o], upto, pa.bool_())], names=["query", "q", "ids", "scores", "done"])
        give_back()

    none = F.lit(None)
    while True:
        worst = F.when(F.size("scores") > beam, F.array_min("scores")).otherwise(F.lit(float("-inf")).cast("float"))
        front = state.select("query", "q", worst.alias("worst"), F.explode(F.arrays_zip("ids", "done")).alias("e")).where("not e.done").select("query", "q", "worst", F.col("e.ids").alias("node"))
        left, every = state.agg(F.sum(F.size(F.filter("done", lambda d: ~d))), F.sum(F.size("ids"))).first()
        if not left or left < OPEN * every:
            break
        met = front.join(rows.hint("merge"), "node").select("query", "q", "worst", "ids", "us")
        new = met.mapInArrow(scored, f"query long, {LISTS}")
        after = state.select("query", "q", "ids", "scores", F.transform("ids", lambda _: F.lit(True)).alias("done"), F.lit(True).alias("old"))
        both = after.unionByName(new.select("query", none.cast("binary").alias("q"), "ids", "scores", F.transform("ids", lambda _: F.lit(False)).alias("done"), F.lit(False).alias("old")))
        state, new_path = written(both.repartition("query").sortWithinPartitions("query").mapInArrow(kept, kind), "neighbour-search")
        discard(spark, path)
        path = new_path
    return state


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row that is a query its k nearest other rows by inner product, as found."""
    spark = embeddings.sparkSession
    units, _ = written(vectors_of(embeddings).withColumn("h", F.md5("v")), "neighbour-vectors")
    longest = units.agg(F.max("norm")).first()[0] or 1.0
    order = Window.partitionBy("h").orderBy("vec_id")
    member = units.select("h", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    same = member.groupBy("h").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    classes, _ = written(same.join(units.select("v", F.col("vec_id").alias("node")), "node"), "neighbour-classes")

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(lifted(b.column("v").to_pylist(), longest), pa.binary())], names=["node", "u"])

    def lift_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(lifted(b.column("v").to_pylist(), longest, True), pa.binary()), b.column("query")], names=["query", "q", "start"])

    points, _ = written(classes.select("node", "v").mapInArrow(lift, "node long, u binary"), "neighbour-points")
    graph = nn_descent(points, degree)
    rows, table = stored(graph, degree)
    asked, _ = written(units.where(is_query).select("vec_id", "h").join(classes.select("h", "node"), "h").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")), "neighbour-queries")
    wanted = asked.select("query").distinct().join(classes.select(F.col("node").alias("query"), "v"), "query").mapInArrow(lift_query, "query long, q binary, start long")
    beams = search(rows, wanted, points.orderBy(F.xxhash64("node", F.lit(1))).limit(SEEDS), beam)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    discard(spark, f"{shared_dir(spark)}/{table}")

    # half precision is wrong by some 2 ** -11 of the lengths' product, which is 1 here, a factor, and once more for the query
    at_k = F.element_at(F.sort_array("scores", asc=False), F.least(F.size("scores"), F.lit(k + 2)))
    close = beams.select("query", at_k.alias("least"), F.explode(F.arrays_zip("ids", "scores")).alias("e")).where("e.scores >= least - 0.003 or e.ids = query").select("query", F.col("e.ids").alias("node"))
    pair = close.join(classes.select("node", "v", "members"), "node").join(classes.select(F.col("node").alias("query"), F.col("v").alias("q")), "query").select("query", "v", "q", "members")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(b.column("v").to_pylist(), b.column("q").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("query"), pa.array(score, pa.float64()), b.column("members")], names=["query", "score", "members"])

    scored = pair.mapInArrow(exact, "query long, score double, members array<long>").select("query", "score", F.explode("members").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    own = asked.join(lists, "query").select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
