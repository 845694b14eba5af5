"""Near-duplicate embeddings by Euclidean p-stable hashing, checked by exact cosine.

Vectors are normalised in double precision; equal ones of a label form a class, represented by its smallest id, so that copies are
never paired with each other. Then:

1. buckets: hash tables of k quantised random projections bucket the representatives per label; k grows with the logarithm of the
   largest label's rows, so that buckets of unlike vectors stay small, and the tables' number follows from k and the wanted recall;
2. links: inside a bucket, in blocks of a bounded size, a search from vector to vector finds a spanning forest of the exact links. It
   compares a vector only with those not reached yet, so a bucket of alike vectors takes little more than one comparison each;
3. counts: inside each component of linked vectors every pair is checked by cosine exactly once, in blocks, and links are counted in
   vectors. All pairs of a component are looked at, so this finds links that no table brought together, too.

Link counts and forests leave a task, never pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do those whose label
is null; vectors of different lengths never link; repeated rows of one id are one vector, that of the
smallest label and then the smallest vector, nulls last; vectors without an id link with nothing, have no component, neither true nor
false as kept, and keep a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import block_pairs, connected_components, each_group, written

BLOCK = 512
FAR = 1.0  # the distance (cosine 0.5) at which vectors count as unlike


def collision(distance: float, width: float) -> float:
    """Chance that one projection puts two points of this distance into the same cell."""
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(threshold: float, width: float, k: int, recall: float) -> int:
    p = collision(math.sqrt(2 - 2 * threshold), width) ** k
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def projections_for(rows: int, width: float, least: int = 12, base: int = 10_000) -> int:
    """Projections of a table: `least` up to `base` rows of a label, then as many more as keep the unlike vectors that a vector meets few."""
    return least + max(0, math.ceil(math.log(max(1, rows) / base) / -math.log(collision(FAR, width))))


class PStable:
    """The same projections in every task: they follow from the seed and the vectors' length."""

    def __init__(self, k: int, tables: int, width: float, seed: int = 5):
        self.k, self.tables, self.width, self.seed, self._made = k, tables, width, seed, {}

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(n, tables) int64 bucket keys of the rows of x."""
        if x.shape[1] not in self._made:
            rng = np.random.default_rng([self.seed, x.shape[1]])
            self._made[x.shape[1]] = rng.normal(size=(x.shape[1], self.tables * self.k)), rng.uniform(0, self.width, self.tables * self.k), rng.integers(1, 2**62, (self.tables, self.k), dtype=np.int64) | 1
        a, b, mult = self._made[x.shape[1]]
        cell = np.floor((x @ a + b) / self.width).astype(np.int64).reshape(len(x), self.tables, self.k)
        return (cell * mult).sum(2) * 31 + np.arange(self.tables) + 1_000_003 * x.shape[1]


def _normal(vectors: list, n: int) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        if v is None or not len(v) or any(c is None for c in v):
            out.append(None)
            continue
        x = np.array(v, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt((x * x).sum()))
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of normalised vectors from their bytes; those of another length than the first are zero."""
    raw = column.to_pylist()
    size = len(raw[0])
    return np.frombuffer(b"".join(r if len(r) == size else bytes(size) for r in raw), np.float64).reshape(len(raw), -1)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the two blocks that meet in a group, and whether they are one."""
    blk, bi, bj = t.column("blk").to_numpy(), t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
    return np.flatnonzero(blk == bi), np.flatnonzero(blk == bj), bi == bj


def linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between left and right (the same places, or no common one): a search that compares each
    vector, once reached, with those of the other side that are not reached yet."""
    src, dst, same = [], [], left is right
    reached, rest = np.zeros(len(x), bool), [left] if same else [left, right]  # rest: who of a side is not reached yet
    for seed in left.tolist():  # a link has an end on the left
        if reached[seed]:
            continue
        rest[0] = rest[0][rest[0] != seed]
        queue = [(seed, 0)]
        while queue:
            i, side = queue.pop()
            other = side if same else 1 - side
            hit = x[rest[other]] @ x[i] >= threshold
            near = rest[other][hit]
            if len(near):
                rest[other], reached[near] = rest[other][~hit], True
                src.append(np.full(len(near), i))
                dst.append(near)
                queue += [(j, other) for j in near.tolist()]
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.98, width: float = 1.2, recall: float = 0.9995) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vec_id and per row without one: links are other vectors of the same label and cosine >= threshold."""
    first = F.min(F.struct(F.col("label").isNull().alias("no_label"), "label", F.col("embedding").isNull().alias("no_vector"), "embedding"))
    rows = embeddings.where("vec_id is not null").groupBy("vec_id").agg(first.alias("f")).select("vec_id", "f.label", "f.embedding")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = [None if v is None else v.tobytes() for v in _normal(b.column("embedding").to_pylist(), b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(unit, pa.binary())], names=["vec_id", "label", "v"])

    units, _ = written(rows.mapInArrow(normal, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary").withColumn("h", F.when(F.col("label").isNotNull(), F.md5("v"))), "embed-units")
    same = units.where("h is not null").groupBy("label", "h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    same, _ = written(same, "embed-classes")
    most = same.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k = projections_for(most, width)
    lsh = PStable(k, tables_for(threshold, width, k, recall), width)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("v").to_pylist()
            keys: list = [None] * len(raw)
            by_len: dict[int, list[int]] = {}
            for i, v in enumerate(raw):
                by_len.setdefault(len(v), []).append(i)
            for size, at in by_len.items():
                x = np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(len(at), size // 8)
                for i, key in zip(at, lsh.keys(x)):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "label", "keys"])

    vectors = units.select(F.col("vec_id").alias("rep"), "v")
    entry = same.select("rep", "label").join(vectors, "rep").mapInArrow(hashed, f"rep {kinds['vec_id']}, label {kinds['label']}, keys array<long>").select("rep", "label", F.explode("keys").alias("key"))
    entry, _ = written(entry, "embed-keys")
    shared = entry.groupBy("label", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = entry.join(shared, ["label", "key"]).withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).join(vectors, "rep")
    by = ["label", "key", "bi", "bj"]
    met = block_pairs(met, "rep", "nb").select(*by, "blk", "rep", "v").repartition(*by).sortWithinPartitions(*by)

    def reached(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, one = _sides(t)
        if t.num_rows < 2 or not len(left) or not len(right):
            return
        ids = t.column("rep").to_numpy()
        left = left[np.argsort(ids[left])]  # from the smallest id on, so that all tables find the same edges of a group
        a, b = linked(_matrix(t.column("v")), left, left if one else right, threshold)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["src", "dst"])

    group = connected_components(met.mapInArrow(each_group(by, reached), f"src {kinds['vec_id']}, dst {kinds['vec_id']}"), "embed-groups")
    group, _ = written(group, "embed-components")

    size = group.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    member = same.select("rep", "weight").join(group.join(size, "component"), F.col("rep") == F.col("node")).join(vectors, "rep")
    by = ["component", "bi", "bj"]
    member = block_pairs(member, "rep", "nb").select(*by, "blk", "rep", "weight", "v").repartition(*by).sortWithinPartitions(*by)

    def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, one = _sides(t)
        if t.num_rows < 2 or not len(left) or not len(right):
            return
        x, weight, n = _matrix(t.column("v")), t.column("weight").to_numpy(), np.zeros(t.num_rows, np.int64)
        link = x[left] @ x[right].T >= threshold
        if one:
            np.fill_diagonal(link, False)
        n[left] += link @ weight[right]
        if not one:
            n[right] += link.T @ weight[left]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([t.column("rep").combine_chunks().take(pa.array(some)), pa.array(n[some], pa.int64())], names=["rep", "n"])

    links = member.mapInArrow(each_group(by, counted), f"rep {kinds['vec_id']}, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    named = same.select("label", "h", "rep", "weight").join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left").drop("node")
    out = units.select("vec_id", "label", "h").join(named, ["label", "h"], "left")
    own = F.coalesce("component", "rep", "vec_id")
    out = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"), own.alias("component_id"), (F.col("vec_id") == own).alias("kept"))
    alone = embeddings.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("boolean").alias("kept"))
    return out.unionByName(alone)
