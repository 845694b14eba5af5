"""Token-id output: best-fit-decreasing packing into fixed rows of ids, with cumulative segment lengths and position resets.

A task gathers `group_rows` rows' worth of documents, splits overlong ones losslessly, sorts the pieces by falling length and puts
each into the open row of least remaining room that holds it. The rooms are the leaves of a segment tree over capacities, so that
search and update take log2(capacity) steps. Nothing is shuffled; memory is bounded by one group.

Edge cases: a null or empty text is a document of the end id alone; equal lengths keep their order of arrival; repeated rows are
packed like any others; an empty table gives no rows; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm.tokens import default_path, word_ids

SCHEMA = "row_id long, ids binary, n_tokens long, cu_seqlens array<long>, position_ids binary, doc_ids array<long>, doc_starts array<long>"


class Rooms:
    """A segment tree over remaining rooms 0..capacity: how many open rows have each, and the least room that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64).tolist()
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def least(self, need: int) -> int:
        """The least room >= need of an open row, or -1."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:  # the sibling on the right has one
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of places in lengths, by best fit decreasing."""
    rooms, rows = Rooms(capacity), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = rooms.least(n)
        if room < 0:
            row, room = len(rows), capacity
            rows.append([i])
        else:
            row = rooms.take(room)
            rows[row].append(i)
        if room > n:
            rooms.add(room - n, row)
    return rows


def matrices(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int | None = 2, pad_id: int = 0, group_rows: int = 1024, dtype: str = "<u2") -> DataFrame:
    """One row per packed sequence.

    ids and position_ids are `capacity` little-endian unsigned integers of `dtype` (padding: pad_id, position 0), of 16 bits as the
    vocabulary has fewer than 65,536 ids; an id that does not fit is an error. cu_seqlens are the cumulative segment lengths from 0
    to n_tokens; positions restart at each segment; doc_ids and doc_starts name the document of each segment and how many of its ids
    came before.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row_id = word_ids(path, end_id), TaskContext.get().partitionId() << 33
        docs, sizes, flat, n_held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row_id
            ids, size = np.concatenate(flat), np.concatenate(sizes)
            if len(ids) and max(int(ids.max()), capacity) > np.iinfo(dtype).max:
                raise ValueError(f"ids up to {ids.max()} do not fit into {dtype}")
            start_of = np.cumsum(size) - size
            n_pieces = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), n_pieces)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            begin = within * capacity
            length = np.minimum(capacity, size[owner] - begin)
            rows = best_fit(length, capacity)
            for a in range(0, len(rows), 256):
                part = rows[a : a + 256]
                m, pos = np.full((len(part), capacity), pad_id, dtype), np.zeros((len(part), capacity), dtype)
                cu, di, ds = [], [], []
                for r, row in enumerate(part):
                    edges = np.concatenate([[0], np.cumsum(length[row])])
                    for p, at in zip(row, edges[:-1]):
                        n, x = int(length[p]), int(start_of[owner[p]] + begin[p])
                        m[r, at : at + n] = ids[x : x + n]
                        pos[r, at : at + n] = np.arange(n)
                    cu.append(edges.tolist())
                    di.append([docs[owner[p]] for p in row])
                    ds.append(begin[row].tolist())
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row_id, row_id + len(part)), pa.int64()), pa.array([x.tobytes() for x in m], pa.binary()), pa.array([c[-1] for c in cu], pa.int64()), pa.array(cu, longs), pa.array([x.tobytes() for x in pos], pa.binary()), pa.array(di, longs), pa.array(ds, longs)],
                    names=["row_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "doc_starts"],
                )
                row_id += len(part)

        for b in batches:
            ids_of, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                ids, ends = words.ids(texts[a : a + 500])
                docs += ids_of[a : a + 500]
                sizes.append(np.diff(ends))
                flat.append(ids)
                n_held += len(ids)
                if n_held >= group_rows * capacity:
                    yield from flush()
                    docs, sizes, flat, n_held = [], [], [], 0
        if docs:
            yield from flush()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files of binary id rows: Spark's commit protocol makes a lost executor harmless."""
    rows.write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Back from written rows: (doc_id, start, ids) of every segment, for a loader or a round-trip test; width: bytes of an id."""
    df = spark.read.parquet(path)
    seg = F.posexplode("doc_ids").alias("k", "doc_id")
    cut = lambda k: F.element_at("cu_seqlens", F.col("k") + k)
    return df.select("*", seg).select("doc_id", F.element_at("doc_starts", F.col("k") + 1).alias("start"), F.expr(f"substring(ids, cast({width} * element_at(cu_seqlens, k + 1) + 1 as int), cast({width} * (element_at(cu_seqlens, k + 2) - element_at(cu_seqlens, k + 1)) as int))").alias("ids"), (cut(2) - cut(1)).alias("length"))
