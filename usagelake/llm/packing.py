"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Documents are packed where they are read: a task gathers about `group_windows` windows' worth of documents, cuts what is longer
than a window into full ones, and splits the rest into k near-equal windows. Each item starts as a partition of k sums; the two
partitions of largest imbalance are merged, the large sums of one onto the small sums of the other, until one is left. k starts at the
least count by volume and rises whenever a window exceeds the capacity. So that the sums come out near-equal, one document in some 50 is
cut into filler of `FILLER` ids, which levels the windows; all others stay whole. Windows are padded by what they lack, about a
hundredth on the whole.

Where so many windows would need more than `padding` of their ids as padding, as in the last and small group of a task, documents are
cut instead: what is over a whole number of windows, or over the capacity in one, goes to further sequences whose lengths are powers
of two, which need no padding. Nothing is shuffled and memory is bounded by one group.

Edge cases: a null or empty text is a document of the end id alone; repeated rows and equal lengths are packed like any others
(ties are broken by arrival); an empty table gives no pieces; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from usagelake.llm.tokens import default_path, word_ids

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


FILLER, FILLER_SHARE = 64, 50  # ids in a piece of filler, and the part of a group that is cut into it
SLACK = 32  # ids by which levelled windows differ from their mean as a rule


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Split items into k parts of near-equal sums: multiway Karmarkar-Karp. Parts hold places in sizes."""
    if k <= 1 or not len(sizes):
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = []
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s], np.int64), [[i]]))  # sums in falling order; the k - 1 that are 0 are left out
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sa, pa_ = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        if len(sa) + len(sb) <= k:  # nothing has to meet: large sums face the other's zeros
            sums, parts = np.concatenate([sa, sb]), pa_ + pb
        else:
            meet = len(sa) + len(sb) - k  # the smallest of a meet the smallest of b, in opposite order
            joined = sa[len(sa) - meet :] + sb[len(sb) - meet :][::-1]
            for x, y in zip(range(len(sa) - meet, len(sa)), range(len(sb) - 1, len(sb) - meet - 1, -1)):
                pa_[x] = pa_[x] + pb[y]
            sums = np.concatenate([sa[: len(sa) - meet], joined, sb[: len(sb) - meet]])
            parts = pa_ + pb[: len(sb) - meet]
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], [parts[j] for j in order]
        if len(sums) == k:  # only differences matter
            low = int(sums[-1])
            if low:
                sums = sums - low
        while len(sums) > 1 and sums[-1] == 0 and not parts[-1]:
            sums, parts = sums[:-1], parts[:-1]
        heapq.heappush(heap, (-(int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)), tick, sums, parts))
        tick += 1
    parts = heap[0][3]
    return parts + [[] for _ in range(k - len(parts))]


def windows_of(sizes: np.ndarray, capacity: int, most: float = math.inf) -> list[list[int]] | None:
    """Near-equal windows of at most capacity; their count starts at the least possible (where there is a `most`, at that for levelled
    windows) and rises while one is too full. None if it would have to exceed `most`."""
    k = max(1, -(-int(sizes.sum()) // max(1, capacity - (SLACK if most < math.inf else 0))))
    while k <= most:
        parts = differencing(sizes, k)
        if max((int(sizes[p].sum()) for p in parts if p), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1 + k // 200
    return None


def levelled(items: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Items (doc place, start, length) with the last ones, a share of all ids, cut into filler."""
    out, fill = list(items), sum(n for *_, n in items) // FILLER_SHARE
    small = []
    while fill > 0:
        d, at, n = out.pop()
        fill -= n
        small += [(d, at + a, min(FILLER, n - a)) for a in range(0, n, FILLER)]
    return out + small


def pack_group(doc_ids: list, ids: np.ndarray, ends: np.ndarray, capacity: int, first_seq: int, cut: bool, padding: float) -> tuple[list[tuple], int]:
    """Pieces (doc place, start, length, sequence, offset) of one group, and the next sequence number."""
    out, rest, seq = [], [], first_seq
    for d, n in enumerate(np.diff(ends).tolist()):
        at = 0
        while n - at >= capacity:
            out.append((d, at, capacity, seq, 0))
            seq += 1
            at += capacity
        if n > at:
            rest.append((d, at, n - at))
    items = levelled(rest) if cut else rest
    lens = np.array([n for *_, n in items], np.int64)
    parts = windows_of(lens, capacity, (1 + padding) * int(lens.sum()) / capacity if cut else math.inf) if rest else []
    spare: list[tuple[int, int, int]] = []
    if parts is None:  # what is over a whole number of windows is cut off, from the last documents on
        over = sum(n for *_, n in rest) % capacity
        while over:
            d, at, n = rest.pop()
            if n > over:
                rest.append((d, at, n - over))
                at, n = at + n - over, over
            spare.append((d, at, n))
            over -= n
        lens = np.array([n for *_, n in rest], np.int64)
        parts, items = differencing(lens, int(lens.sum()) // capacity) if rest else [], rest
    for part in parts:
        at = 0
        for i in part:
            d, begin, n = items[i]
            fits = min(n, capacity - at)
            if fits:
                out.append((d, begin, fits, seq, at))
            if n > fits:
                spare.append((d, begin + fits, n - fits))
            at += fits
        seq += 1
    total = sum(n for *_, n in spare)
    while total:  # sequences of 2^j ids, the largest first, need no padding
        size = min(capacity & -capacity, 1 << (total.bit_length() - 1))
        total -= size
        at = 0
        while at < size:
            d, begin, n = spare.pop()
            fits = min(n, size - at)
            out.append((d, begin, fits, seq, at))
            at += fits
            if n > fits:
                spare.append((d, begin + fits, n - fits))
        seq += 1
    return out, seq


def pack(documents: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int | None = 2, group_windows: int = 192, cut: bool = True, padding: float = 0.015) -> DataFrame:
    """One row per piece: its document, place there, ids (little-endian unsigned 32-bit) and place in its sequence.

    padding: the share of padding up to which the window count rises instead of documents being cut; cut=False never cuts a document
    that fits into a window.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seq = word_ids(path, end_id), TaskContext.get().partitionId() << 33
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held = 0

        def flush(parts: list) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            docs = [d for p in parts for d in p[0]]
            ids = np.concatenate([p[1] for p in parts])
            size = np.concatenate([np.diff(p[2]) for p in parts])
            ends = np.concatenate([[0], np.cumsum(size)])
            pieces, seq = pack_group(docs, ids, ends, capacity, seq, cut, padding)
            raw = ids.astype("<u4").tobytes()
            for a in range(0, len(pieces), 4096):
                part = pieces[a : a + 4096]
                at = [int(ends[d]) + s for d, s, *_ in part]
                cols = [[docs[p[0]] for p in part], [p[1] for p in part], [p[2] for p in part], [raw[4 * x : 4 * (x + p[2])] for x, p in zip(at, part)], [int(size[p[0]]) for p in part], [p[3] for p in part], [p[4] for p in part]]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for a in range(0, len(texts), 500):
                ids, ends = words.ids(texts[a : a + 500])
                held.append((docs[a : a + 500], ids, ends))
                n_held += len(ids)
                if n_held >= 2 * group_windows * capacity:  # one group goes, another stays for the end
                    n, k = 0, 0
                    while n < group_windows * capacity:
                        n += len(held[k][1])
                        k += 1
                    yield from flush(held[:k])
                    held, n_held = held[k:], n_held - n
        if held:
            yield from flush(held)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
