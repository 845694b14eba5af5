"""Alignment of two tokenizers over whole texts by an event sweep.

1. Map: both tokenizers encode a space and the text. A token's end is an event at a byte offset of the document; as a token's length
   follows from its id, a run of events of one side is its start and its ids. Runs of at most RUN events are the rows.
2. Runs of A and B are united, repartitioned by document, sorted by offset within partitions and streamed through a machine that
   keeps the open group of the document at hand: offsets where both sides end close a group, and each stretch between two ends next to
   each other, of whichever side, is one link of an A and a B token. The stream's documents are swept together, as arrays.
3. An id pair's count is the number of documents that hold it linked. Each task adds its documents' pairs up before they are shuffled by
   A id, whose pairs are bounded by the vocabulary of B; there the highest count of each A id is found.
4. Back to the documents: the counts of the most frequent pairs (at most HEAD, so some 16 MB) go to every task; the links of all other
   pairs are joined by pair, each in fewer documents than any of the head. Both ways give the same sums.

Whole texts are encoded by segments: a segment starts at a space that follows no space and precedes no white space. There A's
own pattern always starts a word, and B has no piece with a marker after another character, so no token of either crosses it; repeated
segments are encoded once per worker. Vocabulary files are read where they lie in each task.

Edge cases: texts that are null, empty, or whose tokens' bytes do not give back the space and the text (B reads U+2581 as a space) have
no tokens: zeros and an empty digest; strings of special tokens are plain text; repeated rows are documents of their own, told apart
by a row number that is written before it is used; ids may be null; very long texts pass in runs, and the machine holds one open group
and the distinct links of one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import give_back, kept_in_worker, written

RUN = 4096  # events of a row
HELD = 1_000_000  # tokens of one document from which on it is swept in parts
PAIRS = 2_000_000  # distinct pairs that a task adds up before it sends them on
HEAD = 1 << 20  # pairs whose counts go to every task
SEGMENT = re.compile("(?<! )(?= [^\\s\u180e])")
NONE = np.zeros(0, np.int64)
kept_in_module: dict[str, object] = {}


def byte_table() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + i) for i, b in enumerate(rest))]}


class Vocabularies:
    """Bytes of every token of both sides, and the ids of texts."""

    def __init__(self, a_path: str, b_path: str, max_segments: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_table()
        names = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(table[c] for c in name) if all(c in table for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if max(len(self.a_len), len(self.b_len)) > 1 << 16:
            raise ValueError("ids of more than 16 bits are not packed here")
        self.max_segments = max_segments
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]
        self.start, self.size = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.good = np.zeros(0, bool)

    def _learn(self, segments: list[str]) -> None:
        ids = [[e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)], self.b.encode([s[1:] for s in segments], num_threads=1)]
        n = [np.array([len(x) for x in side], np.int64) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.uint16, int(k.sum())) for side, k in zip(ids, n)]
        good = self._come_back(segments, ids, n, flat)
        self.place.update(zip(segments, range(len(self.good), len(self.good) + len(segments))))
        self.good = np.concatenate([self.good, good])
        for side in (0, 1):
            self.start[side] = np.concatenate([self.start[side], len(self.flat[side]) + np.cumsum(n[side]) - n[side]])
            self.size[side] = np.concatenate([self.size[side], n[side]])
            self.flat[side] = np.concatenate([self.flat[side], flat[side]])

    def _come_back(self, segments: list[str], ids: list, n: list[np.ndarray], flat: list[np.ndarray]) -> np.ndarray:
        """Which segments both sides' tokens give back: all, where all bytes together are equal and every segment has its length."""
        raw = [s.encode() for s in segments]
        size, whole = np.array([len(x) for x in raw], np.int64), b"".join(raw)
        for side, (table, length) in enumerate(((self.a_bytes, self.a_len), (self.b_bytes, self.b_len))):
            upto = np.concatenate([[0], np.cumsum(length[flat[side]])])[np.concatenate([[0], np.cumsum(n[side])])]
            if (np.diff(upto) != size).any() or b"".join(map(table.__getitem__, flat[side].tolist())) != whole:
                return np.array([b"".join(map(self.a_bytes.__getitem__, x)) == b"".join(map(self.b_bytes.__getitem__, y)) == s for x, y, s in zip(*ids, raw)])
        return np.ones(len(segments), bool)

    def ids(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For both sides the flat ids and the offsets of each text, and which texts come back from their tokens."""
        if len(self.place) > self.max_segments:
            self._reset()
        segments = [SEGMENT.split(f" {t}") if t else [] for t in texts]
        segments = [s[1:] if s and not s[0] else s for s in segments]
        new = set().union(*segments).difference(self.place)
        if new:
            self._learn(list(new))
        n = np.array([len(s) for s in segments], np.int64)
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(segments)), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])
        good = n > 0
        good[np.searchsorted(ends, np.flatnonzero(~self.good[place]), "right") - 1] = False
        out = []
        for side in (0, 1):
            size = self.size[side][place]
            total = np.concatenate([[0], np.cumsum(size)])
            out.append((self.flat[side][np.repeat(self.start[side][place] - total[:-1], size) + np.arange(total[-1])], total[ends]))
        return out, good


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")


def packed(ids: np.ndarray) -> bytes:
    """16-bit ids, low bytes before high ones, compressed."""
    return _zip().compress(ids.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip().decompress(blob), np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _zip() -> zstandard.ZstdCompressor:
    return kept_in_module.setdefault("zip", zstandard.ZstdCompressor(level=1))


def _unzip() -> zstandard.ZstdDecompressor:
    return kept_in_module.setdefault("unzip", zstandard.ZstdDecompressor())


def events(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(row, doc_id, start, side, n, ids): runs of token ends, of A (side 0) and B (1); a document without tokens has one empty run."""
    a_path, b_path = _paths(a_path, b_path)
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", documents["text"].cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept_in_worker(("alignment", a_path, b_path), lambda: Vocabularies(a_path, b_path))
        lens = (v.a_len, v.b_len)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat, good = v.ids(part.column("text").to_pylist())
                whose, start, side_of, size, blobs = [], [], [], [], []
                for i in range(part.num_rows):
                    if not good[i]:
                        whose.append(i), start.append(0), side_of.append(0), size.append(0), blobs.append(b"")
                        continue
                    for side in (0, 1):
                        own = flat[side][0][flat[side][1][i] : flat[side][1][i + 1]]
                        upto = 0
                        for k in range(0, len(own), RUN):
                            run_ = own[k : k + RUN]
                            whose.append(i), start.append(upto), side_of.append(side), size.append(len(run_)), blobs.append(packed(run_))
                            upto += int(lens[side][run_].sum())
                take = pa.array(whose, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row").take(take), part.column("doc_id").take(take), pa.array(start, pa.int64()), pa.array(side_of, pa.int8()), pa.array(size, pa.int32()), pa.array(blobs, pa.binary())], names=["row", "doc_id", "start", "side", "n", "ids"])
        give_back()

    return rows.mapInArrow(run, f"row long, doc_id {kind}, start long, side byte, n int, ids binary")


class Sweep:
    """The machine: `feed` takes runs in order and gives finished documents; `finish` the last one."""

    def __init__(self, a_len: np.ndarray, b_len: np.ndarray):
        self.len = (a_len, b_len)
        self.text = [[f"{i}{sep}" for sep in ",|;" for i in range(len(x))] for x in (a_len, b_len)]
        self.row, self.doc, self.held, self.n_held = None, None, ([], []), 0
        self.part: dict | None = None  # what the document at hand gave so far, where it passes in parts

    def feed(self, rows: list[int], docs: list, side: list[int], runs: list[np.ndarray]) -> list[dict]:
        done: list[tuple] = []
        out: list[dict] = []
        for r, d, s, ids in zip(rows, docs, side, runs):
            if r != self.row and self.row is not None:
                done.append(self._close())
            self.row, self.doc = r, d
            self.held[s].append(ids)
            self.n_held += len(ids)
            if self.n_held > HELD:
                out += self.sweep(done)
                done = []
                self._pass()
        return out + self.sweep(done)

    def finish(self) -> list[dict]:
        return self.sweep([self._close()]) if self.row is not None else []

    def _close(self) -> tuple:
        whole = self.row, self.doc, *self._joined(), self.part
        self.held, self.n_held, self.part = ([], []), 0, None
        return whole

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint16) for x in self.held)
        return a, b

    def _pass(self) -> None:
        """Sweep the document at hand up to its last closed group but one, so that a group is left for its end."""
        a, b = self._joined()
        ends = np.cumsum(self.len[0][a]), np.cumsum(self.len[1][b])
        both = ends[0][_among(ends[0], ends[1])]
        i, j = (int(np.searchsorted(e, both[-2])) + 1 for e in ends) if len(both) > 1 else (0, 0)
        if i:
            self.part = self.sweep([(self.row, self.doc, a[:i], b[:j], self.part)], final=False)[0]
        self.held, self.n_held = ([a[i:]], [b[j:]]), len(a) - i + len(b) - j

    def sweep(self, docs: list[tuple], final: bool = True) -> list[dict]:
        """The documents of whole (or closed parts of) token sequences, swept at once: offsets of one follow those of the one before."""
        if not docs:
            return []
        n = [np.array([len(d[2 + s]) for d in docs], np.int64) for s in (0, 1)]
        ids = [np.concatenate([d[2 + s] for d in docs]).astype(np.int64) for s in (0, 1)]
        ends = [np.cumsum(self.len[s][ids[s]]) for s in (0, 1)]
        closes = [_among(ends[0], ends[1]), _among(ends[1], ends[0])]
        group = [np.cumsum(c) - c for c in closes]  # of each token: how many groups closed before it
        n_groups = int(closes[0].sum())
        cut = np.concatenate(ends)
        cut.sort(kind="stable")  # a merge, as both are in order
        cut = cut[np.append(cut[1:] != cut[:-1], np.ones(min(1, len(cut)), bool))]
        link_a, link_b = np.searchsorted(ends[0], cut), np.searchsorted(ends[1], cut)
        last_a, last_b = np.cumsum(n[0]), np.cumsum(n[1])
        of = np.searchsorted(last_a, link_a, "right")  # the document of a link
        pair = ids[0][link_a] << 16 | ids[1][link_b]
        key = of << 33 | pair
        key.sort()
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        pairs, times = key[at] & (1 << 33) - 1, np.diff(at, append=len(key))
        upto = np.searchsorted(key[at] >> 33, np.arange(len(docs) + 1))
        links = np.bincount(of, minlength=len(docs))
        # the order of the digest: of each group first its A ids, then its B ids
        size_a, size_b = np.bincount(group[0], minlength=n_groups), np.bincount(group[1], minlength=n_groups)
        before_a, before_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        code = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        code[np.arange(len(ids[0])) + before_b[group[0]]] = ids[0] + len(self.len[0]) * closes[0]
        code[np.arange(len(ids[1])) + (before_a + size_a)[group[1]]] = len(self.text[0]) + ids[1] + 2 * len(self.len[1]) * closes[1]
        words = self.text[0] + self.text[1] if not hasattr(self, "words") else self.words
        self.words = words
        end = last_a + last_b
        groups_upto = np.concatenate([[0], np.cumsum(closes[0])])[last_a]
        out = []
        for k, (row, doc, a, b, part) in enumerate(docs):
            part = part or {"row": row, "doc_id": doc, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": None, "pairs": NONE, "times": NONE}
            own_pairs, own_times = pairs[upto[k] : upto[k + 1]], times[upto[k] : upto[k + 1]]
            if len(part["pairs"]):
                own_pairs, where = np.unique(np.concatenate([part["pairs"], own_pairs]), return_inverse=True)
                own_times = np.bincount(where, np.concatenate([part["times"], own_times])).astype(np.int64)
            sha = part["sha"]
            if len(a):
                said = "".join(map(words.__getitem__, code[end[k] - len(a) - len(b) : end[k]].tolist()))
                sha = sha or hashlib.sha256()
                sha.update((said[:-1] if final else said).encode())
            closed = int(groups_upto[k] - (groups_upto[k - 1] if k else 0))
            out.append({"row": row, "doc_id": doc, "n_a": part["n_a"] + len(a), "n_b": part["n_b"] + len(b), "n_groups": part["n_groups"] + closed, "n_links": part["n_links"] + int(links[k]), "sha": sha, "pairs": own_pairs, "times": own_times})
        return out


def _among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both in order."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _sum(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return NONE, NONE
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(where, np.concatenate(values), len(k)).astype(np.int64)


def packed_pairs(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs as differences and their times, byte planes apart, compressed."""
    step = np.diff(pairs, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    small = np.minimum(times, 255).astype(np.uint8).tobytes()
    return _zip().compress(step + small + times[times >= 255].astype("<i8").tobytes())


def unpacked_pairs(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _unzip().decompress(blob)
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()
    times = np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64)
    times[times == 255] = np.frombuffer(raw, "<i8", -1, 5 * n) if (times == 255).any() else 0
    return np.cumsum(step, dtype=np.int64), times


_SWEPT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary, bucket int, counts binary, n_counts int"


def sweep(runs: DataFrame, a_path: str | None = None, b_path: str | None = None, buckets: int = 64) -> DataFrame:
    """Rows of documents (bucket null): token, group and link numbers, digest, distinct pairs and how often each is linked; and rows of
    pair counts (bucket not null) of a task's documents, dealt by A id."""
    a_path, b_path = _paths(a_path, b_path)
    kind = runs.schema["doc_id"].dataType.simpleString()
    met = runs.repartition("row").sortWithinPartitions("row", "start", "side")
    schema = f"row long, doc_id {kind}, {_SWEPT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept_in_worker(("alignment", a_path, b_path), lambda: Vocabularies(a_path, b_path))
        machine = Sweep(v.a_len, v.b_len)
        keys, counts, n_keys, id_type = [], [], 0, pa.null()

        def given(done: list[dict]) -> Iterator[pa.RecordBatch]:
            nonlocal n_keys
            if not done:
                return
            some = [d["pairs"] for d in done if len(d["pairs"])]
            if some:
                k, c = np.unique(np.concatenate(some), return_counts=True)
                keys.append(k), counts.append(c)
                n_keys += len(k)
            cols = [[d["row"] for d in done], [d["doc_id"] for d in done], *([d[c] for d in done] for c in ("n_a", "n_b", "n_groups", "n_links")), [d["sha"].hexdigest() if d["sha"] else "" for d in done], [len(d["pairs"]) for d in done], [packed_pairs(d["pairs"], d["times"]) for d in done]]
            none = [None] * len(done)
            yield _batch([*cols, none, none, none], schema_names, id_type)

        def summed() -> Iterator[pa.RecordBatch]:
            nonlocal n_keys
            k, c = _sum(keys, counts)
            keys.clear(), counts.clear()
            n_keys = 0
            bucket = (k >> 16) % buckets
            for i in np.unique(bucket).tolist():
                own = bucket == i
                none = [None]
                yield _batch([none] * 9 + [[i], [packed_pairs(k[own], c[own])], [int(own.sum())]], schema_names, id_type)

        schema_names = ["row", "doc_id", *re.findall(r"(\w+) \w+", _SWEPT)]
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                ids = [unpacked(x) if x else np.zeros(0, np.uint16) for x in p.column("ids").to_pylist()]
                yield from given(machine.feed(p.column("row").to_pylist(), p.column("doc_id").to_pylist(), p.column("side").to_pylist(), ids))
                if n_keys > 2 * PAIRS:
                    k, c = _sum(keys, counts)
                    keys[:], counts[:] = [k], [c]
                    n_keys = len(k)
                    if n_keys > PAIRS:
                        yield from summed()
        yield from given(machine.finish())
        yield from summed()
        give_back()

    return met.mapInArrow(run, schema)


def _batch(cols: list, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    i64, i32 = pa.int64(), pa.int32()
    kinds = [i64, id_type, i64, i64, i64, i64, pa.string(), i32, pa.binary(), i32, pa.binary(), i32]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, n, best): the documents that hold a pair (A id * 65536 + B id), and whether no pair of its A id has more."""
    rows = swept.where("bucket is not null").select("bucket", "counts", "n_counts").repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, counts, n = None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            k, c = _sum(keys, counts)
            if len(k):
                _, where = np.unique(k >> 16, return_inverse=True)
                most = np.zeros(where.max() + 1, np.int64)
                np.maximum.at(most, where, c)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(c == most[where])], names=["pair", "n", "best"])
            keys.clear(), counts.clear()

        for b in batches:
            for own, blob, size in zip(*(c.to_pylist() for c in b.columns)):
                if own != bucket:
                    yield from done()
                    bucket, n = own, 0
                k, c = unpacked_pairs(blob, size)
                keys.append(k), counts.append(c)
                n += size
                if n > 2 * PAIRS:
                    k, c = _sum(keys, counts)
                    keys[:], counts[:], n = [k], [c], 0
        yield from done()
        give_back()

    return rows.mapInArrow(run, "pair long, n long, best boolean")


def align(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of documents."""
    spark = documents.sparkSession
    buckets = 4 * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    swept, _ = written(sweep(events(documents, a_path, b_path), a_path, b_path, buckets), "alignment-links")
    counts, _ = written(pair_counts(swept), "alignment-counts")
    least = _least_of_head(counts, head)
    top = counts.where(F.col("n") >= least).toArrow() if least is not None else None
    order = np.argsort(top.column("pair").to_numpy()) if top is not None else NONE
    frequent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")) if top is not None else (NONE, NONE, np.zeros(0, bool)))
    kind = documents.schema["doc_id"].dataType.simpleString()
    out_names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rare", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = frequent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                size = p.column("n_pairs").to_numpy()
                own = [unpacked_pairs(x, k) for x, k in zip(p.column("pairs").to_pylist(), size.tolist())]
                keys, times = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
                of = np.repeat(np.arange(p.num_rows), size)
                spot = np.searchsorted(pair, keys)
                known = np.zeros(len(keys), bool)
                inside = spot < len(pair)
                known[inside] = pair[spot[inside]] == keys[inside]
                spot = spot[known]
                total, good = np.zeros(p.num_rows, np.int64), np.zeros(p.num_rows, np.int64)
                np.add.at(total, of[known], n[spot] * times[known])
                np.add.at(good, of[known], best[spot] * times[known])
                left = np.concatenate([[0], np.cumsum(np.bincount(of[~known], minlength=p.num_rows))])
                rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known])) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in out_names[:7]), pa.array(good), pa.array(total), *rest], names=out_names)
        give_back()

    rows = swept.where("bucket is null").select(*out_names[:7], "n_pairs", "pairs")
    looked, _ = written(rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<long>, times array<long>"), "alignment-sums")
    rare = looked.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    tail = counts if least is None else counts.where(F.col("n") < least)
    more = rare.join(tail.hint("merge"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = looked.select("row", F.struct(*own).alias("own"), "n_best", "count_sum").unionByName(more.select("row", F.lit(None).cast(looked.select(F.struct(*own).alias("o")).schema["o"].dataType).alias("own"), "n_best", "count_sum"))
    summed = both.groupBy("row").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return summed.select("own.doc_id", "own.n_a", "own.n_b", "own.n_groups", "own.n_links", "n_best", "count_sum", "own.groups_sha256")


def _least_of_head(counts: DataFrame, head: int) -> int | None:
    """The least count whose pairs, with all of higher counts, are at most `head`; none if even the highest has more. Counts are looked at
    by powers of 2 ** (1 / 8), so the driver gets some hundred cells."""
    cell = F.floor(F.log2("n") * 8)
    cells = counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("cell")).collect()
    least, so_far = None, 0
    for c in cells:
        so_far += c.pairs
        if so_far > head:
            break
        least = c.least
    return least
