"""N-gram Jaccard self-join of documents by MinHash banding, verified on full n-gram sets.

Words are runs of word characters of the lower-cased text; a text of fewer than `n` words, but not none, is one n-gram. Texts of
equal n-gram sets form a class, represented by its smallest id, so that copies are never paired with each other. Then:

1. signatures: band keys of each representative, bands and rows per band chosen for a target recall at the threshold;
2. buckets: representatives meet by band key, in blocks of a bounded size, and a spanning forest of the pairs whose signatures agree
   often enough is sent on. Banding and agreement are one filter: `least_agreement` gives the number that a pair at the threshold
   misses with a chance of `MISS`, a five-hundredth of what the bands may miss;
3. clusters: the forest's components; inside them every pair is verified on the full n-gram sets, again in blocks, each pair once.
   That is more than the pairs that share a band, and its work is the square of a cluster's representatives: a cluster of more than
   `WIDE` blocks is verified bucket by bucket instead, a pair in the first band that both share.

Links are counted in the tasks and never written as pairs; no link between different texts is dropped, whatever the group's size.

Edge cases: a null or empty text, or one without words, links with nothing; repeated rows of one id count as copies of each other; a
row without an id is kept, and counts as a copy only beside rows with one;
equal similarities need no tie rule, a group is named by its smallest id; an empty table gives no rows; other columns are ignored
unless named in `keep`, and may have any name but those of the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from usagelake.llm.common import block_pairs, connected_components, each_group, perhaps, forest, give_back, kept_in_worker, written

WORD = re.compile(r"\w+")
BLOCK = 256  # representatives in a block
BLOCK_WORDS = 2_000_000  # and about so many n-grams
WIDE = 64  # blocks of a cluster up to which all of its pairs are verified
MISS = 1e-6


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, so the fewest false candidates, that reach the recall at the threshold within max_hashes."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= max_hashes:
            return bands, rows
    return max_hashes, 1


def least_agreement(threshold: float, hashes: int, miss: float = MISS) -> int:
    """The most equal hashes of two signatures that can be asked for while a pair at the threshold falls short with a chance of at most `miss`."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > miss:
            return k
    return hashes


class WordHashes:
    """64-bit hashes of words, each computed once per worker; the table starts anew when it is full."""

    def __init__(self, max_words: int = 500_000):
        self.max_words, self.place, self.hash = max_words, {}, np.zeros(0, np.uint64)

    def __call__(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.place) > self.max_words:
            self.place, self.hash = {}, np.zeros(0, np.uint64)
        new = list(set().union(*docs).difference(self.place)) if docs else []
        if new:
            self.place.update(zip(new, range(len(self.hash), len(self.hash) + len(new))))
            self.hash = np.concatenate([self.hash, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])
        get = self.place.__getitem__
        return self.hash[np.fromiter((get(w) for d in docs for w in d), np.int64, sum(map(len, docs)))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams."""
    docs = [WORD.findall((t or "").lower()) for t in texts]
    h = kept_in_worker(("word_hashes",), WordHashes)(docs)
    factors = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = _mix(rolled)
    out, at = [], 0
    for d in docs:
        if len(d) >= n:
            out.append(np.unique(rolled[at : at + len(d) - n + 1]))
        elif d:
            out.append(_mix((h[at : at + len(d)] * factors[: len(d)]).sum(keepdims=True) + np.uint64(len(d))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(d)
    return out


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, bands*rows) uint32 minima and (n, bands) int64 band keys of sets that are not empty."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    sig = np.empty((len(sets), bands * rows), np.uint32)
    for k in range(bands * rows):
        sig[:, k] = np.minimum.reduceat((flat * mult[k]) >> np.uint64(32), starts).astype(np.uint32)
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = _mix(keys + sig[:, r::rows].astype(np.uint64) + np.uint64(r))
    return sig, _mix(keys + np.arange(bands, dtype=np.uint64)).astype(np.int64)


def _features(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_text").to_pylist()
            for a in range(0, len(texts), 400):
                sets = shingle_sets(texts[a : a + 400], n)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                key_of, sig_of = [None] * len(sets), [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full]
                    sig, keys = _signatures(some, bands, rows)
                    for i, s, g, k in zip(full.tolist(), some, sig, keys):
                        h1[i], h2[i] = np.array([s.sum(), _mix(s).sum()], np.uint64).astype(np.int64)
                        key_of[i], sig_of[i] = k, g.tobytes()
                part = b.slice(a, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size), pa.array(h1), pa.array(h2), pa.array(key_of, pa.list_(pa.int64())), pa.array(sig_of, pa.binary())], names=[*part.schema.names[:-1], "n", "h1", "h2", "bands", "sig"])
        give_back()

    return run


def _likely(threshold: float, hashes: int):
    """In one block pair of a bucket: a forest of the pairs whose signatures agree often enough."""
    least = least_agreement(threshold, hashes)

    def fn(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        ids, blk = t.column("rep").to_numpy(), t.column("blk").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        cross = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        left = np.flatnonzero(blk == t.column("bi")[0].as_py()) if cross else np.arange(len(ids))
        right = np.flatnonzero(blk == t.column("bj")[0].as_py()) if cross else np.arange(len(ids))
        src, dst = [], []
        for k, i in enumerate(left):
            other = right if cross else right[k + 1 :]
            if len(other):
                hit = other[(sig[other] == sig[i]).sum(1) >= least]
                src.append(np.full(len(hit), ids[i]))
                dst.append(ids[hit])
        if src:
            a, b = forest(np.concatenate(src), np.concatenate(dst))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    return fn


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right], as products of 0/1 matrices over slices of the n-grams."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(1, 12_000_000 // max(1, len(sets)))
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [a, a + width])
        m = np.zeros((len(sets), int(col[hi - 1]) - a + 1), np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1
        out += m[left] @ m[right].T
    return out


def _verify(threshold: float):
    """In one block pair of a cluster or a bucket: the links of each representative, counted in documents, and a forest of them. In
    bucket number `band` a pair that shares an earlier band is left to that band's bucket."""

    def fn(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, first = np.unique(t.column("rep").to_numpy(), return_index=True)
        if len(ids) < 2:
            return
        blk, weight = t.column("blk").to_numpy()[first], t.column("weight").to_numpy()[first]
        raw = t.column("grams").to_pylist()
        sets = [np.frombuffer(raw[i], np.uint64) for i in first]
        bi, bj = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
        left, right = (np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)) if bi != bj else (np.arange(len(ids)),) * 2
        if not len(left) or not len(right):
            return
        size = np.array([len(s) for s in sets], np.float64)
        both = overlaps(sets, left, right).astype(np.float64)
        link = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
        if bi == bj:
            np.fill_diagonal(link, False)
        band = t.column("band")[0].as_py() if "band" in t.column_names else 0
        if band:
            keys = np.array([t.column("bands")[i].as_py()[:band] for i in first])
            for k in range(band):
                link &= keys[left, k][:, None] != keys[right, k][None, :]
        n = np.zeros(len(ids), np.int64)
        n[left] += link @ weight[right]
        if bi != bj:
            n[right] += link.T @ weight[left]
        x, y = np.nonzero(link)
        a, b = forest(ids[left][x], ids[right][y])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], a]), pa.int64()), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)]), pa.int64()), pa.array([None] * len(some) + b.tolist(), pa.int64())], names=["rep", "n", "other"])

    return fn


def _with_grams(df: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """df(rep, ...) with grams: the n-gram sets of its representatives' texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for a in range(0, len(texts), 400):
                part = b.slice(a, 400)
                sets = [s.tobytes() for s in shingle_sets(texts[a : a + 400], n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=[*part.schema.names[:-1], "grams"])
        give_back()

    schema = StructType([*df.schema.fields, StructField("grams", BinaryType())])
    some = perhaps(docs.select("doc_id", "_text"), F.col("doc_id"), df.select("rep").distinct()).where("_maybe")  # other texts stay where they are
    return some.join(df, some.doc_id == df.rep).select(*df.columns, some._text).mapInArrow(run, schema)


def near_duplicates(documents: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, keep: list[str] = ()) -> DataFrame:
    """(doc_id, the columns `keep`, class_id, n_links, component_id, kept), one row per row of documents.

    class_id: the smallest id of equal n-gram sets; n_links: other documents of similarity >= threshold; component_id: the smallest
    id reachable by links; kept: whether the document is that one.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = documents.select(documents["doc_id"], F.struct(*(documents[c].alias(c) for c in keep)).alias("_kept") if keep else F.lit(None).cast("string").alias("_kept"), documents["text"].alias("_text"))
    shape = docs.drop("_text").schema.add("n", "long").add("h1", "long").add("h2", "long").add("bands", ArrayType(LongType())).add("sig", "binary")
    feats, _ = written(docs.mapInArrow(_features(n, bands, rows), shape), "jaccard-features")
    reps = feats.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).where("rep is not null")
    reps, _ = written(reps, "jaccard-classes")

    entry = reps.select("rep", F.explode("bands").alias("key"))
    shared = entry.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = entry.join(shared, "key")
    met = met.join(reps.select("rep", "sig"), "rep").withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = block_pairs(met, "rep", "nb").select("key", "bi", "bj", "blk", "rep", "sig")
    by = ["key", "bi", "bj"]
    likely = met.repartition(*by).sortWithinPartitions(*by).mapInArrow(each_group(by, _likely(threshold, bands * rows)), "src long, dst long")
    cluster = connected_components(likely, "jaccard-candidates")

    member = reps.select("rep", "weight", "n").join(cluster, F.col("rep") == F.col("node")).drop("node")
    total = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("nb"))
    member = member.join(total, "component").select("rep", "weight", "component", "nb")
    member, _ = written(member, "jaccard-members")

    def verified(some: DataFrame, group: list[str], *more: str) -> DataFrame:
        by = [*group, "bi", "bj"]
        pairs = block_pairs(_with_grams(some, docs, n), "rep", "nb").select(*by, "blk", "rep", "weight", *more, "grams")
        return pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(each_group(by, _verify(threshold)), "rep long, n long, other long")

    checked = verified(member.where(F.col("nb") <= WIDE), ["component"])
    wide = member.where(F.col("nb") > WIDE).select("rep", "weight")
    if wide.limit(1).count():
        entry = wide.join(reps.select("rep", "n", "bands"), "rep").select("*", F.posexplode("bands").alias("band", "key"))
        shared = entry.groupBy("band", "key").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("nb")).where("size > 1").drop("size")
        checked = checked.unionByName(verified(entry.join(shared, ["band", "key"]).drop("n"), ["band", "key"], "bands"))
    checked, _ = written(checked, "jaccard-links")
    found = connected_components(checked.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")), "jaccard-groups")
    links = checked.groupBy("rep").agg(F.sum("n").alias("links"))

    named = reps.select("h1", "h2", "rep", "weight").join(found, F.col("rep") == F.col("node"), "left").drop("node").join(links, "rep", "left")
    out = feats.select("doc_id", "_kept", "n", "h1", "h2").join(named, (feats.h1 == named.h1) & (feats.h2 == named.h2) & (feats.n > 0), "left")
    own = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", *(F.col("_kept")[c].alias(c) for c in keep), F.coalesce("rep", "doc_id").alias("class_id"), (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995) -> DataFrame:
    """The rows of documents less the extra ones: of each group of linked documents the row of the smallest id stays.

    Rows are told apart by id and text. Of rows that have both in common one stays, that of the smallest hash over its columns; rows of
    one id with different texts are different documents, and of those that are linked the one of the smallest key by id and text
    stays; rows without an id come after those with one. Texts without words are linked with nothing, but repeated rows of them go.
    """
    row = F.xxhash64("doc_id", "text")
    near = near_duplicates(documents.select(row.alias("doc_id"), "text", F.col("doc_id").alias("own")), threshold, n, recall, ["own"])
    near, _ = written(near.groupBy("doc_id", "component_id").agg(F.count("*").alias("rows"), F.first("own").alias("own")), "jaccard-rows")
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("f")).select("component_id", F.col("f.doc_id").alias("first"))
    gone, _ = written(near.join(first, "component_id").where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("_row")).distinct(), "jaccard-gone")
    again = near.where("rows > 1").select(F.col("doc_id").alias("_row"))
    d = documents.select(F.struct(*(documents[c].alias(c) for c in documents.columns)).alias("_whole"), row.alias("_row"))
    d = perhaps(d, F.col("_row"), gone)  # only rows that may be gone move to be looked up
    d = d.where("not _maybe").unionByName(d.where("_maybe").join(gone, "_row", "left_anti")).drop("_maybe")
    if again.limit(1).count():
        told = F.xxhash64(*(F.col("_whole")[c] for c, kind in documents.dtypes if not kind.startswith(("map", "variant"))))
        d = perhaps(d, F.col("_row"), again)
        some = d.where("_maybe").drop("_maybe")
        one = some.join(again, "_row", "left_semi").groupBy("_row").agg(F.min_by("_whole", told).alias("_whole"))
        d = d.where("not _maybe").drop("_maybe").unionByName(some.join(again, "_row", "left_anti")).unionByName(one.select("_whole", "_row"))
    return d.select(*(F.col("_whole")[c].alias(c) for c in documents.columns))
