"""Benchmark decontamination with a stored positional inverted index, in DataFrame operations only.

`build_index` writes the postings (term, document, position) of all training tokens as segments, one per task, so that no posting is
shuffled. Terms are kept as 32-bit hashes, and a lookup reads their column alone to find the postings of its terms. A stored index
serves any benchmark: term frequencies and posting lists are read from it, not from the texts. An index that is kept under a path of
its own has its segments sorted by term.

Every window of `n` consecutive item words is represented by its two terms that are rarest in the corpus; their posting lists, adjusted
by the terms' offsets in the item, are intersected to alignments (document, item, shift), and each alignment is compared word by word.
A window that occurs always has both of its rarest terms at one shift, so nothing is missed; equal hashes of different terms only add
alignments. Proximity matches need most of an item's rare terms within a few words of one alignment.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. Index terms are lower-cased wholly,
which can only add alignments; the comparison uses the exact words.

Edge cases: a null or empty text has no words and no hits; items without words are skipped, items of fewer than n words are one
window; repeated document rows, rows without an id and rows that share one are judged one by one, items of one id count once; an item
or a document may repeat words at will; empty tables give no hits or no rows; other columns may have any name but those of the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.common import perhaps, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NEAR_WORDS, NEAR_SHARE = 5, 0.8  # proximity: words off one alignment, and the share of an item's rare terms that must stand there
BROADCAST_TERMS = 200_000  # benchmark terms or items up to which a lookup side is broadcast: at most some 10 MB


def _no_words() -> Column:
    return F.array().cast("array<string>")


def raw_words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, SEPARATORS), ""), _no_words())


def words(text: Column) -> Column:
    return raw_words(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are counted to be few; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """(ik, item_id, words, n_item): distinct items with words."""
    it = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    return it.select(F.xxhash64("item_id", "words").alias("ik"), "item_id", "words", F.size("words").alias("n_item"))


def _term(word: Column) -> Column:
    return F.hash(F.lower(word))


def _document(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The key of a document row: rows of one id and different texts, or of no id, are different documents."""
    return F.xxhash64(doc_id, text)


def build_index(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(h, dk, at): the postings of all words of doc_id and text, stored at `path`, or in the shared folder. With a path that holds an
    index already, that one is read."""
    spark = documents.sparkSession
    words_at = documents.select(_document().alias("dk"), F.posexplode(raw_words(F.col("text"))).alias("at", "word"))
    index = words_at.select(_term(F.col("word")).alias("h"), "dk", "at")
    if path is None:
        return written(index, "decontam-index")[0]
    index.sortWithinPartitions("h").write.mode("ignore").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def anchors(index: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(ik, pos, h, need): per window of an item, the places of its two rarest terms; need: how many must align."""
    place = items.select("ik", "n_item", F.posexplode("words").alias("pos", "word")).select("ik", "n_item", "pos", _term(F.col("word")).alias("h"))
    vocabulary = place.select("h").distinct()
    if vocabulary.count() <= BROADCAST_TERMS:
        freq = index.join(F.broadcast(vocabulary), "h", "left_semi").groupBy("h").agg(F.count("*").alias("freq"))
    else:
        freq = index.groupBy("h").agg(F.count("*").alias("freq")).join(vocabulary, "h", "left_semi")
    width = F.least(F.lit(n), F.col("n_item"))
    first = F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - width + 1), F.least("pos", F.col("n_item") - width))).alias("window")
    rank = F.row_number().over(Window.partitionBy("ik", "window").orderBy(F.coalesce("freq", F.lit(0)), "pos"))
    ranked = place.join(freq, "h", "left").select("*", first).withColumn("rank", rank)
    return ranked.where("rank <= 2").select("ik", "pos", "h", F.least(F.lit(2), "n_item").alias("need")).distinct()


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, dk, at, and the columns of terms): the index's posting lists of `terms`."""
    return index.join(_bounded(terms), "h")


def alignments(lists: DataFrame) -> DataFrame:
    """(dk, ik, shift): offset-adjusted posting lists, intersected."""
    found = lists.groupBy("dk", "ik", (F.col("at") - F.col("pos")).alias("shift")).agg(F.count("*").alias("met"), F.first("need").alias("need"))
    return found.where("met >= need").select("dk", "ik", "shift")


def nearby(lists: DataFrame, anchor: DataFrame, slop: int, share: float) -> DataFrame:
    """(dk, ik, near, of): at least `share` of an item's anchors stand in a document within `slop` words of one alignment."""
    asked = anchor.groupBy("ik").agg(F.count("*").alias("of"))
    cell = F.floor((F.col("at") - F.col("pos")) / slop)
    met = lists.select("dk", "ik", "pos", F.explode(F.array(cell, cell + 1)).alias("cell")).distinct()
    met = met.groupBy("dk", "ik", "cell").agg(F.count("*").alias("near")).groupBy("dk", "ik").agg(F.max("near").alias("near"))
    return met.join(_bounded(asked), "ik").where(F.col("near") >= share * F.col("of"))


def _matches(documents: DataFrame, benchmark: DataFrame, n: int, keep: list[str], index: DataFrame | None, near: bool) -> DataFrame:
    """_kept: struct of the columns `keep`; _n_words; _hits: array of (first, end, item_id) of every window occurrence, in words, null
    without any; with `near`, _near: ids of the items that stand nearby, null without any."""
    items = items_of(benchmark)
    index = build_index(documents) if index is None else index
    anchor, _ = written(anchors(index, items, n), "decontam-anchors")
    lists, _ = written(postings(index, anchor), "decontam-postings")
    found = alignments(lists).join(_bounded(items.select("ik", "item_id", "words")), "ik").groupBy("dk").agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("found"))
    if near:
        close = nearby(lists, anchor, NEAR_WORDS, NEAR_SHARE).join(_bounded(items.select("ik", "item_id")), "ik")
        found = found.join(close.groupBy("dk").agg(F.collect_set("item_id").alias("near")), "dk", "full")
    found, _ = written(found, "decontam-found")
    d = documents.select(_document().alias("dk"), F.struct(*(documents[c].alias(c) for c in keep)).alias("_kept"), documents["text"].alias("_text"))
    d = perhaps(d, F.col("dk"), found.select("dk"))  # texts without an alignment stay where they are
    bare = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns if c != "dk"]
    d = d.where("_maybe").join(found, "dk", "left").drop("_maybe").unionByName(d.where("not _maybe").drop("_maybe").select("*", *bare))

    def occurrences(c: Column) -> Column:
        width = F.least(F.lit(n), F.size(c["words"]))
        same = lambda j: (c["shift"] + j >= 0) & (c["shift"] + j + width <= F.size("_exact")) & (F.slice("_exact", F.greatest(F.lit(1), c["shift"] + j + 1), width) == F.slice(c["words"], j + 1, width))
        starts = F.filter(F.sequence(F.lit(0), F.size(c["words"]) - width), same)
        return F.transform(starts, lambda j: F.struct((c["shift"] + j).alias("first"), (c["shift"] + j + width).alias("end"), c["item_id"].alias("item_id")))

    more = ["near"] if near else []
    d = d.select("_kept", "found", *more, F.when(F.col("found").isNotNull(), words(F.col("_text"))).alias("_exact"), F.size(raw_words(F.col("_text"))).cast("long").alias("_n_words"))
    return d.select("_kept", "_n_words", F.when(F.col("found").isNotNull(), F.flatten(F.transform("found", occurrences))).alias("_hits"), *(F.col(c).alias("_near") for c in more))


def phrase_matches(documents: DataFrame, benchmark: DataFrame, n: int = 13, keep: list[str] = ("doc_id",), index: DataFrame | None = None) -> DataFrame:
    """The columns `keep`, _n_words and _hits: one row per document; _hits holds (first, end, item_id) of every window occurrence,
    in words, null without any. index: what `build_index` gave for these documents; without it one is built."""
    m = _matches(documents, benchmark, n, list(keep), index, False)
    return m.select(*(F.col("_kept")[c].alias(c) for c in keep), "_n_words", "_hits")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, keep: list[str] = ("doc_id",), index: DataFrame | None = None, near: bool = False) -> DataFrame:
    """The columns `keep`, then _n_words, _n_hit (words inside any occurrence), _items (ids of the items that occur, sorted as
    strings) and _contaminated: some word is hit and share * _n_hit >= _n_words. With `near`, also _near: how many items have most of
    their rare terms within a few words of one alignment, whether or not a window occurs."""
    m = _matches(documents, benchmark, n, list(keep), index, near)
    span = F.array_sort(F.transform("_hits", lambda h: F.struct(h["first"].alias("a"), h["end"].alias("b"))))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["b"] - F.greatest(acc["end"], h["a"]))).cast("long").alias("n"), F.greatest(acc["end"], h["b"]).alias("end"))
    n_hit = F.coalesce(F.aggregate(span, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"]), F.lit(0))
    ids = F.coalesce(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["item_id"].cast("string")))), _no_words())
    more = [F.coalesce(F.size("_near"), F.lit(0)).cast("long").alias("_near")] if near else []
    m = m.select("_kept", "_n_words", n_hit.cast("long").alias("_n_hit"), ids.alias("_items"), *more)
    bad = (F.col("_n_hit") > 0) & (share * F.col("_n_hit") >= F.col("_n_words"))
    return m.select(*(F.col("_kept")[c].alias(c) for c in keep), "_n_words", "_n_hit", "_items", bad.alias("_contaminated"), *(["_near"] if near else []))


def proximity_matches(documents: DataFrame, benchmark: DataFrame, n: int = 13, slop: int = NEAR_WORDS, share: float = NEAR_SHARE, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, near, of): at least `share` of an item's anchor terms stand in a document within `slop` words of one alignment."""
    items = items_of(benchmark)
    index = build_index(documents) if index is None else index
    anchor, _ = written(anchors(index, items, n), "decontam-anchors")
    found = nearby(postings(index, anchor), anchor, slop, share).join(_bounded(items.select("ik", "item_id")), "ik")
    return documents.select(_document().alias("dk"), "doc_id").join(found, "dk").select("doc_id", "item_id", "near", "of")
