"""Count-only Viterbi segmentation under a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece inside a word; dynamic programming over end positions carries the best
score and the piece count of the best path, never the path itself. Scores and ties follow the public unigram tokenizer: sums run
left to right in double precision, a later candidate must be strictly better, candidates for an end come by rising start, a
character without a piece of its own costs the least score less 10 and unknown characters in a row count as their UTF-8 bytes.
Spaces become the marker U+2581 and a text is segmented between markers, so each distinct word is counted once per worker.

The vocabulary is a public SentencePiece file's pieces; by default their scores follow Zipf's law of their rank, as that file's
own scores are merge ranks (`scores="file"` takes those). Nothing is trained.

Edge cases: a null or empty text has 0 tokens; repeated rows count alike; very long texts take time in proportion; an empty table
gives no rows; extra columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from usagelake.llm.common import kept_in_worker

MARK = "▁"
PENALTY = 10.0


def vocabulary(path: str | None = None, scores: str = "zipf") -> list[tuple[str, float]]:
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    if scores == "file":
        return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]
    total = math.log(sum(1 / (i + 1) for i in range(n)))
    return [(sp.id_to_piece(i), -math.log(i + 1) - total) for i in range(n)]


class Viterbi:
    """counts(words) of words that hold the marker at their start only."""

    def __init__(self, vocab: list[tuple[str, float]], max_words: int = 400_000):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - PENALTY
        self.max_words = max_words
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of the best path. The automaton gives the pieces of an end by falling length: by rising start."""
        n, unknown, single = len(word), self.unknown, self.single
        best, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
        done = 0  # ends up to here have their unknown candidate
        for end, (size, score) in self.auto.iter(word):
            end += 1
            while done < end - 1:
                done += 1
                c = word[done - 1]
                if c not in single and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    pieces[done] = pieces[done - 1] + len(c.encode())
            s = best[end - size] + score
            if s > best[end]:
                best[end] = s
                pieces[end] = pieces[end - size] + 1
        while done < n:
            done += 1
            c = word[done - 1]
            if c not in single and best[done - 1] + unknown > best[done]:
                best[done] = best[done - 1] + unknown
                pieces[done] = pieces[done - 1] + len(c.encode())
        return pieces[n]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.max_words:
            self.known = {}
        words = [(t.replace(MARK, " ") if MARK in t else t).split(" ") if t else [] for t in texts]
        for w in words:
            if len(w) > 1 and not w[0]:
                del w[0]  # a text that starts with a space gets no second marker
        known = self.known
        for w in set().union(*words).difference(known) if words else ():
            known[w] = self.count(MARK + w)
        get = known.__getitem__
        return np.array([sum(map(get, w)) for w in words], np.int64)


def token_counts(documents: DataFrame, path: str | None = None, scores: str = "zipf", keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and n_tokens long."""
    kept = documents.select(*keep, documents["text"].alias("_text"))
    schema = kept.drop("_text").schema.add("n_tokens", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = kept_in_worker(("viterbi", path, scores), lambda: Viterbi(vocabulary(path, scores)))
        for b in batches:
            if b.num_rows:
                texts = b.column("_text").to_pylist()
                n = np.concatenate([v.counts(texts[a : a + 500]) for a in range(0, len(texts), 500)])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return kept.mapInArrow(run, schema)
