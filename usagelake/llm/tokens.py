"""Exact token ids of whole texts, by a public tokenizer file, with the ids of repeated words kept.

`word_bpe_49k.json` never lets a token cross white space, so a text's ids are the ids of its pieces between spaces and line ends,
each looked up once. Pieces come from the tokenizer itself; nothing of its merges is reimplemented.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from usagelake.llm.common import kept_in_worker


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Latin letters up to U+017F, without those whose lower case is more than one letter.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
#: What a text of plain runs does not hold: other characters, apostrophes (contractions) and the start of special tokens.
NOT_PLAIN = re.compile(rf"[^\t\n\r -&(-~{LETTERS}]|<\|")
#: In such a text, lower-cased, the tokenizer's own words are runs of letters, single digits and runs of other signs.
RUN = re.compile(rf"[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")


class WordIds:
    """ids(texts) -> (flat uint32 ids, offsets): the ids of each text followed by `end_id`.

    Plain texts are cut into the tokenizer's words, others between spaces. Letter runs are encoded many at a time, as each of them
    ends with a word-end token; all else is encoded one by one. The table starts anew when it is full.
    """

    def __init__(self, path: str, end_id: int | None = 2, max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tok, self.end_id, self.max_words = Tokenizer.from_file(path), end_id, max_words
        self.ends_word = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(1, np.int64), np.zeros(1, np.int32)

    def _add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(keys, range(len(self.start), len(self.start) + len(keys))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat])

    def _learn(self, words: list[str]) -> None:
        letters = re.compile(rf"[{LETTERS}]+").fullmatch
        runs = [w for w in words if letters(w)]
        rest = [w for w in words if not letters(w)]
        if runs:
            flat = np.array(self.tok.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends_word[flat])
            if len(last) == len(runs):
                self._add(runs, flat, np.diff(last, prepend=-1))
            else:
                rest += runs
        if rest:
            got = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
            n = np.array([len(x) for x in got], np.int64)
            self._add(rest, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > self.max_words:
            self._reset()
        words = [(t or "").replace("\n", " ").split(" ") if not t or NOT_PLAIN.search(t) else RUN.findall(t.lower()) for t in texts]
        new = set().union(*words).difference(self.place)
        if new:
            self._learn(list(new))
        n_words = np.array([len(p) for p in words], np.int64)
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        size = self.size[place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(self.start[place] - total[:-1], size) + np.arange(total[-1])]
        ends = total[np.concatenate([[0], np.cumsum(n_words)])]
        if self.end_id is not None:
            out = np.insert(out, ends[1:], np.uint32(self.end_id))
            ends = ends + np.arange(len(ends))
        return out, ends


def word_ids(path: str, end_id: int | None) -> WordIds:
    """One table per worker process."""
    return kept_in_worker(("word_ids", path, end_id), lambda: WordIds(path, end_id))
