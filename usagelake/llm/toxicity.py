"""Toxicity scores by a bidirectional GRU with attention pooling, trained in numpy.

Inputs of a word are its own embedding (words of the training sample) and the mean of its character n-gram embeddings, so that
unseen inflections of a known stem still count. A text is scored over all overlapping windows of `window` words at half-window
steps; its score is the maximum. Labels are learned from a bounded sample (`max_docs` per class, texts of at most
`max_train_chars`), by multiple-instance learning: a toxic text teaches through its most suspicious window.

Edge cases: a null or empty text, or one without letters, gets the score of one empty window (a clean score); repeated rows are
scored alike; an empty labels table gives an untrained model that scores 0.5 everywhere and predicts 0; extra columns are ignored
by `score` unless named in `keep`, and may have any name but that of the score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from usagelake.llm.common import give_back, kept_in_worker

WORD = re.compile(r"[^\W\d_]+")
GRAMS = (5,)
PAD = 0


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)] or [w]


def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class BiGRU:
    """Parameters, training and scoring. `fit` runs on the driver over a bounded sample, `scores` inside tasks."""

    def __init__(self, dim: int = 12, hidden: int = 8, window: int = 32, seed: int = 11):
        self.dim, self.hidden, self.window, self.stride = dim, hidden, window, window // 2
        self.rng = np.random.default_rng(seed)
        self.words: dict[str, int] = {}
        self.grams: dict[str, int] = {}
        self.p: dict[str, np.ndarray] = {}

    # -- parameters -----------------------------------------------------------------------------------------------------
    def _init(self) -> None:
        d, h, g = 2 * self.dim, self.hidden, self.rng.normal
        self.p = {"ew": np.zeros((len(self.words) + 1, self.dim)), "ec": np.zeros((len(self.grams) + 1, self.dim)), "wa": g(0, 0.3, (2 * h, h)), "va": g(0, 0.3, h), "wo": g(0, 0.5, 2 * h), "bo": np.zeros(1)}
        for s in "fb":
            self.p |= {f"w{s}": g(0, 0.4, (d, 3 * h)), f"u{s}": g(0, 0.25, (h, 3 * h)), f"c{s}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # -- the network over windows; x: (T, N, d) inputs, mask: (T, N) -------------------------------------------------------
    def _run(self, xp: np.ndarray, mask: np.ndarray, s: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, N, h) of one direction from projected inputs (T, N, 3h)."""
        t_n, n, h = xp.shape[0], xp.shape[1], self.hidden
        u, out, state = self.p[f"u{s}"], np.zeros((t_n, n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(t_n) if s == "f" else range(t_n - 1, -1, -1):
            a = state @ u
            rz = _sig(xp[t, :, : 2 * h] + a[:, : 2 * h])
            r, z = rz[:, :h], rz[:, h:]
            cand = np.tanh(xp[t, :, 2 * h :] + r * a[:, 2 * h :])
            m = mask[t][:, None]
            new = np.where(m, (1 - z) * cand + z * state, state)
            if keep is not None:
                keep.append((t, state, a[:, 2 * h :], r, z, cand))
            state = out[t] = new
        return out

    def _pool(self, hs: np.ndarray, mask: np.ndarray):
        k = np.tanh(hs @ self.p["wa"])
        e = np.where(mask, k @ self.p["va"], -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        c = (a[:, :, None] * hs).sum(0)
        return k, a, c, _sig(c @ self.p["wo"] + self.p["bo"])

    def _gradients(self, xw, rows, gram_of, mask, y, weight):
        """Gradients of the weighted cross entropy. xw: (T, N) places in rows; rows: word ids; gram_of: ragged n-grams of rows."""
        p, h, d = self.p, self.hidden, self.dim
        flat, starts, lens = gram_of
        x_u = np.concatenate([p["ew"][rows], np.add.reduceat(p["ec"][flat], starts) / lens[:, None]], 1)
        x = x_u[xw]
        kf, kb = [], []
        hf = self._run(x @ p["wf"] + p["cf"], mask, "f", kf)
        hb = self._run(x @ p["wb"] + p["cb"], mask, "b", kb)
        hs = np.concatenate([hf, hb], 2)
        k, a, c, out = self._pool(hs, mask)
        g = {n: np.zeros_like(v) for n, v in p.items()}
        do = ((out - y) * weight / len(y)).astype(np.float32)
        g["wo"], g["bo"] = c.T @ do, do.sum(keepdims=True)
        dc = do[:, None] * p["wo"]
        da = (hs * dc).sum(2)
        de = a * (da - (a * da).sum(0))
        dk = de[:, :, None] * p["va"] * (1 - k * k)
        g["va"] = (de[:, :, None] * k).sum((0, 1))
        g["wa"] = np.einsum("tnh,tnk->hk", hs, dk)
        dhs = a[:, :, None] * dc + dk @ p["wa"].T
        dx = np.zeros_like(x)
        for s, kept, part in (("f", kf, dhs[:, :, :h]), ("b", kb, dhs[:, :, h:])):
            carry, u = np.zeros((x.shape[1], h), np.float32), p[f"u{s}"]
            for t, prev, an, r, z, cand in reversed(kept):
                m = mask[t][:, None]
                dh = part[t] + carry
                live = np.where(m, dh, 0)
                dcand = live * (1 - z) * (1 - cand * cand)
                dz = live * (prev - cand) * z * (1 - z)
                dr = dcand * an * r * (1 - r)
                dpre = np.concatenate([dr, dz, dcand], 1)
                dgate = np.concatenate([dr, dz, dcand * r], 1)
                g[f"u{s}"] += prev.T @ dgate
                g[f"w{s}"] += x[t].T @ dpre
                g[f"c{s}"] += dpre.sum(0)
                dx[t] += dpre @ p[f"w{s}"].T
                carry = np.where(m, live * z, dh) + dgate @ u.T
        du = np.zeros_like(x_u)
        np.add.at(du, xw.ravel(), dx.reshape(-1, 2 * d))
        np.add.at(g["ew"], rows, du[:, :d])
        np.add.at(g["ec"], flat, np.repeat(du[:, d:] / lens[:, None], lens, 0))
        g["ew"][PAD] = g["ec"][PAD] = 0
        return g

    # -- training -----------------------------------------------------------------------------------------------------------
    def fit(self, texts: list[str], labels: list[int], epochs: int = 10, max_vocab: int = 30000, rate: float = 0.02) -> "BiGRU":
        docs = [WORD.findall((t or "").lower()) or [""] for t in texts]
        y = np.array(labels, np.float32)
        df_w, df_g, pos_w, pos_g = Counter(), Counter(), Counter(), Counter()
        one: dict[str, str] = {}
        gram_list = {w: [one.setdefault(g, g) for g in grams_of(w)] for w in sorted(set().union(*docs))}  # each n-gram stored once
        del one
        for d, lab in zip(docs, labels):
            ws = set(d)
            gs = {g for w in ws for g in gram_list[w]}
            df_w.update(ws)
            df_g.update(gs)
            if lab:
                pos_w.update(ws)
                pos_g.update(gs)
        min_df = max(3, len(docs) // 400)  # a word of a few texts says nothing of others
        best = lambda c: [k for k, n in sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:max_vocab] if n >= min_df]
        self.words = {w: i + 1 for i, w in enumerate(best(df_w))}
        self.grams = {g: i + 1 for i, g in enumerate(best(df_g))}
        self._init()
        if not len(y) or y.min() == y.max():
            return self
        n1, n0 = y.sum(), len(y) - y.sum()
        odds = lambda p, n: np.log((p + 0.5) / (n1 + 1)) - np.log((n - p + 0.5) / (n0 + 1))
        all_words = list(gram_list)
        place = {w: i for i, w in enumerate(all_words)}
        wid = np.array([self.words.get(w, PAD) for w in all_words])
        gids = [[i for i in map(self.grams.get, gram_list[w]) if i] or [PAD] for w in all_words]
        first = np.array([max([odds(pos_w[w], df_w[w])] + [odds(pos_g[x], df_g[x]) for x in gram_list[w]]) for w in all_words])
        del gram_list, df_w, df_g, pos_w, pos_g
        ids = [np.array([place[w] for w in d]) for d in docs]
        win = [self._windows(i) for i in ids]
        owner = np.repeat(np.arange(len(docs)), [len(w[0]) for w in win])
        wins, masks = np.concatenate([w[0] for w in win]), np.concatenate([w[1] for w in win])
        at = np.concatenate([[0], np.cumsum([len(w[0]) for w in win])[:-1]])
        m1 = {n: np.zeros_like(v) for n, v in self.p.items()}
        m2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        step, weight = 0, np.where(y == 1, 0.5 * len(y) / n1, 0.5 * len(y) / n0).astype(np.float32)
        for epoch in range(epochs):
            if epoch < 2:
                s = np.where(masks, first[wins], -1e9).max(1)
            else:
                table = self._project(wid, gids)
                s = np.concatenate([self._score(table, wins[i : i + 8192], masks[i : i + 8192]) for i in range(0, len(wins), 8192)])
            order = np.lexsort((-s, owner))
            pick = order[at]  # the top window of each text
            for part in np.array_split(self.rng.permutation(len(docs)), max(1, len(docs) // 48)):
                w, mk = wins[pick[part]].T, masks[pick[part]].T
                uniq, inv = np.unique(w, return_inverse=True)
                ragged = [gids[u] for u in uniq]
                n_in = np.array([len(r) for r in ragged])
                flat = np.concatenate(ragged)
                g = self._gradients(inv.reshape(w.shape), wid[uniq], (flat, np.concatenate([[0], np.cumsum(n_in)[:-1]]), n_in), mk, y[part], weight[part])
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs)
                for n, v in self.p.items():
                    gn = np.clip(g[n], -1, 1)
                    m1[n] += 0.1 * (gn - m1[n])
                    m2[n] += 0.01 * (gn * gn - m2[n])
                    v -= (lr * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                    v *= 1 - (2e-3 if n in ("ew", "ec") else 1e-4)
        return self

    # -- scoring ------------------------------------------------------------------------------------------------------------
    def _windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of half overlap that cover ids, padded, with their masks."""
        n = len(ids)
        starts = np.arange(0, max(1, n - self.window + self.stride), self.stride)
        at = starts[:, None] + np.arange(self.window)
        mask = at < n
        return ids[np.minimum(at, n - 1)], mask

    def _project(self, wid, gids) -> np.ndarray:
        """(words, 6h) projected inputs of both directions: all of a word that the recurrence needs."""
        p, d = self.p, self.dim
        w = np.concatenate([p["wf"], p["wb"]], 1)
        n_in = np.array([len(g) for g in gids])
        flat = np.fromiter((x for g in gids for x in g), np.int64, int(n_in.sum()))
        chars = np.add.reduceat(p["ec"][flat], np.concatenate([[0], np.cumsum(n_in)[:-1]])) / np.maximum(n_in, 1)[:, None]
        return (p["ew"][wid] @ w[:d] + chars @ w[d:] + np.concatenate([p["cf"], p["cb"]])).astype(np.float32)

    def _score(self, table: np.ndarray, wins: np.ndarray, masks: np.ndarray) -> np.ndarray:
        xp, mask, h3 = table[wins.T], masks.T, 3 * self.hidden
        hs = np.concatenate([self._run(xp[:, :, :h3], mask, "f"), self._run(xp[:, :, h3:], mask, "b")], 2)
        return self._pool(hs, mask)[3]


class Scorer:
    """Scores texts with a table of projected words that grows as words appear and starts anew when it is full."""

    def __init__(self, model: BiGRU, max_words: int = 200_000):
        self.m, self.max_words = model, max_words
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, 6 * self.m.hidden), np.float32)

    def _learn(self, words: list[str]) -> None:
        gg, gids = self.m.grams.get, []
        for w in words:
            gids.append([i for i in map(gg, grams_of(w)) if i] or [PAD])
        rows = self.m._project(np.array([self.m.words.get(w, PAD) for w in words]), gids)
        base = len(self.table)
        self.table = np.concatenate([self.table, rows])
        self.place.update(zip(words, range(base, base + len(words))))

    def scores(self, texts: list[str | None], chunk: int = 6144) -> np.ndarray:
        out = np.zeros(len(texts))
        i = 0
        while i < len(texts):
            docs, n_win, j = [], 0, i
            while j < len(texts) and n_win < chunk:
                docs.append(WORD.findall((texts[j] or "").lower()) or [""])
                n_win += len(docs[-1]) // self.m.stride + 1
                j += 1
            if len(self.place) > self.max_words:
                self._reset()
            new = set().union(*docs).difference(self.place)
            if new:
                self._learn(list(new))
            get = self.place.__getitem__
            win = [self.m._windows(np.fromiter(map(get, d), np.int64, len(d))) for d in docs]
            wins, masks = np.concatenate([w[0] for w in win]), np.concatenate([w[1] for w in win])
            s = np.concatenate([self.m._score(self.table, wins[a : a + 2048], masks[a : a + 2048]) for a in range(0, len(wins), 2048)])
            out[i:j] = np.maximum.reduceat(s, np.concatenate([[0], np.cumsum([len(w[0]) for w in win])[:-1]]))
            i = j
        return out


def held_out(col: str = "doc_id"):
    """Whether a row is never learned from; rows without an id are not labelled and count as not held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, max_docs: int = 1000, max_train_chars: int = 8000) -> BiGRU:
    """Fit on at most `max_docs` labelled texts of each class, none of them held out and none over `max_train_chars`.

    The sample is the labelled rows of smallest id hash; long texts are passed over (a bound on what the driver gathers; every text is
    scored whole), so twice as many ids are looked up. The ids (at most 4 * max_docs) are the only thing broadcast. An id labelled both
    0 and 1 teaches nothing; of several texts of one id the one of the smallest hash is taken.
    """
    told = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("least")).where("toxic = least")
    part = lambda value: told.where(F.col("toxic") == value).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_docs)
    ids = part(0).unionByName(part(1))
    rows = documents.select("doc_id", "text").where(F.length("text").between(1, max_train_chars)).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    sample, seen = [], Counter()
    for r in rows:
        if seen[r.toxic] < max_docs:
            seen[r.toxic] += 1
            sample.append(r)
    del rows
    model = BiGRU().fit([r.text for r in sample], [r.toxic for r in sample])
    del sample
    give_back()
    return model


def score(documents: DataFrame, model: BiGRU, keep: list[str] = ("doc_id",), out: str = "score", inside: str | None = None) -> DataFrame:
    """The columns `keep` and `out` double: the maximum over all overlapping windows of the whole text. inside: a struct of `keep` whose
    field `text` is the text, which then goes to the task once."""
    handle = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary limits of fit
    kept = documents.select(*keep, *([] if inside else [documents["text"].alias("_scored")]))
    key = uuid.uuid4().hex
    back = kept.schema.fields[: len(keep)]
    schema = StructType([*back, StructField(out, DoubleType(), False)])
    place = list(keep).index(inside) if inside else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(("toxicity", key), lambda: Scorer(handle.value))
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                texts = pc.struct_field(p.column(place), "text") if inside else p.column(p.num_columns - 1)
                s = scorer.scores(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([*p.columns[: len(back)], pa.array(s, pa.float64())], names=[*p.schema.names[: len(back)], out])
        give_back()

    return kept.mapInArrow(run, schema)
