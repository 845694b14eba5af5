"""Cross-tokenizer alignment against a token-by-token walk over the tokenizers' own output."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usagelake.llm import alignment, queries

ROW = "doc_id long, text string"
EDGE = [None, "", " ", "   ", "a", "\n", " a  b   c ", "a\n\n b\t c\r\n  d ", "日本語 テキスト 😀 é Ⅷ ﬁ", "say <|endoftext|> and <s> </s> <unk>", "it's 'tis I'll 12345 67", "mark \u2581 here", "a\x00b \x1c c\x85 d\u2003 e\u3000f",
        "same text here", "same text here", "x" * 30_000, "word " * 20_000, "é" * 5_000, "\U0001f600" * 3_000, "a" + " " * 3_000 + "b", "e\u0301 \u200b \ufeff z\u180e w"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), alignment.Vocabularies(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def walked(rows, tools):
    a_tool, b_tool, v = tools
    out = []
    for doc, text in rows:
        a, b = (a_tool.encode(f" {text}", add_special_tokens=False).ids, b_tool.encode(text)) if text else ([], [])
        size = [[len(v.a_bytes[i]) for i in a], [len(v.b_bytes[i]) for i in b]]
        if text and not b"".join(v.a_bytes[i] for i in a) == b"".join(v.b_bytes[i] for i in b) == f" {text}".encode():
            a, b = [], []
        i = j = at_a = at_b = 0
        links, groups, own = [], [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + size[0][i], at_b + size[1][j]
            if end_a <= end_b:
                own[0].append(a[i])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                own[1].append(b[j])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = ([], [])
        out.append((doc, len(a), len(b), groups, links))
    count = Counter(p for d in out for p in set(d[4]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    said = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return sorted(((d, na, nb, len(g), len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), said(g)) for d, na, nb, g, x in out), key=str)


def test_edge_texts_with_every_share_of_frequent_pairs(spark, tools):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(EDGE * 2)]
    df = spark.createDataFrame(rows, ROW).repartition(5).withColumns({c: F.lit("x") for c in ("row", "start", "side", "n", "ids", "pair", "best", "own", "bucket")})
    want = walked(rows, tools)
    for head in (1 << 20, 300, 1):
        assert sorted((tuple(r) for r in alignment.align(df, head=head).collect()), key=str) == want
    assert alignment.align(df.where("false")).count() == 0


def test_query_on_whole_tables(spark, tools):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, sf).collect()), key=str) == walked(rows, tools)


def test_a_document_in_parts_is_swept_like_a_whole_one(tools, monkeypatch):
    v, rng = tools[2], random.Random(3)
    texts = [" ".join(rng.choice(["the", "Straße", "naïve", "😀", "zusammen", "\n", "x1", "  "]) for _ in range(rng.randrange(1, 400))) for _ in range(20)]
    flat, good = v.ids(texts)
    assert good.all()
    runs = []
    for i in range(len(texts)):
        own = []
        for side in (0, 1):
            ids = flat[side][0][flat[side][1][i] : flat[side][1][i + 1]]
            upto = np.concatenate([[0], np.cumsum((v.a_len, v.b_len)[side][ids])])
            own += [(i, int(upto[k]), side, ids[k : k + 7]) for k in range(0, len(ids), 7)]
        runs += sorted(own, key=lambda r: r[1:3])
    results = []
    for held in (10**6, 50, 9):
        monkeypatch.setattr(alignment, "HELD", held)
        machine = alignment.Sweep(v.a_len, v.b_len)
        done = []
        for k in range(0, len(runs), 11):
            some = runs[k : k + 11]
            done += machine.feed([r[0] for r in some], [r[0] for r in some], [r[2] for r in some], [r[3] for r in some])
        done += machine.finish()
        results.append([(d["row"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], d["sha"].hexdigest(), d["pairs"].tolist(), d["times"].tolist()) for d in done])
    assert results[0] == results[1] == results[2] and len(results[0]) == len(texts)


def test_runs_and_pairs_come_back_from_their_bytes():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000).astype(np.uint16)
    assert (alignment.unpacked(alignment.packed(ids)) == ids).all()
    pairs = np.unique(np.random.default_rng(2).integers(0, 50_257 << 16, 3000))
    times = np.random.default_rng(3).integers(1, 600, len(pairs))
    got = alignment.unpacked_pairs(alignment.packed_pairs(pairs, times), len(pairs))
    assert (got[0] == pairs).all() and (got[1] == times).all()
