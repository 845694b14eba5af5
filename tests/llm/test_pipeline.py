"""The corpus pipeline, stage by stage, against brute force over its own inputs."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_training_data import SF, base_secrets, brute_links, expected_ids, words_of

import corpus_pipeline
from usagelake.llm import queries
from usagelake.llm.common import written


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out, _ = written(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (docs, out)
        docs = out
        assert name == "packing" or out.columns == columns
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}

    before, after = map(texts, kept["toxicity"])
    toxic = {r.doc_id for r in queries.QUERIES["op2_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert set(after) == set(before) - toxic and all(after[i] == before[i] for i in after)

    before, after = map(texts, kept["near_duplicates"])
    _, comp = brute_links(list(before.items()))
    assert after == {i: t for i, t in before.items() if comp[i] == i}

    before, after = map(texts, kept["decontamination"])
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_of(r.text)
        n = min(13, len(w))
        if n:
            windows[n].update(tuple(w[j : j + n]) for j in range(len(w) - n + 1))
    clean = {}
    for i, t in before.items():
        w, hit = words_of(t), set()
        for n, some in windows.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in some:
                    hit.update(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t
    assert after == clean and len(clean) < len(before)

    before, after = map(texts, kept["secrets"])
    assert set(after) == set(before)
    for i, t in before.items():
        secret = base_secrets(t)
        assert not base_secrets(after[i])
        if not secret:
            assert after[i] == t
        else:
            assert after[i].startswith(t[: secret[0][0]] + "[SECRET]")
    assert all(r.n_chars == len(r.text) for r in kept["secrets"][1].collect())

    want = expected_ids(list(after.items()))
    parts = defaultdict(list)
    for p in kept["packing"][1].collect():
        parts[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == want


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, ids that are missing or shared, ties, an empty table, clashing names."""
    item = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    a, key = " ".join(f"a{i}" for i in range(40)), "token=abcdef1234567890"
    rows = [(1, a), (1, a), (1, a), (2, a), (3, a + " more words of its own " + item), (3, "another text under the same id"), (None, a), (None, "no id here"), (None, "no id here"), (4, None), (5, ""), (5, ""), (6, f"key {key} end"), (7, "x" * 300_000), (8, "word " * 60_000)]
    names = ["row", "_row", "_whole", "_kept", "_toxicity", "toxicity", "score", "_found", "_hits", "_n_words", "_contaminated", "base", "cand", "spans", "h1", "component_id", "kept", "dk"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    none = df.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df, _ = written(stage(spark, df, str(tmp_path)), f"edge-{name}")
        none = stage(spark, none, str(tmp_path))
        assert df.columns == ["doc_id", "text", *names] and none.columns == df.columns and none.count() == 0, name
        assert df.select(*names).distinct().count() == 1
        got = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        if name == "toxicity":
            assert got == sorted(rows, key=str)
        elif name == "near_duplicates":
            assert got == sorted([(1, a), rows[4], rows[5], rows[7], (4, None), (5, ""), *rows[12:]], key=str)
        elif name == "decontamination":
            assert got == sorted([(1, a), rows[5], rows[7], (4, None), (5, ""), *rows[12:]], key=str)
        else:
            assert got == sorted([(1, a), rows[5], rows[7], (4, None), (5, ""), (6, "key [SECRET] end"), *rows[13:]], key=str)
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, none, str(tmp_path)).count() == 0
    pieces = pack(spark, df, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(pieces) == 8 and all(r.n == r["all"] for r in pieces if r.doc_id in (1, 4, 5, 6, 7, 8)) and {r.n for r in pieces if r.doc_id in (4, 5)} == {1}


def test_written_stages_go(spark, tmp_path):
    from pathlib import Path

    from usagelake.llm.common import scratch

    with scratch(spark) as log:
        _, kept = written(spark.range(3), "kept")
        _, gone = written(spark.range(3), "gone")
        log.remove(kept)
    assert Path(kept).exists() and not Path(gone).exists()
    spark.read.parquet(kept).count()
