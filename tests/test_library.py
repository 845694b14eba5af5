"""Library operators against the literal cases of FIXTURES.md, and the two properties: incremental = rebuild, order independence."""

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from usagelake import dims, queries
from usagelake.functions import scalars as Z
from usagelake.operators import attribution, deltas, journal, quota, reconcile, tokens
from usagelake.plans import serving
from usagelake.sources import files, histories, sinks
from usagelake.streaming import live


def near(a, b):
    return a == pytest.approx(b, abs=1e-6)


# -- scalars ------------------------------------------------------------------------------------------------------------------------


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    text = lambda f, v: one(f(F.lit(v).cast("string")))
    assert [text(Z.normalize_model, m) for m in ("OpenAI/GPT-5.5-2030-01-02", "gpt-5.4-20300102", "-2030-01-02", None)] == ["gpt-5.5", "gpt-5.4", "-2030-01-02", None]
    assert [text(Z.normalize_plan, p) for p in ("pro-lite", "ChatGPT_Pro  Lite", "PRO", "plus", "team", None)] == ["pro_lite", "pro_lite", "pro", "plus", "unknown", "unknown"]
    assert [text(Z.normalize_plan, p) for p in ("5x", "Max 5 x", "Pro Light", "pro 5", "20x", "max-20_x", "pro plus", "plus 20x", "PRO_20X", "")] == ["pro_lite", "pro_lite", "pro_lite", "pro_lite", "pro", "pro", "plus", "pro", "pro", "unknown"]
    assert [text(Z.service_tier, t) for t in (" Priority", "fast", "x", None)] == ["fast", "fast", "default", "default"]
    assert [text(Z.epoch, t) for t in ("2030-01-01T00:00:00Z", "2030-01-01T00:00:00.9+00:00", "junk", None)] == [1893456000, 1893456000, None, None]
    assert [text(Z.to_number, t) for t in ("1.5", "nan", "inf", "x", None)] == [1.5, None, None, None, None]
    assert [one(Z.reset_moved(F.lit(100), F.lit(x).cast("int"))) for x in (160, 161, 40, 39, None)] == ["same", "forward", "same", "backward", None]
    assert one(Z.time_left_percent(F.lit(3600), F.lit(0), F.lit(300))) == 80.0
    assert one(Z.percent_text(F.lit(42.25))) in ("42.2%", "42.3%")
    assert one(Z.duration_text(F.lit(90061))) == "1d 1h" and one(Z.duration_text(F.lit(-5))) == "0m"
    assert one(Z.first_present(F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("2")), "a", "b", "c")) is None
    assert one(Z.first_truthy(F.lit(None).cast("int"), F.lit(0), F.lit(7))) == 7
    import hashlib
    import hmac

    assert one(Z.hmac_sha256(F.lit("key").cast("binary"), F.lit("message").cast("binary"))) == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()
    assert one(Z.jwt_payload(F.lit("x.eyJleHAiOjEyM30.y"), "exp long")).exp == 123
    assert [one(Z.portable_name(F.lit(n))) for n in ("a.txt", "con", "../x", "")] == [True, False, False, False]


# -- session logs --------------------------------------------------------------------------------------------------------------------


def line(kind, payload, ts="2030-01-01T00:00:00Z"):
    return json.dumps({"timestamp": ts, "type": kind, "payload": payload})


def usage(total=None, last=None, **more):
    info = {k: v for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v is not None} | more
    return line("event_msg", {"type": "token_count", "info": info})


def events_of(spark, tmp_path, texts, folder="sessions"):
    for name, text in texts.items():
        p = tmp_path / folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return files.token_events(files.session_files(spark, str(tmp_path)))


def costs(spark, events):
    c = tokens.cost_by_model(events, dims.prices(spark), dims.fast_multipliers(spark))
    return {r.model: r for r in c.collect()}


def test_cumulative_deltas_and_cost(spark, tmp_path):
    t = "\n".join([line("session_meta", {"id": "s1"}), line("turn_context", {"model": "openai/gpt-5.5-2030-01-01"}), usage({"input_tokens": 100, "cached_input_tokens": 40, "cache_write_input_tokens": 2, "output_tokens": 10}), usage({"input_tokens": 150, "cached_input_tokens": 80, "cache_write_input_tokens": 5, "output_tokens": 20})]) + "\n"
    e = events_of(spark, tmp_path, {"a/b.jsonl": t})
    r = costs(spark, e)["gpt-5.5"]
    assert (r.input - r.cached - r.cache_write, r.cached, r.cache_write, r.output, r.requests) == (65, 80, 5, 20, 2) and near(r.total_cost, 0.00099)
    assert sorted(x.event_id for x in e.collect()) == ["s1:1", "s1:2"]


def test_fast_tier(spark, tmp_path):
    t = "\n".join([line("turn_context", {"model": "gpt-5.5"}), usage({"input_tokens": 100, "output_tokens": 10}), line("turn_context", {"thread_settings": {"service_tier": "priority"}}), usage({"input_tokens": 150, "output_tokens": 20})]) + "\n"
    assert near(costs(spark, events_of(spark, tmp_path, {"x.jsonl": t}))["gpt-5.5"].total_cost, 0.002175)


def test_aliases_bad_lines_and_partial_ends(spark, tmp_path):
    good = usage(last={"prompt_tokens": 9, "completion_tokens": 1, "prompt_tokens_details": {"cached_tokens": 4}})
    t = good.replace('"info"', '"note": "session_meta thread_settings_applied", "info"') + "\n\nnot json token_count event_msg\n" + usage(last={"input_tokens": 0, "cached_input_tokens": 3}) + "\n" + good[: len(good) // 2]
    e = events_of(spark, tmp_path, {"x.jsonl": t}).collect()
    assert [(r.input, r.cached, r.output, r.line.block) for r in e] == [(9, 4, 1, 0)]
    e = events_of(spark, tmp_path, {"x.jsonl": t[: -(len(good) // 2)] + good}).collect()  # a whole last line without an end counts
    assert sorted((r.input, r.event_id) for r in e) == [(9, "x:1"), (9, "x:2")]


def test_replayed_history_and_growth(spark, tmp_path):
    first = [line("session_meta", {"id": "c", "forked_from_id": "p"}), usage({"input_tokens": 10}), line("event_msg", {"type": "thread_settings_applied"}), usage({"input_tokens": 15})]
    got = events_of(spark, tmp_path, {"x.jsonl": "\n".join(first) + "\n"}).collect()
    assert [(r.event_id, r.input) for r in got] == [("c:2", 5)]
    grown = first + [usage({"input_tokens": 40})]
    one = sorted((r.event_id, r.input) for r in events_of(spark, tmp_path, {"x.jsonl": "\n".join(grown) + "\n"}).collect())
    clean = sorted((r.event_id, r.input) for r in events_of(spark, tmp_path / "new", {"x.jsonl": "\n".join(grown) + "\n"}).collect())
    assert one == clean == [("c:2", 5), ("c:3", 25)]


def test_prices(spark):
    m = 1_000_000
    e = spark.createDataFrame([("gpt-5.5", 2 * m, m, 0, m), ("gpt-5.6-sol", 3 * m, m, m, m), ("gpt-5.6-terra", 3 * m, m, m, m), ("gpt-5.6-luna", 3 * m, m, m, m), ("GPT-5.4-mini-2030-01-01", m, 0, 0, 0), ("nothing", m, 0, 0, 0)], "model string, input long, cached long, cache_write long, output long").withColumn("tier", F.lit("default"))
    got = {k: r.total_cost for k, r in costs(spark, e).items()}
    assert {k: round(v, 6) for k, v in got.items()} == {"gpt-5.5": 35.5, "gpt-5.6-sol": 41.75, "gpt-5.6-terra": 20.875, "gpt-5.6-luna": 8.35, "gpt-5.4-mini": 0.75, "nothing": 0.0}
    fast = costs(spark, e.select(F.explode(F.array(*map(F.lit, ("gpt-5.4", "gpt-5.3-codex", "gpt-5.5", "gpt-5.6-sol")))).alias("model"), F.lit("fast").alias("tier"), F.lit(m).alias("input"), *(F.lit(0).alias(c) for c in tokens.COUNTERS[1:])).distinct())
    assert {k: round(r.total_cost, 6) for k, r in fast.items()} == {"gpt-5.4": 5.0, "gpt-5.3-codex": 3.5, "gpt-5.5": 12.5, "gpt-5.6-sol": 12.5}


def test_json_sequences(spark):
    rows = [("a", '{"x":1}\n{\n "y": 2}'), ("b", '{"x":1}\nbroken\n[1]\n{"z":3}'), ("c", ""), ("d", None)]
    got = files.json_sequence(spark.createDataFrame(rows, "file string, value string")).collect()
    assert [(r.file, r.pos, json.loads(r.value)) for r in sorted(got, key=lambda r: (r.file, r.pos))] == [("a", 0, {"x": 1}), ("a", 1, {"y": 2}), ("b", 0, {"x": 1}), ("b", 1, {"z": 3})]
    with pytest.raises(ValueError):
        files.json_objects("{} broken", strict=True)


# -- quota ---------------------------------------------------------------------------------------------------------------------------------


def test_quota_windows(spark):
    w = lambda p, s, r, plan: {"used_percent": p, "limit_window_seconds": s, "reset_at": r} | ({"planType": plan} if plan else {})
    bodies = [
        {"rate_limit": {"primary_window": w(42.5, 18000, 1893456000, "plus"), "secondary_window": w(61, 604800, 1893456000, "pro_lite")}},
        {"planType": "pro", "rate_limit": {"primary_window": w(1, 18000, 1, None), "secondary_window": w(2, 604800, 1, None)}},
        {"rate_limit": {"secondary_window": w(61, 604800, 1, "plus")}},
        {"nothing": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "junk")], "id long, body string")
    got = {(r.id, r.window): r for r in quota.required_windows(df, "id", "body").collect()}
    assert (got[0, "5h"].used_percent, got[0, "7d"].used_percent, got[0, "5h"].reset_at, got[0, "7d"].plan_multiplier) == (42.5, 61.0, "2030-01-01T00:00:00Z", 5.0)
    assert got[1, "5h"].plan == got[1, "7d"].plan == "pro" and got[1, "5h"].plan_multiplier == 20
    assert got[2, "5h"].unavailable and got[2, "5h"].used_percent == 0 and not got[2, "7d"].unavailable
    assert {k[0] for k in got} == {0, 1, 2}


def test_quota_nodes_of_many_rows_and_levels(spark):
    deep = {"used_percent": 7, "limit_window_seconds": 18000}
    for _ in range(40):
        deep = {"x": [deep]}
    df = spark.createDataFrame([(i, json.dumps({"a": {"used_percent": 1, "window_minutes": 300}})) for i in range(20)] + [(99, json.dumps(deep))], "id long, body string")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")  # in the place of the default's million
    try:
        got = {r.id: r for r in quota.required_windows(df, "id", "body").where("window = '5h'").collect()}
        assert quota.json_nodes(df, "id", "body").count() == 20 * 2 + 81
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    assert len(got) == 21 and got[99].used_percent == 7 and got[99].path == "$" + ".x[0]" * 40


def test_quota_keys_and_names(spark):
    bodies = [
        {"x": {"windowDurationMins": 300, "usedPercent": 12}},
        {"limitName": "weekly", "used_percent": 5},
        {"primary": {"used_percent": 5}},  # the path names no window
        {"a": {"limit_window_seconds": 18059}, "b": {"usedPercent": 3, "window_seconds": 604800, "planType": "plus"}},  # whole minutes; no used share
        {"z": {"window_minutes": 300, "used_percent": 1}, "a": {"window_minutes": 300, "used_percent": 2}, "m": {"window_minutes": 300, "used_percent": 3, "credits": {"balance": 1}}},
        {"z": {"window_minutes": 300, "used_percent": 1}, "a": {"window_minutes": 300, "used_percent": 2}},  # equals: in the order of the text
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id long, body string")
    got = {(r.id, r.window): (r.used_percent, r.path, r.plan) for r in quota.required_windows(df, "id", "body").where("not unavailable").collect()}
    assert got == {(0, "5h"): (12.0, "$.x", "unknown"), (1, "7d"): (5.0, "$", "unknown"), (3, "5h"): (None, "$.a", "plus"), (3, "7d"): (3.0, "$.b", "plus"), (4, "5h"): (3.0, "$.m", "unknown"), (5, "5h"): (1.0, "$.z", "unknown")}
    assert [r.path for r in quota.top_matches(quota.quota_nodes(df.where("id = 4"), "id", "body")).orderBy("rank").collect()] == ["$.m", "$.z", "$.a", "$.m.credits"]
    assert len(set(quota.QUOTA_KEYS)) == 37


# -- batch and live delta events ---------------------------------------------------------------------------------------------------------


def series(spark, seq, plans=None, window="5h"):
    rows = []
    for i, x in enumerate(seq):
        percent, cost = x if x is not None else (None, 0.0)
        plan = plans[i] if plans else "unknown"
        rows.append(("a", window, f"2030-01-01T{i:02d}:00:00Z", i, None if percent is None else float(percent), plan, float(dims.PLAN_MULTIPLIERS[plan]), float(cost), None, x is None))
    df = spark.createDataFrame(rows, "account_id string, window string, checked_at string, seq long, used_percent double, plan string, multiplier double, cost double, reset_ts double, unavailable boolean")
    return [(r.delta_percent, round(r.delta_cost, 8)) for r in sorted(deltas.batch_series(df).collect(), key=lambda r: r.seq)]


def test_batch_series(spark):
    z = (0.0, 0.0)
    assert series(spark, [(5, 12), (5, 13), (8, 15)]) == [z, (3, 3)]
    assert series(spark, [(5, 12), None, (8, 18)]) == [z, z]
    assert series(spark, [(5, 12), (5, 13), (5, 14), (8, 16)]) == [z, (3, 4)]
    assert series(spark, [(99, 100), (100, 102), (100, 108), (101, 110)]) == [z, (1, 2), (1, 2)]
    assert series(spark, [(5, 12), (8, 15), (10, 18), (3, 21)]) == [z, (3, 3), (2, 3), (3, 3)]
    assert series(spark, [(3, 12), (4, 15), (5, 18)], ["pro_lite"] * 3) == [z, (5, 3)]
    assert series(spark, [(5, 8), (30, 12), (31, 15), (34, 18)], ["plus"] + ["pro_lite"] * 3) == [z, (15, 3)]
    assert series(spark, [(5, 10), (8, 10), (9, 11)]) == [z, (1, 1)]


def sample(seq, p5=None, cost=0.0, plan="unknown", reset=None, models=None, ready=True, identity="me", confirmed=None, p7=None):
    win = {}
    for label, p in (("5h", p5), ("7d", p7)):
        if p is not None:
            win[label] = {"unavailable": True} if p == "gone" else {"used_percent": p, "plan": plan, "multiplier": float(dims.PLAN_MULTIPLIERS[plan]), "reset": reset}
    return ("a", seq, f"2030-01-01T{seq:02d}:00:00Z", json.dumps(win), float(cost), json.dumps(models) if models else None, ready, identity, confirmed)


def live_rows(spark, samples, kind="event"):
    got = live.batch(spark.createDataFrame(samples, live.SAMPLE)).where(F.col("kind") == kind).collect()
    return sorted(got, key=lambda r: (r.seq, r.window, r.model or "", r.detail or ""))


def test_live_models_and_warning(spark):
    got = live_rows(spark, [sample(0, 10, 0, models={"a": 0.0, "b": 0.0}), sample(1, 12, 7, models={"a": 2.0, "b": 5.0})])
    assert [(round(r.delta_percent, 8), r.delta_cost) for r in got] == [(0.57142857, 2.0), (1.42857143, 5.0)]
    got = live_rows(spark, [sample(0, 0, 0), sample(1, 5, 5), sample(2, 6, 8)])
    assert [r.warning for r in got] == [False, True]


def test_live_rules(spark):
    pairs = lambda rows: [(r.window, r.delta_percent, round(r.delta_cost, 6)) for r in rows]
    reasons = lambda s: [r.detail for r in live_rows(spark, s, "special")]
    assert pairs(live_rows(spark, [sample(0, 5, 10, ready=False), sample(1, 6, 12, ready=False), sample(2, 7, 14)])) == [("5h", 1, 2)]
    assert pairs(live_rows(spark, [sample(0, 1, 0, "pro"), sample(1, 2, 5, "pro"), sample(2, 3, 9, "pro")])) == [("5h", 20, 4)]  # trusted: the first rise only rebases
    assert pairs(live_rows(spark, [sample(0, 99, 100), sample(1, 100, 102), sample(2, 100, 108), sample(3, 101, 110)])) == [("5h", 1, 2), ("5h", 1, 2)]
    day = 86400.0
    assert pairs(live_rows(spark, [sample(0, 24, 100, reset=day), sample(1, 6, 102, reset=2 * day), sample(2, 37, 103, reset=day)])) == [("5h", 13, 3)]
    back = [sample(0, 10, 100, reset=2 * day), sample(1, 15, 110, reset=day)]
    assert reasons(back) == ["baseline-initialized", "reset-time-moved-backward-discarded"]
    assert reasons([*back, sample(2, 16, 112, reset=day)])[-1] == "consistent-backward-reset-rebased"
    assert pairs(live_rows(spark, [*back, sample(2, 12, 104, reset=2 * day)])) == [("5h", 2, 4)]
    assert reasons([sample(0, 10, 1), sample(1, 12, 5, identity="you")]) == ["baseline-initialized", "account-switch"]
    assert reasons([sample(0, 10, 1), sample(1, 0, 5, confirmed="5h")]) == ["baseline-initialized", "manual-reset-confirmed"]
    assert reasons([sample(0, 10, 1), sample(1, 20, 1.01)])[-1] == "low-cost-delta-discarded"
    assert pairs(live_rows(spark, [sample(0, 5, 0, p7=5), sample(1, 5, 3, p7=6), sample(2, 8, 15, p7=6)])) == [("7d", 1, 3), ("5h", 3, 15)]
    assert live_rows(spark, [sample(0, 5, 0), sample(1, "gone", 2), sample(2, 9, 9)]) == []


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows, cost = [], 0.0
    for i in range(24):
        cost += rng.random()
        rows.append(sample(i, rng.randrange(0, 100), cost, models={"a": cost / 3, "b": cost / 2}, p7=rng.randrange(0, 50), reset=float(rng.randrange(5) * 3600)))
    df = spark.createDataFrame(rows, live.SAMPLE)
    for part in range(3):
        df.where(f"seq div 8 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stream(src).writeStream.format("memory").queryName("live_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows_of = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    assert rows_of(spark.table("live_out")) == rows_of(live.batch(df)) and spark.table("live_out").count() > 20


def test_admission_in_batch_and_stream(spark, tmp_path):
    t = 1893456000.0  # 2030-01-01
    rows = [
        sample(0, 10, 100, reset=t + 86400, p7=5),
        sample(1, 4, 102, reset=t + 2 * 86400, p7=6),  # rolled back, moved forward: 7d is not believed either
        sample(2, 4, 103, reset=t + 9 * 3600, p7=6),  # rolled back, moved backward
        sample(3, None, 104),  # both missing
        sample(4, 12, 106, reset=t + 86400, p7=7),
        sample(5, 1, 107, reset=t + 3 * 86400, p7=8, confirmed="5h"),
        sample(6, None, 108, identity="you"),
        sample(7, 0, 109, reset=t + 4 * 86400, p7=0, identity="you"),
    ]
    df = spark.createDataFrame(rows, live.SAMPLE)
    for part in range(4):
        df.where(f"seq div 2 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stream(src).writeStream.format("memory").queryName("live_admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    for got in (live.batch(df).collect(), spark.table("live_admitted").collect()):
        bad = {r.seq: r.reasons for r in got if r.detail == "bad-remote-usage-discarded" and (r.window, r.kind) == ("remote", "special")}
        assert bad == {
            1: "5h percent rolled back and reset moved forward before trusted reset time",
            2: "5h percent rolled back with an older reset time before trusted reset time",
            3: "both quota window percentages are missing",
            6: "identity changed without usable quota windows; both quota window percentages are missing",
        }
        assert sorted((r.seq, r.window, r.delta_percent, r.delta_cost) for r in got if r.kind == "event") == [(4, "5h", 2.0, 6.0), (4, "7d", 2.0, 6.0), (5, "7d", 1.0, 1.0)]
        assert sorted((r.seq, r.window) for r in got if r.detail == "account-switch") == [(7, "5h"), (7, "7d")]


def test_rejection_reasons_of_moved_resets(spark):
    rows = [("a", 1, "5h", 20.0, 50.0, 1000, 5000, 6000, 5000), ("a", 2, "5h", 20.0, 50.0, 1000, 5000, 4000, 3000), ("a", 3, "5h", None, 50.0, 1000, 5000, 5000, 4000), ("a", 3, "7d", 9.0, 9.0, 1000, 9000, 9000, 8000), ("a", 4, "5h", None, 50.0, 1000, 5000, 5000, 4000)]
    s = spark.createDataFrame(rows, "account_id string, seq long, window string, used_percent double, previous_percent double, checked_ts long, previous_reset_ts long, reset_ts long, reset_after_s long")
    assert {r.seq: r.reasons for r in live.rejection_reasons(s).collect()} == {1: ["rollback-forward"], 2: ["rollback-backward"], 3: [], 4: ["missing"]}


def test_rejection_and_confirmation(spark):
    s = spark.createDataFrame([("a", 1, "5h", 0.0, 50.0, 1000, 5000, 5000, 4000), ("a", 1, "7d", 10.0, 9.0, 1000, 9000, 9000, 8000), ("a", 2, "5h", 60.0, 50.0, 1000, 5000, 9000, 4000)], "account_id string, seq long, window string, used_percent double, previous_percent double, checked_ts long, previous_reset_ts long, reset_ts long, reset_after_s long")
    assert {r.seq: r.reasons for r in live.rejection_reasons(s).collect()} == {1: ["early-zero"], 2: ["reset-mismatch"]}
    r = spark.createDataFrame([(1, i + 1, float(p), 100, 5.0) for i, p in enumerate((3, 3, 4))] + [(2, i + 1, float(p), 100, 5.0) for i, p in enumerate((3, 50, 4, 3, 60))] + [(3, 1, 0.0, 0, 5.0)], "poll_id long, attempt long, percent double, reset_ts long, limit_percent double")
    assert {x.poll_id: x.confirmed for x in live.confirm_reset(r).collect()} == {1: True, 2: False, 3: True}
    a = spark.createDataFrame([(1, 1, 70.0, 10.0, 25.0), (1, 2, 71.0, 10.0, 25.0), (2, 1, 70.0, 10.0, 25.0), (2, 2, 10.0, 10.0, 25.0)], "poll_id long, attempt long, percent double, previous_percent double, threshold double")
    assert {x.poll_id: x.accepted for x in live.arbitrate(a).collect()} == {1: 2, 2: None}


# -- ledgers, runs, intervals ---------------------------------------------------------------------------------------------------------------


def test_grouped_events_round_trip(spark):
    rows = [json.dumps({"window": "5h", "delta": [{"checkedAt": "t", "deltaPercent": 2.0, "models": [{"model": "a", "deltaCostUsd": 2.0}, {"model": "b", "deltaCostUsd": 6.0}]}, [{"checkedAt": "u", "model": "c", "deltaPercent": 1.0, "deltaCostUsd": 3.0}]]}), json.dumps({"window": "7d", "events": [{"checkedAt": "v", "model": "d", "deltaPercent": 3.0, "deltaCostUsd": 0.0}]})]
    e = deltas.expand_grouped(spark.createDataFrame([(r,) for r in rows], "value string"))
    got = sorted((r.window, r.checkedAt, r.model, r.deltaPercent, r.deltaCostUsd) for r in e.collect())
    assert got == [("5h", "t", "a", 0.5, 2.0), ("5h", "t", "b", 1.5, 6.0), ("5h", "u", "c", 1.0, 3.0), ("7d", "v", "d", 3.0, 0.0)]
    packed = {(r.window, r.checkedAt): (r.form, r.deltaPercent) for r in deltas.pack_models(e.na.fill("x")).collect()}
    assert packed["5h", "t"] == ("models", 2.0) and packed["5h", "u"] == ("list", 1.0)
    led = deltas.ledger(e.withColumn("seq", F.monotonically_increasing_id()), ["window"], "model", ["checkedAt", "model"], "deltaPercent", "deltaCostUsd")
    assert led.where("window = '7d'").count() == 0  # cost too low
    assert deltas.zero_rows(spark, led.withColumnRenamed("deltaPercent", "delta_percent").withColumnRenamed("deltaCostUsd", "delta_cost")).where("synthetic").count() == 2


def test_plateaus(spark):
    rows = [("a", i, p, 1000 + 20 * i) for i, p in enumerate((5, 5, 5, 5, 5, 6))] + [("b", i, 1, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "acct string, at long, used long, reset long")
    key, order = ["acct"], ["at"]
    prev = lambda c: reconcile.previous(c, key, order)
    kept = reconcile.run_ends(df, key, order, (F.col("used") == prev("used")) & (F.abs(F.col("reset") - prev("reset")) <= 60))
    assert sorted((r.acct, r["at"]) for r in kept.collect()) == [("a", 0), ("a", 4), ("a", 5), ("b", 0), ("b", 2)]
    anchored = reconcile.anchored_run_ends(df, key, order, ["used"], "reset", 60)
    assert sorted((r.acct, r["at"]) for r in anchored.collect()) == [("a", 0), ("a", 3), ("a", 4), ("a", 5), ("b", 0), ("b", 2)]


def test_anchored_clusters(spark):
    df = spark.createDataFrame([("k", x) for x in (175, 50, 0, 100, None)], "key string, reset long")
    assert sorted(r.anchor for r in reconcile.anchors(df, ["key"], "reset").collect()) == [0, 100, 175]
    assert {r.reset: r.cycle for r in reconcile.with_cycle(df, ["key"], "reset").collect()} == {0: 0, 50: 0, 100: 100, 175: 175, None: None}


def intervals(spark, rows):
    return spark.createDataFrame([("g", i, s, c, "acc", float(a), float(b), {"m": float(usd)}) for i, (a, b, usd, s, c) in enumerate(rows)], "g string, seq long, started_at string, checked_at string, account_id string, start_percent double, end_percent double, models map<string,double>")


def test_sweep(spark):
    two = reconcile.interval_events(intervals(spark, [(0, 1, 1, "00:00", "00:02"), (0, 1, 1, "00:00", "00:01")]), ["g"]).collect()
    assert [(r.delta_percent, near(r.delta_cost, 2), r.checked_at) for r in two] == [(1.0, True, "00:01")]
    rows = [(0, 2, 2, "00:00", "00:03"), (0, 1, 1, "00:00", "00:02"), (1, 2, 1, "00:02", "00:04")]
    for order in (rows, rows[::-1]):
        got = sorted(reconcile.interval_events(intervals(spark, order), ["g"]).collect(), key=lambda r: r.checked_at)
        assert [(r.checked_at, r.delta_percent, round(r.delta_cost, 6)) for r in got] == [("00:02", 1.0, 2.0), ("00:03", 1.0, 2.0)]
    many = reconcile.interval_events(intervals(spark, [(2 * i, 2 * i + 1, 1, "a", "b") for i in range(1000)]), ["g"])
    assert many.count() == 1000


def test_reset_clusters_of_intervals(spark):
    costs_ = [(0, 0.006), (50, 0.007), (100, 0.02)]
    for order in (costs_, costs_[::-1]):
        df = spark.createDataFrame([("g", r, i, "x", "y", "acc", 0.0, 1.0, {"m": c}) for i, (r, c) in enumerate(order)], "g string, reset long, seq long, started_at string, checked_at string, account_id string, start_percent double, end_percent double, models map<string,double>")
        out = reconcile.interval_events(reconcile.with_cycle(df, ["g"], "reset"), ["g", "cycle"])
        assert sorted(round(r.delta_cost, 6) for r in out.collect()) == [0.013, 0.02]


# -- merges, attribution, change data --------------------------------------------------------------------------------------------------------


def test_sticky_and_as_of(spark):
    s = spark.createDataFrame([("k", 5), ("k", 1), ("k", None), ("z", 3)], "key string, at long")
    t = spark.createDataFrame([("k", 2, 1, "old"), ("k", 4, 2, "x"), ("k", 4, 3, "new"), ("k", 9, 4, "late")], "key string, at long, seq long, acct string")
    got = {(r.key, r["at"]): r.acct for r in attribution.as_of(s, t, ["key"], "at", "at", ["seq"], ["acct"]).collect()}
    assert got == {("k", 5): "new", ("k", 1): None, ("k", None): None, ("z", 3): None}
    assert attribution.relabel(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, label string"), "id", "label", {"a": "new"}).orderBy("id").collect() == [("a", "new"), ("b", "y")]


def test_replay_and_batches(spark):
    base = spark.createDataFrame([("a", 1, "m1"), ("b", 2, "m2")], "key string, v long, origin string")
    ops = spark.createDataFrame([("a", None, None, "delete", 1), ("c", 3, "m1", "upsert", 2), ("a", 9, "m1", "upsert", 3)], "key string, v long, origin string, action string, seq long")
    assert sorted(map(tuple, journal.replay(base, ops, ["key"], "seq").collect())) == [("a", 9, "m1"), ("b", 2, "m2"), ("c", 3, "m1")]
    reset = spark.createDataFrame([("m2",)], "origin string")
    assert sorted(r.key for r in journal.replay(base, ops, ["key"], "seq", reset=reset).collect()) == ["a", "c"]


def test_publish_republish_and_add(spark, tmp_path):
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, body string")
    path = str(tmp_path / "journal")
    assert journal.publish(one, path, "m", ["key"], ["body"]) == 2
    assert journal.publish(one, path, "m", ["key"], ["body"]) == 0
    two = spark.createDataFrame([("a", "1"), ("c", "3")], "key string, body string")
    assert journal.publish(two, path, "m", ["key"], ["body"]) == 2
    assert sorted(map(tuple, journal.read_journal(spark, path, "m").select("key", "body").collect())) == [("a", "1"), ("c", "3")]
    assert journal.should_compact(128, 100, 100, 150) and not journal.should_compact(127, 100, 100, 10)


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(f"2030-01-{d:02d}", i, "x" * 10) for d in range(1, 5) for i in range(10)], "day string, seq long, body string")
    kept = sinks.newest_suffix(log, ["day", "seq"], F.lit(9), 150).collect()
    assert sorted((r.day, r.seq) for r in kept) == [("2030-01-03", s) for s in range(5, 10)] + [("2030-01-04", s) for s in range(10)]
    assert sinks.capped_append(spark, log, log, ["day", "seq"], 10**6).count() == 80
    v = sinks.commit_tables(spark, str(tmp_path / "store"), {"a": log, "b": log.limit(1)})
    assert v and {n: d.count() for n, d in sinks.read_tables(spark, str(tmp_path / "store"), ["a", "b"]).items()} == {"a": 40, "b": 1}
    key, head = F.lit("0123456789abcdef").cast("binary"), F.lit("h").cast("binary")
    env = spark.range(1).select(sinks.seal(F.lit("secret").cast("binary"), key, head).alias("e"))
    assert bytes(env.select(sinks.unseal(F.col("e"), key)).first()[0]) == b"secret"
    bad = env.select(F.struct("e.sealed", F.lit("x").cast("binary").alias("header"), "e.size", "e.sha256").alias("e"))
    assert bad.select(sinks.unseal(F.col("e"), key)).first()[0] is None


def test_manifest_and_packages(spark, tmp_path):
    (tmp_path / "t/s").mkdir(parents=True)
    (tmp_path / "t/a.txt").write_text("one")
    (tmp_path / "t/s/b.txt").write_text("two")
    m = files.manifest(spark, str(tmp_path / "t")).cache()
    assert m.count() == 2 and files.changed_files(m, m).count() == 0 and files.changed_files(m, m.limit(1)).count() == 1
    with pytest.raises(ValueError):
        files.manifest(spark, str(tmp_path / "t"), max_files=1)
    with zipfile.ZipFile(tmp_path / "p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.txt", "fine")
        z.writestr("../up.txt", "x")
        z.writestr("big.txt", "0" * 2 * 10**6)
        z.writestr("small.txt", "0" * 10**6)
    got = {r.entry: r.problem for r in files.zip_entries(spark.read.format("binaryFile").load(str(tmp_path / "p.zip"))).collect()}
    assert got == {"ok.txt": None, "../up.txt": "unsafe path", "big.txt": "expansion", "small.txt": None}
    import hashlib

    entry = lambda path, text: {"path": path, "size": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()}
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"version": 1, "skills": {"a": [entry("SKILL.md", "x"), entry("changed", "y"), entry("gone", "z")], "b": [entry("c", "c")]}}))
        for name, text in (("skills/a/SKILL.md", "x"), ("skills/a/changed", "Y"), ("skills/b/c", "c"), ("skills/b/more", "m")):
            z.writestr(name, text)
    read = lambda name: {r.entry: r.problem for r in files.zip_entries(spark.read.format("binaryFile").load(str(tmp_path / name)), with_manifest=True).collect()}
    assert read("m.zip") == {"manifest.json": None, "skills/a/SKILL.md": None, "skills/a/changed": "differs", "skills/a/gone": "missing", "skills/b/SKILL.md": "missing", "skills/b/c": None, "skills/b/more": "unexpected"}
    assert read("p.zip") == {"manifest.json": "no manifest"}


def test_serving(spark):
    d = spark.createDataFrame([(1, '{"accessToken":"abc","ok":"x","password":true,"n":{"apiKey":"q"}}')], "id long, body string")
    assert json.loads(serving.redact(d, "body").first().body) == {"accessToken": "***", "ok": "x", "password": True, "n": {"apiKey": "***"}}
    p = spark.createDataFrame([("s", i, float(i), 0.0) for i in range(50)], "s string, i long, x double, y double")
    assert sorted(r.i for r in serving.dense_merge(p, ["s"], ["i"], "x", "y", 1.0, 1.0).collect()) == [0, 21, 42, 49]
    w = spark.createDataFrame([("5h", 42.25, 3600, 0, None), ("7d", 61.0, 60480, 67, 0)], "window string, used_percent double, reset_ts long, checked_ts long, percent_ts long")
    got = {r.window: r for r in serving.window_line(w, F.lit(67)).collect()}
    assert got["7d"].display == "7d 61.0%" and got["7d"].age_s == 67


def test_samples_are_keyed_by_user(spark):
    sf = "/root/testdata/sf0.001"
    s = queries._samples(spark, sf)
    users = queries.ev(spark, sf).agg(F.count_distinct("user_id")).first()[0]
    assert s.select("account_id").distinct().count() == users > 5
    last = s.select("cost", F.from_json("cost_by_model", "map<string,double>").alias("m")).collect()
    assert all(abs(sum(r.m.values()) - r.cost) < 1e-6 for r in last) and max(len(r.m) for r in last) > 1
    events = queries.QUERIES["q_live_batch"](spark, sf).where("kind = 'event'")
    assert events.select("model").distinct().count() > 1


def test_entry_and_queries_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_incremental_scan_equals_rebuild(spark, tmp_path):
    from usagelake.sources.incremental import refresh

    home, store = tmp_path / "home", str(tmp_path / "store")
    rows = lambda d: sorted((r.event_id, r.input) for r in d.select("event_id", "input").collect())
    put = lambda name, *lines: ((home / "sessions").mkdir(parents=True, exist_ok=True), (home / "sessions" / name).write_text("\n".join(lines) + "\n"))
    a, b = [usage({"input_tokens": 10}), usage({"input_tokens": 30})], [usage({"input_tokens": 5})]
    put("a.jsonl", *a)
    put("b.jsonl", *b)
    assert rows(refresh(spark, str(home), store, 0)) == [("a:1", 10), ("a:2", 20), ("b:1", 5)]
    put("a.jsonl", *a, usage({"input_tokens": 31}))
    assert rows(refresh(spark, str(home), store, 1)) == [("a:1", 10), ("a:2", 20), ("a:3", 1), ("b:1", 5)]
    (home / "sessions/b.jsonl").unlink()
    put("a.jsonl", usage({"input_tokens": 7}))
    assert rows(refresh(spark, str(home), store, 2)) == [("a:1", 7)]
    assert rows(refresh(spark, str(home), store, 3)) == [("a:1", 7)]


def test_only_appended_bytes_are_read(spark, tmp_path, monkeypatch):
    from usagelake.sources import incremental

    monkeypatch.setattr(incremental, "RANGE", 300)
    home, store = tmp_path / "home", str(tmp_path / "store")
    (home / "sessions").mkdir(parents=True)
    log = home / "sessions/a.jsonl"
    rows = lambda d: sorted((r.event_id, r.input) for r in d.select("event_id", "input").collect())
    lines = lambda v: [(r.pos, r.text) for r in spark.read.parquet(f"{store}/v{v}/lines").where("text is not null").orderBy("pos").collect()]
    data = "".join(usage({"input_tokens": 10 * i}) + "\r\n" * (i % 2) + "\n" * (1 - i % 2) for i in range(1, 9))
    last = usage({"input_tokens": 100})
    log.write_text(data + last[:50], newline="")
    assert [x for _, x in rows(incremental.refresh(spark, str(home), store, 0))] == [10] * 8 and len(lines(0)) == 8
    log.write_text(data + last, newline="")  # the last line is whole now, though without an end
    assert len(rows(incremental.refresh(spark, str(home), store, 1))) == 9
    assert lines(1) == [(len(data), last)]
    with log.open("ab") as f:
        f.write(b"\n" + usage({"input_tokens": 101}).encode().replace(b"token_count", b"token_count\", \"x\": \"\xff") + b"\n" + usage({"input_tokens": 130}).encode() + b"\n")
    got = rows(incremental.refresh(spark, str(home), store, 2))
    assert len(got) == 10 and len(lines(2)) == 2  # the last line anew, and one more; one that is not UTF-8 is none
    assert got == rows(files.token_events(files.session_files(spark, str(home))))
    assert got == rows(incremental.refresh(spark, str(home), store, 3)) and lines(3) == []
    log.write_text(usage({"input_tokens": 7}) + "\n" + data + data)  # longer, but another file
    assert rows(incremental.refresh(spark, str(home), store, 4)) == rows(files.token_events(files.session_files(spark, str(home)))) and len(lines(4)) == 17


def test_lines_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    bad = usage({"input_tokens": 10}).encode().replace(b"token_count", b"token_count\", \"x\": \"\xff")
    (tmp_path / "sessions/a.jsonl").write_bytes(bad + b"\n" + usage({"input_tokens": 12}).encode() + b"\n")
    assert [r.input for r in files.token_events(files.session_files(spark, str(tmp_path))).collect()] == [12]


def test_journal_compaction(spark, tmp_path):
    path = str(tmp_path / "j")
    for rows in ([("a", "1")], [("a", "2"), ("b", "1")], [("b", "1")]):
        journal.publish(spark.createDataFrame(rows, "key string, body string"), path, "m", ["key"], ["body"])
    before = sorted(map(tuple, journal.read_journal(spark, path, "m").select("key", "body").collect()))
    journal.compact(spark, path, "m")
    assert sorted(map(tuple, journal.read_journal(spark, path, "m").select("key", "body").collect())) == before == [("b", "1")]
    assert journal.publish(spark.createDataFrame([("b", "1"), ("c", "1")], "key string, body string"), path, "m", ["key"], ["body"]) == 1


def test_delete_between_two_compactions(spark, tmp_path):
    path = str(tmp_path / "j")
    of = lambda *keys: spark.createDataFrame([(k, "1") for k in keys], "key string, body string")
    rows = lambda: sorted(r.key for r in journal.read_journal(spark, path, "m").collect())
    journal.publish(of("x", "y"), path, "m", ["key"], ["body"])
    journal.compact(spark, path, "m")
    journal.publish(of("y"), path, "m", ["key"], ["body"])
    for _ in range(2):  # the second time there is nothing to do
        journal.compact(spark, path, "m")
        assert rows() == ["y"]
    assert len(list((tmp_path / "j/machine=m/data").iterdir())) == len(list((tmp_path / "j/machine=m/links").iterdir())) == 1
    assert journal.publish(of("y", "z"), path, "m", ["key"], ["body"]) == 1 and rows() == ["y", "z"]


def test_dispatch_and_live_sink(spark, tmp_path):
    cols = "kind string, window string, cycle long, seq long, started_at string, checked_at string, account_id string, start_percent double, end_percent double, models map<string,double>, model string, delta_percent double, delta_cost double"
    rows = spark.createDataFrame([("interval", "5h", 0, 0, "a", "b", "x", 0.0, 1.0, {"m": 2.0}, None, None, None), ("delta", "7d", None, 1, None, "c", "x", None, None, None, "n", 1.0, 3.0)], cols)
    assert sorted((r.window, r.delta_cost) for r in deltas.derive_events(spark, rows).collect()) == [("5h", 2.0), ("7d", 3.0)]
    assert deltas.derive_events(spark, rows.where("kind = 'delta'")).count() == 1
    df = spark.createDataFrame([sample(0, 5, 0), sample(1, 8, 4)], live.SAMPLE)
    df.write.parquet(str(tmp_path / "in"))
    q = live.run(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), None)
    q.awaitTermination(60)
    got = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert got.where("kind = 'event'").select("delta_percent").collect() == [(3.0,)]
    assert live.fresh_start({"identity": "x", "5h": {"percent": 3}}, {"5h": [1.0, 2.0]}) == {"identity": "x", "5h": {"sum": [1.0, 2.0]}, "7d": {"sum": [0.0, 0.0]}}


def test_json_poll(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from usagelake.sources.poll import JsonPoll

    hits = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            hits["n"] += 1
            bad = self.path == "/bad" or hits["n"] == 1  # the first answer is an error, too
            self.send_response(500 if bad else 200)
            self.end_headers()
            self.wfile.write(b'{"used": 1}')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(JsonPoll)
    got = {r.url: r for r in spark.read.format("json_poll").option("url", f"{url}/ok,{url}/bad").option("pause", "0.01").load().collect()}
    assert json.loads(got[f"{url}/ok"].body) == {"used": 1} and got[f"{url}/bad"].error == "HTTP 500" and got[f"{url}/bad"].body is None
    q = spark.readStream.format("json_poll").option("url", f"{url}/ok").load().writeStream.format("memory").queryName("polls").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(200):
        if spark.table("polls").count() >= 2:
            break
        __import__("time").sleep(0.1)
    q.stop()
    server.shutdown()
    assert [r.poll for r in spark.table("polls").orderBy("poll").limit(2).collect()] == [0, 1]


def test_projections_and_views(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(Z.event_cost(F.lit(a), F.lit(b))) for a, b in ((1.5, 2.0), (float("nan"), 2.0))] == [1.5, 2.0] and one(Z.event_cost(F.lit(None), F.lit("x"))) == 0.0
    m = lambda d: F.lit(None).cast("map<string,double>") if d is None else F.from_json(F.lit(json.dumps(d)), "map<string,double>")
    assert one(Z.event_cost_by_model(m({"a": 1.0}), m(None), F.lit(1.0), "d")) == {"a": 1.0}
    assert one(Z.event_cost_by_model(m({}), m({"b": 2.0}), F.lit(1.0), "d")) == {"b": 2.0}
    assert one(Z.event_cost_by_model(m(None), m(None), F.lit(1.0), "d")) == {"d": 1.0}
    nodes = quota.json_nodes(spark.createDataFrame([(1, '{"a":{"used_percent":130,"x":1}}')], "id long, body string"), "id", "body")
    got = {r.path: r for r in quota.node_summary(nodes).collect()}
    assert got["$.a"].summary == {"used_percent": "130"} and got["$.a"].remaining_percent == 0.0
    cols = "account_id string, account_slot string, session_id string, updated_ts long, total_tokens long, content_hash string, origin string"
    local = spark.createDataFrame([("x", "s", "1", 5, 100, "a", "me"), (None, "s", "2", 1, 1, "b", "me")], cols)
    cache = spark.createDataFrame([("x", "t", "1", 6, 90, "c", "you"), ("x", "t", "1", 6, 120, "d", "you"), ("x", "t", "9", 6, 1, "e", "me")], cols)
    assert sorted((r.account_key, r.session_id, r.total_tokens) for r in reconcile.merged_view(local, cache, "me").collect()) == [("local:s", "2", 1), ("x", "1", 120)]
    q = spark.createDataFrame([(None, "z", "a"), (1, "b", "a"), (1, "a", "b")], "checked_ts long, checked_at string, account_slot string")
    assert [r.checked_at for r in q.orderBy(*reconcile.quota_order()).collect()] == ["a", "b", "z"]


# -- projections, orders and small rules --------------------------------------------------------------------------------------------


def test_samples_states_and_costs(spark):
    from usagelake.plans import projections

    cols = "account string, seq int, checked_at string, percent_checked_at string, endpoint string, status int, windows string, errors string, using_previous boolean, cost double, cost_by_model map<string,double>, account_slot_id string, account_label string, " + ", ".join(f"{c} long" for c in projections.COUNTS)
    row = lambda seq, n, cost, models, slot="s", label=None: ("a", seq, f"t{seq}", None, "e", 200, "w", "{}", None, cost, models, slot, label, *[n] * 7)
    r = spark.createDataFrame([row(1, 10, 1.0, {"x": 1.0}), row(2, 15, 3.0, {"x": 1.5, "y": 1.5}), row(3, 12, None, None), row(4, 20, 4.0, {"y": 4.0}, None), row(5, 21, 5.0, {"y": 5.0}, "s", "L")], cols)
    s = projections.make_samples(r, ["account"], ["seq"])
    got = s.orderBy("seq").collect()
    assert [(x.delta_input, x.cost_delta) for x in got] == [(0, 1.0), (5, 2.0), (0, 0.0), (8, 4.0), (1, 1.0)]
    assert got[1].cost_delta_by_model == {"x": 0.5, "y": 1.5} and got[2].cost_delta_by_model == {"x": 0.0, "y": 0.0} and got[3].cost_delta_by_model == {"y": 4.0}
    assert [x.account_label for x in got] == ["Unknown", "Unknown", "Unknown", None, "L"]
    m = projections.measured_costs(s, ["account"], ["seq"]).orderBy("seq").collect()
    assert [(x.event_cost, x.event_cost_ready) for x in m] == [(0.0, False), (2.0, False), (2.0, False), (6.0, True), (7.0, True)]
    assert m[4].event_cost_by_model == {"x": 0.5, "y": 6.5}
    c = projections.compact_samples(s).orderBy("checked_at").collect()
    assert c[0].percent_checked_at == "t1" and c[0].using_previous is False and c[2].cost == 0.0 and c[1].token_delta.fresh == 0 and c[1].token_delta.cached == 5
    states = spark.createDataFrame([("w", 1.123456789, {"x": 0.987654321}, "secret", "t")], "windows string, run_cost double, run_cost_by_model map<string,double>, raw string, token_usage string")
    assert projections.compact_states(states).first() == ("w", "t", 1.12345679, {"x": 0.98765432})
    assert projections.compact_states(states, debug=True).columns == ["windows", "run_cost", "run_cost_by_model"]


def test_shown_statuses(spark):
    from usagelake.plans import projections

    a = spark.createDataFrame([("1", None, True, "password x failed", "hi", [("1", "L", True, True, "ok", "/private")])], "active_account_id string, awaiting_login boolean, cloud_binding_enabled boolean, error string, message string, items array<struct<id:string,label:string,ready:boolean,active:boolean,cloud_state:string,path:string>>")
    r = projections.account_status(a).first()
    assert (r.awaiting_login, r.error, r.message) == (False, "Account operation failed", "hi") and r["items"][0].asDict() == {"id": "1", "label": "L", "ready": True, "active": True, "cloud_state": "ok"}
    k = spark.createDataFrame([(1, [("n", None, {"app": ("linked", "/p")}, {"app": "boom"})])], "version int, items array<struct<name:string,assignments:map<string,boolean>,projections:map<string,struct<state:string,path:string>>,errors:map<string,string>>>")
    i = projections.skill_status(k).first()["items"][0]
    assert i.assignments == {} and i.projections["app"].asDict() == {"state": "linked"} and i.errors == {"app": "Projection error"}
    c = spark.createDataFrame([(True, None, None, None, None, True, "x", None, None, "secret", None, 5, "y")], "enabled boolean, skills_auto_upload boolean, usage_data_auto_sync boolean, allow_optimistic_writes boolean, conditional_writes_verified boolean, optimistic_writes_active boolean, error string, upload_pending boolean, upload_attempts int, upload_failure string, last_success_at string, next_attempt_in_seconds int, sync_failure string")
    s = projections.cloud_status(c).first()
    assert (s.conditional_writes_verified, s.optimistic_writes_active, s.error, s.upload_attempts, s.upload_failure, s.sync_failure) == (False, True, "Cloud configuration error", 0, "Automatic skill upload failed", "Automatic usage synchronization failed")


def test_console_text(spark):
    from usagelake.plans import projections

    numbers = [0.0, 1.0, 2.5, 0.1234567, 123456.7, 1234567.0, 0.00001234, 9.99996, 99999.6, -3.25, 1e-4, 1e10]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", Z.significant(F.col("x"), 4).alias("a"), Z.significant(F.col("x"), 6).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(f"{x:.4g}", f"{x:.6g}") for x in numbers]
    e = spark.createDataFrame([("t", "5h", "m", 2.5, 0.125, 0.05, 12.0, 1.5, None, 5.0, 0.01, 5.0, True), (None, "7d", None, 1.0, 1.0, 1.0, 1.0, 1.0, "pro", None, None, None, False)], "checked_at string, window string, model string, delta_percent double, delta_cost double, cost_percent_ratio double, cumulative_percent double, cumulative_cost double, plan string, multiplier double, average_ratio double, ratio_deviation double, ratio_deviation_warning boolean")
    assert [r.line for r in projections.delta_text(e).collect()] == ["[delta] t 5h m +2.5% / +$0.125; ratio $0.05/%; cumulative 12% / $1.5; event plan unknown (5x)", "[delta] - 7d unknown +1% / +$1; ratio $1/%; cumulative 1% / $1; event plan pro (1x)"]
    assert [r.line for r in projections.warning_text(e).collect()] == ["[warning] t 5h m cost/percent ratio $0.05/% deviates from average $0.01/% (5x)"]
    s = spark.createDataFrame([("t", "5h", "account-switch", 5.0, None, None), ("t", "remote", "bad-remote-usage-discarded", None, None, "a; b")], "checked_at string, window string, reason string, previous_percent double, current_percent double, reasons string")
    assert [r.line for r in projections.special_text(s).collect()] == ["[event] t 5h account-switch; baseline 5% -> 5%", "[event] t remote bad-remote-usage-discarded; baseline - -> - reasons a; b"]


def test_redaction_and_labels_in_trees(spark):
    body = {"a": {"tokens": {"x": 1}, "keep": [{"email": "e", "n": 1}]}, "password": True, "encryptionPassphrase": "p", "accountSlotId": "s"}
    d = spark.createDataFrame([(json.dumps(body),), ("no json",), (None,)], "body string")
    got = [r.body for r in serving.redact(d, "body").collect()]
    assert json.loads(got[0]) == {"a": {"keep": [{"n": 1}]}, "password": True, "accountSlotId": "s"} and got[1:] == [None, None]
    rows = [{"accountSlotId": "s", "accountLabel": "old", "in": [{"accountSlotId": "s"}, {"accountSlotId": "t", "accountLabel": "old"}, {"accountSlotId": "s", "accountLabel": "new"}]}]
    r = attribution.relabel_trees(spark.createDataFrame([(json.dumps(rows),), ("x",)], "body string"), "body", "s", "new").collect()
    assert [x.changes for x in r] == [2, 0] and json.loads(r[0].body)[0]["in"][0]["accountLabel"] == "new" and json.loads(r[0].body)[0]["in"][1]["accountLabel"] == "old"


def test_rules_of_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(Z.before_reset(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((39, 100), (40, 100), (None, 100), (1, None))] == [True, False, False, False]
    assert one(Z.raw_reset_reason(F.lit(1000), F.lit(100), F.lit(900))) is None and "301" in one(Z.raw_reset_reason(F.lit(1000), F.lit(100), F.lit(599)))
    assert [one(Z.arbitration_threshold(F.lit(w), F.lit(m))) for w, m in (("5h", 1.0), ("7d", 1.0), ("7d", 20.0))] == [25.0, 10.0, 40.0]
    assert [one(Z.manual_reset_limit(F.lit(w), F.lit(p))) for w, p in (("5h", "plus"), ("7d", "plus"), ("5h", "pro"), ("5h", "unknown"))] == [5.0, 1.0, 1.0, None]
    assert [one(Z.needs_trusted_baseline(F.lit(w), F.lit(p))) for w, p in (("7d", "plus"), ("5h", "plus"), ("5h", "pro_lite"), ("7d", "unknown"))] == [True, False, True, False]
    assert len(one(Z.fingerprint(F.lit("a"), F.lit("b")))) == 20
    assert [one(Z.or_unknown(F.lit(x).cast("string"))) for x in ("a", "", None)] == ["a", "unknown", "unknown"]
    s = spark.createDataFrame([("b", None), ("a", 5), ("c", None)], "session_id string, updated_ts long")
    assert [r.session_id for r in s.orderBy(*Z.session_order()).collect()] == ["b", "c", "a"]
    who = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv)) if k else F.create_map().cast("map<string,string>")
    assert one(Z.remote_identity(who(email="e"), who(account_id="1", email="f"))).asDict() == {"user_id": None, "account_id": "1", "email": "e", "plan_type": None}
    assert one(Z.remote_identity(who(), who())) is None
    a, b = Z.remote_identity(who(email="e"), who()), Z.remote_identity(who(email="f"), who())
    assert [one(Z.identity_changed(x, y)) for x, y in ((a, b), (a, a), (F.lit(None), b))] == [True, False, False]
    deep = lambda n: "[" * n + "1" + "]" * n
    assert [one(journal.json_depth(F.lit(t))) for t in ("1", '{"a":"[[["}', '{"a\\"[":[{}]}', deep(12), deep(13), "[" * 13 + "]" * 13)] == [0, 1, 2, 12, 13, 12]


def test_history_rows_and_views(spark):
    w = spark.createDataFrame([(None, 5.0, False, "PRO"), ("", None, False, "x"), ("a", 7.0, True, "x"), ("a", 8.0, None, None)], "account_id string, used_percent double, unavailable boolean, plan string")
    assert sorted(map(tuple, quota.history_rows(w).select("account_id", "used_percent", "plan").collect())) == [("a", 8.0, "unknown"), ("unknown", 5.0, "pro")]
    s = spark.createDataFrame([("c", "p", True, "w", None), ("c", "p", True, "w", "r"), ("c", "p", False, "w", None), ("c", None, None, "w", None)], "checked_at string, percent_checked_at string, using_previous boolean, windows string, rejected_windows string")
    assert sorted(map(tuple, quota.accepted_samples(s).select("checked_at", "windows").collect())) == [("c", "r"), ("c", "w"), ("p", "w")]
    n = spark.createDataFrame([(1, i) for i in range(1, 12)], "id int, rank int")
    assert quota.top_matches(n).count() == 8
    r = spark.createDataFrame([("me", False, "L"), ("me", True, "L"), ("you", None, "L"), (None, None, "L")], "origin string, local_only boolean, account_label string")
    assert reconcile.own_records(r, "me").collect() == [("me", False)]
    own, foreign = journal.split_origin(r, "me")
    assert (own.count(), foreign.count()) == (3, 1)
    assert serving.account_filter(r, ["me"], "origin").count() == 2 and serving.account_filter(r, []).count() == 4
    assert serving.due(spark.createDataFrame([(5,), (3,)], "last_poll_ts long")).first().next_due == 603
    f = spark.createDataFrame([('{"sample": {"a": 1}}',), ('{"b": 2}',)], "value string")
    assert [json.loads(x.value) for x in files.sample_backfill(f).collect()] == [{"a": 1}, {"b": 2}]
    e = spark.createDataFrame([("2030-01-01 23:30:00", False), ("2030-01-02 00:00:00", False), (None, True), ("2030-01-03 00:00:00", None)], "t string, synthetic boolean").withColumn("ts", F.to_timestamp("t"))
    on = lambda day, zone="UTC": sorted((x.t or "") for x in serving.on_day(e, "ts", day, zone).collect())
    assert on("2030-01-02") == ["", "2030-01-02 00:00:00"] and on("2030-01-02", "Europe/Berlin") == ["", "2030-01-01 23:30:00", "2030-01-02 00:00:00"] and on("2030-01-09") == []


def test_days_are_local_whatever_the_sessions_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    e = spark.createDataFrame([(1704085200 + 3600 * h, h) for h in range(-30, 30)], "s long, h int").select("h", F.timestamp_seconds("s").alias("ts"), F.lit(False).alias("synthetic"))
    try:
        for own in ("America/New_York", "UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", own)  # 1704085200 is midnight of 2024-01-01 in New York
            assert sorted(r.h for r in serving.on_day(e, "ts", "2024-01-01", "America/New_York").collect()) == list(range(24))
            assert sorted(r.h for r in serving.on_day(e, "ts", "2024-01-01", "UTC").collect()) == list(range(-5, 19))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_splits_of_models(spark):
    of = lambda *items: deltas.expand_grouped(spark.createDataFrame([(json.dumps({"window": "5h", "delta": list(items)}),)], "value string"))
    got = lambda *items: sorted((r.model, r.deltaPercent, r.deltaCostUsd) for r in of(*items).collect())
    split = {"deltaPercent": 3, "models": [{"model": "a", "deltaCostUsd": 1}, {"model": "b"}, {"model": "c", "deltaCostUsd": "2"}]}
    assert got(split) == [("a", 1.0, 1.0), ("c", 2.0, 2.0)]
    assert got({"deltaPercent": 1, "models": [{"model": m, "deltaCostUsd": 1} for m in "abc"]}) == [("a", 0.33333333, 1.0), ("b", 0.33333333, 1.0), ("c", 0.33333333, 1.0)]
    inner = {"model": "x", "deltaPercent": 5, "deltaCostUsd": 6}
    assert got([inner | split, inner | {"model": "y"}]) == [("x", 3.0, 6.0), ("y", 5.0, 6.0)]  # in a list an event is what it says of itself
    assert got({"models": [{"model": "a", "deltaCostUsd": 1}]}, {"deltaPercent": 1, "models": []}, {"deltaPercent": 1, "models": [{"model": "a", "deltaCostUsd": 0}]}, 7, None) == []


def test_grouped_history_by_account_and_day(spark):
    e = spark.createDataFrame([("5h", f"2030-01-0{1 + i % 2}T0{i}", "m", "s" if i < 4 else "t", "L", 1.0, float(i)) for i in range(6)], "window string, checkedAt string, model string, accountSlotId string, accountLabel string, deltaPercent double, deltaCostUsd double")
    g = sinks.grouped_history(e)
    assert g.count() == 4
    assert sorted(r.deltaCostUsd for r in deltas.expand_grouped(g.select("value")).collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]


def test_fold_keeps_whole_numbers(spark):
    big = 2**53 + 1
    d = spark.createDataFrame([("a", 1, big, None), ("a", 2, None, 3)], "key string, n int, x long, size int").withColumn("size", F.lit(1))
    assert [(r.x, r.batch) for r in journal.batches(d, ["key"], ["n"], "size", 1, 10).collect()] == [(big, 0), (None, 1)]


def test_publication_conflicts_and_chunks(spark, tmp_path):
    path = str(tmp_path / "j")
    of = lambda n: spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("body"))
    assert journal.publish(of(1300), path, "m", ["key"], ["body"], expected=-1) == 1300
    first = spark.read.parquet(f"{path}/machine=m/data")
    assert first.groupBy("lane", "batch").count().agg(F.max("count"), F.count("*")).first() == (500, 3)
    with pytest.raises(journal.Conflict):
        journal.publish(of(5), path, "m", ["key"], ["body"], expected=3)
    assert journal.publish(of(0), path, "m", ["key"], ["body"], expected=0) == 1300
    journal.compact(spark, path, "m")
    assert journal.read_journal(spark, path, "m").count() == 0 and journal.head(spark, path, "m") == 1
    assert journal.publish(of(2), path, "m", ["key"], ["body"], expected=1) == 2 and journal.read_journal(spark, path, "m").count() == 2


def test_idle_state_goes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out = live.stream(spark.readStream.schema(live.SAMPLE).json(str(src)), retain_days=30)
    assert out.isStreaming and out.columns[0] == "account_id"


def test_history_scans(spark, tmp_path):
    from usagelake.sources import histories

    pretty = lambda *rows: "\n".join(json.dumps(r, indent=1) for r in rows)
    event = {"checkedAt": "t1", "window": "7d", "model": "m", "deltaPercent": 1.0, "deltaCostUsd": 2.0}
    (tmp_path / "delta.json").write_text(pretty({"window": "5h", "delta": [event | {"accountSlotId": "s", "accountLabel": "L"}, [event]]}, event))
    got = sorted((r.window, r.accountSlotId, r.accountLabel, r.deltaCostUsd) for r in histories.delta_history(spark, str(tmp_path / "delta.json")).collect())
    assert got == [("5h", "s", "L", 2.0), ("5h", "unknown", "Unknown", 2.0), ("7d", "unknown", "Unknown", 2.0)]
    q = lambda at, five, **more: {"checkedAt": at, "windows": {"5h": five, "7d": {"usedPercent": 50, "plan": "PRO", "unavailable": True}}, **more}
    (tmp_path / "quota.jsonl").write_text("\n".join(map(json.dumps, [q("a", {"usedPercent": "12", "resetAt": "r", "plan": "pro lite"}), q("b", {"usedPercent": None}), q("", {"usedPercent": 1})])) + "\nbroken {\n")
    assert [tuple(r) for r in histories.quota_history(spark, str(tmp_path / "quota.jsonl")).collect()] == [("a", "unknown", "Unknown", "5h", 12.0, "r", "pro_lite")]
    s = [{"sample": q("a", {"usedPercent": 1}, percentCheckedAt="p")}, q("b", {"usedPercent": 2}, usingPreviousWindows=True), q("c", {"usedPercent": 3}, usingPreviousWindows=True, rejectedWindows={"5h": {"usedPercent": 88}}), q("d", {"usedPercent": 4}, remoteUsage={"accepted": False})]
    (tmp_path / "samples.jsonl").write_text("\n".join(map(json.dumps, s)))
    assert sorted((r.checked_at, r.used_percent) for r in histories.quota_history(spark, str(tmp_path / "samples.jsonl"), samples=True).collect()) == [("c", 88.0), ("p", 1.0)]
    old = {"inputTokens": 100, "freshInputTokens": 80, "cachedInputTokens": 20, "outputTokens": 10, "cachedOutputTokens": 30, "requests": 1}
    many = [{"sessionId": "1", "startedAt": "x", "tokens": old, "byModel": {"gpt-5.6-sol": {"tokens": old, "fastTokens": {"inputTokens": 4}}, "no": 1}}, {"sessionId": "2", "tokens": {}, "cost": {"totalCostUsd": 7}}, {"sessionId": "", "tokens": {}}, {"sessionId": "3", "byModel": {"m": {"tokens": old}}}, {"sessionId": "4", "tokens": [1]}]
    (tmp_path / "tokens.json").write_text(pretty(*many))
    r = {x.session_id: x for x in histories.token_sessions(spark, str(tmp_path / "tokens.json")).collect()}
    assert r.keys() == {"1", "2"} and r["1"].updated_at == "x" and r["2"].account_label == "Unknown"
    assert r["1"].tokens.asDict() == {"input": 100, "cached": 20, "cache_write": 30, "output": 10, "fresh": 50, "total": 110, "requests": 1}
    assert r["1"].by_model["gpt-5.6-sol"].tokens == r["1"].tokens and r["1"].by_model["gpt-5.6-sol"].fast_tokens.input == 4 and r["1"].cost.cache_write_cost == 0.0001875
    assert r["1"].cost.input_cost == 0.00028 and r["2"].cost.total_cost == 7 and r["2"].by_model == {}
    flat = histories.session_models(histories.token_sessions(spark, str(tmp_path / "tokens.json"))).collect()
    assert sorted((x.session_id, x.model or "", x.input, x.total_cost) for x in flat) == [("1", "gpt-5.6-sol", 100, r["1"].cost.total_cost), ("2", "", 0, 7.0)]
    for scan in (histories.delta_history, histories.quota_history, histories.token_sessions):
        assert scan(spark, str(tmp_path / "none")).count() == 0


def test_cache_scan_and_heads(spark):
    from usagelake.sources import histories

    cols = "source_machine_id string, key string, kind string, record string, record_key string, origin string"
    good = ("m", "k", "cost", "{}", "k", "m")
    assert histories.checked_cache(spark.createDataFrame([good, good], cols)).collect() == [good, good]
    for bad in (("", "k", "cost", "{}", "k", ""), ("m", "k", "cost", "{}", "k", "other"), ("m", "k", "cost", None, "k", "m"), ("m", "k", "x", "{}", "k", "m"), ("m", "k", "cost", "{}", "j", "m")):
        with pytest.raises(Exception, match="invalid cache entry"):
            histories.checked_cache(spark.createDataFrame([good, bad], cols)).collect()
    heads = spark.createDataFrame([("a", "1"), ("b", "2")], "machine_id string, marker string")
    assert [r.machine_id for r in histories.changed_heads(heads, heads.where("machine_id = 'a'")).collect()] == ["b"]


def test_one_poll_writes_events_and_quota(spark, tmp_path):
    w = json.dumps({"5h": {"used_percent": 5.0, "plan": "plus", "reset": 100}, "7d": {"used_percent": 1.0, "unavailable": True}})
    rows = [{"account_id": "a", "seq": i, "checked_at": f"2030-01-01T00:0{i}:00", "windows": w.replace("5.0", f"{5.0 + i}"), "cost": float(i), "cost_ready": True, "identity": "x"} for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.json").write_text("\n".join(map(json.dumps, rows)))
    for q in live.run_all(spark.readStream.schema(live.SAMPLE).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), every=None):
        q.awaitTermination(120)
    assert sorted((r.window, r.used_percent) for r in spark.read.parquet(str(tmp_path / "out/quota")).collect()) == [("5h", 5.0), ("5h", 6.0), ("5h", 7.0)]
    assert spark.read.parquet(str(tmp_path / "out/events")).where("kind = 'event'").count() == 2


def test_saved_sessions_are_parsed_once_and_not_shuffled(spark):
    """Odd values beside good ones, in one pass: a text that is parsed again, or a join back, made the job some times as long."""
    told = [
        {"sessionId": "a", "updatedAt": "", "startedAt": "t", "tokens": {"inputTokens": "12", "cachedInputTokens": "abc", "outputTokens": None}, "byModel": {"x/gpt-5.4": {"tokens": {"inputTokens": 1e6}}, "gpt-5.5-pro-x": {"tokens": {"inputTokens": 1e6}, "fastTokens": []}, "unheard": {}, "no": [1]}},
        {"sessionId": "b", "tokens": {}, "byModel": None, "cost": {"totalCostUsd": "2.5", "inputCostUsd": {}}},
        {"sessionId": "c", "tokens": {"requests": 3}, "byModel": {"m": None}, "cost": 7},
        {"sessionId": "d", "tokens": [], "byModel": {}},
        {"sessionId": "", "tokens": {}},
        {"sessionId": 5, "tokens": {"inputTokens": 4, "cachedOutputTokens": 9}, "byModel": []},
    ]
    rows = [("f", i, json.dumps(t)) for i, t in enumerate(told)] + [("f", 9, "{"), ("f", 10, "[]")]
    s = histories.normalized_sessions(spark.createDataFrame(rows, "file string, pos long, value string"))
    got = {r.session_id: r for r in s.collect()}
    assert sorted(got) == ["5", "a", "b", "c"]
    assert (got["a"].tokens.input, got["a"].tokens.cached, got["a"].updated_at) == (12, 0, "t")
    assert {m: (v.fast_tokens, v.cost.total_cost) for m, v in got["a"].by_model.items()} == {"x/gpt-5.4": (None, 2.5), "gpt-5.5-pro-x": (None, 30.0), "unheard": (None, 0.0)}
    assert got["a"].cost.total_cost == 32.5 and got["b"].cost.total_cost == 2.5 and got["b"].cost.input_cost == 0 and got["c"].cost.total_cost == 0
    assert got["b"].by_model == {} and got["c"].by_model == {} and got["c"].tokens.requests == 3 and got["5"].tokens.cache_write == 4
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("parseJson") == 1


def test_nodes_are_written_without_their_children(spark, monkeypatch):
    """What a parent says is read from its own fields: a deep body is not written once more for every level that it has."""
    written, nodes = [], quota.json_nodes
    monkeypatch.setattr(quota, "json_nodes", lambda *a, **k: written.append(nodes(*a, **k)) or written[-1])
    body = '{"used":1,"x":' * 40 + '{"used_percent":7,"window_minutes":300,"limit":{"a":1},"resets_at":0.5,"plan_type":{"name":"pro"},"text":"' + "y" * 5000 + '"}' + "}" * 40
    df = spark.createDataFrame([(1, body), (2, '{"used":3,"limit":4,"limit_window_seconds":"18000","window_minutes":null,"planType":"Pro-Lite"}'), (3, '{"name":"Five_ hour","remaining_percent":130,"resets_at":"t"}')], "id long, body string")
    got = {r.id: (r.used_percent, r.reset_at, r.plan) for r in quota.required_windows(df, "id", "body").where("window = '5h'").collect()}
    assert got == {1: (7.0, "1970-01-01T00:00:00.500000Z", "pro"), 2: (75.0, None, "pro_lite"), 3: (0.0, "t", "unknown")}
    assert written[0].agg(F.sum(F.length(F.to_json("node")))).first()[0] < 2000


def test_grouped_rows_are_parsed_in_one_pass(spark):
    """Odd elements beside good ones; events and splits come of one scan, which parses a text once."""
    split = {"checkedAt": 5, "accountSlotId": "s", "deltaPercent": "4", "models": [{"model": "a", "deltaCostUsd": "1", "accountSlotId": "t"}, {"model": 7, "deltaCostUsd": 1}, {"model": "b", "deltaCostUsd": 3, "checkedAt": None}, "x", None, [1]]}
    rows = [
        {"window": "w", "delta": [split, [{"model": 8, "deltaCostUsd": "abc"}, 3, None, ["y"]], {"model": "c", "models": {}}, "z", None]},
        {"delta": None, "events": [{"model": "gone"}]},
        {"delta": 3},
        {"window": 1, "events": [{"model": "d", "models": None}, {"models": [{"model": "e", "deltaCostUsd": 1}]}, {"deltaPercent": 1, "models": [{"model": "f", "deltaCostUsd": -1}]}]},
    ]
    e = deltas.expand_grouped(spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{",), (None,)], "value string"))
    got = sorted((tuple(r) for r in e.select("window", "checkedAt", "model", "accountSlotId", "deltaPercent", "deltaCostUsd").collect()), key=str)
    want = [("1", None, "d", None, None, None), ("w", "5", "a", "t", 1.0, 1.0), ("w", "5", "b", "s", 3.0, 3.0), ("w", None, "8", None, None, None), ("w", None, "c", None, None, None)]
    assert got == sorted(want, key=str)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1 and "Union" not in plan


def test_splits_sort_once_in_partitions_of_bounded_size(spark):
    """Both windows of a split share one sort, and a table is spread over tasks by its rows, not by a fixed number of partitions."""
    from usagelake.session import spread

    df = spark.range(6000).selectExpr("id div 3 as k", "id % 3 as part", "double(id % 3) as weight")
    sizes = [r[0] for r in spread(df, "k", rows=100).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 40 and max(sizes) < 400 and sum(sizes) == 6000
    s = deltas.proportional_split(df, ["k"], "part", "weight", F.lit(9.0), "share")
    assert {tuple(r) for r in s.select("part", "share").distinct().collect()} == {(0, 0.0), (1, 3.0), (2, 6.0)}
    plan = s._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1
