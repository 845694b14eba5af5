"""Merged views, accounts resolved again, splits packed, console lines with what windows show, labels over several tables."""

import json

import pytest

from usagelake.operators import attribution, deltas, reconcile
from usagelake.plans import projections
from usagelake.sources import sinks


def test_merged_datasets_of_all_kinds(spark):
    base = "account_id string, account_slot string, account_label string, origin string, seq long"
    cost = lambda *rows: spark.createDataFrame(rows, base + ", record_type string, record_key string, cost double")
    quota = lambda *rows: spark.createDataFrame(rows, base + ", checked_at string, window string, used_percent double, reset_at string, plan string")
    token = lambda *rows: spark.createDataFrame(rows, base + ", session_id string, updated_ts long, total_tokens long, content_hash string")
    me, you, old = ("x", "s", "L", "me", 1), ("x", "t", "T", "you", 2), ("x", "s", "L", "me", 3)
    local = {"cost": cost((*me, "costInterval", "k", 1.0), (*me, None, None, 9.0)), "quota": quota((*me, "c", "5h", 1.0, "r", "pro")), "token": token((*me, "1", 5, 100, "a"))}
    cache = {"cost": cost((*you, "costInterval", "k", 2.0), (*old, "costInterval", "k", 3.0)), "quota": quota((*you, "c", "5h", 2.0, "q", "unknown"), (*old, "c", "7d", 3.0, "q", "pro")), "token": token((*you, "1", 5, 120, "b"), (*old, "2", 9, 9, "c"))}
    accounts = spark.createDataFrame([("x", "s", "Mine"), ("z", "u", "Other")], "account_id string, account_slot string, account_label string")
    got = reconcile.merged_datasets(local, cache, "me", accounts)
    assert sorted((r.cost, r.account_slot, r.account_label) for r in got["cost"].collect()) == [(2.0, "s", "Mine"), (9.0, "s", "L")]
    assert [tuple(r) for r in got["quota"].collect()] == [("x", "c", "5h", 2.0, "q", "unknown")]
    assert [(r.session_id, r.total_tokens, r.account_slot) for r in got["token"].collect()] == [("1", 120, "s")]


def test_local_accounts_are_resolved_again(spark):
    rows = spark.createDataFrame([("local:s", "s", "r1", "me", 1), ("x", "s", "r2", "me", 2), ("local:t", "t", "r3", "me", 3), (None, "s", "r4", None, 4), ("local:u", "u", "r5", "me", 5)], "account_id string, account_slot string, record_id string, origin string, n int")
    accounts = spark.createDataFrame([("s", "acc"), ("t", "local:t"), ("u", None)], "account_slot string, account_id string")
    got = {r.n: (r.account_id, r.record_id, r.origin) for r in reconcile.resolved_accounts(rows, accounts).collect()}
    assert got == {1: ("acc", None, None), 2: ("x", "r2", "me"), 3: ("local:t", "r3", "me"), 4: (None, "r4", None), 5: ("local:u", "r5", "me")}


def test_events_are_packed_only_where_a_split_says_the_same(spark):
    def form(*rows, ratios=True):
        names = "window string, checkedAt string, model string, accountSlotId string, deltaPercent double, deltaCostUsd double, costPercentRatio double"
        df = spark.createDataFrame([("5h", "t", *r) for r in rows], names)
        return deltas.pack_models(df if ratios else df.drop("costPercentRatio")).first()

    even = [("a", "s", 1.0, 2.0, 2.0), ("b", "s", 3.0, 6.0, 2.0)]
    packed = form(*even)
    assert packed.form == "models" and packed.accountSlotId == "s" and packed.deltaPercent == 4.0 and [(p.model, p.deltaPercent, p.deltaCostUsd) for p in packed.parts] == [("a", None, 2.0), ("b", None, 6.0)]
    assert form(*even, ratios=False).form == "models"
    for rows in (even[:1], [even[0], ("b", "t", 3.0, 6.0, 2.0)], [even[0], ("b", "s", 3.0, 6.0, 2.0 + 1e-6)], [even[0], ("b", "s", 3.0, 6.1, 2.0)], [even[0], (None, "s", 3.0, 6.0, 2.0)], [even[0], ("b", "s", 3.0, 6.0, None)], [("a", "s", 0.0, 0.0, 1.0)] * 2):
        listed = form(*rows)
        assert listed.form == "list" and sorted(p.deltaPercent for p in listed.parts) == sorted(r[2] for r in rows)


def test_console_lines_say_local_time_and_what_windows_show(spark):
    cols = "account string, checked_at string, window string, model string, delta_percent double, delta_cost double, cost_percent_ratio double, cumulative_percent double, cumulative_cost double, plan string, multiplier double"
    e = spark.createDataFrame([("a", "2030-01-01T12:00:00Z", "5h", "m", 2.5, 0.125, 0.05, 12.0, 1.5, "plus", 1.0), ("b", "soon", "7d", "m", 1.0, 1.0, 1.0, 1.0, 1.0, None, None)], cols)
    w = spark.createDataFrame([("a", "5h", 12.5, "plus", 1.0), ("a", "7d", None, None, 20.0)], "account string, window string, percent double, plan string, multiplier double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = {r.account: r.line for r in projections.delta_text(e, w, ["account"]).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got["a"] == "[delta] 2030-01-01T12:00:00Z (local 2030-01-01T07:00:00-05:00) 5h m +2.5% / +$0.125; ratio $0.05/%; cumulative 12% / $1.5; event plan plus (1x); current 5h 12.5% [plus 1x], 7d - [unknown 20x]"
    assert got["b"].startswith("[delta] soon 7d m") and got["b"].endswith("; current 5h - [unknown 1x], 7d - [unknown 1x]")


def test_labels_change_in_all_tables_or_in_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "body string")
    sinks.commit_tables(spark, root, {"a": table({"accountSlotId": "s", "accountLabel": "old"}), "b": table([{"accountSlotId": "s"}, {"accountSlotId": "t"}])})
    labels = lambda: {n: [json.loads(r.body) for r in df.collect()] for n, df in sinks.read_tables(spark, root, ["a", "b"]).items()}
    before, real = labels(), sinks.commit_tables

    def half(s, where, tables):
        real(s, str(tmp_path / "elsewhere"), {"a": tables["a"]})
        raise OSError("disk full")

    monkeypatch.setattr(attribution, "commit_tables", half)
    with pytest.raises(OSError):
        attribution.relabel_tables(spark, root, ["a", "b"], "body", "s", "new")
    assert labels() == before
    monkeypatch.setattr(attribution, "commit_tables", real)
    assert attribution.relabel_tables(spark, root, ["a", "b"], "body", "s", "new") == 2
    assert labels() == {"a": [{"accountSlotId": "s", "accountLabel": "new"}], "b": [[{"accountSlotId": "s", "accountLabel": "new"}, {"accountSlotId": "t"}]]}
    versions = spark.read.parquet(f"{root}/_versions").count()
    assert attribution.relabel_tables(spark, root, ["a", "b"], "body", "s", "new") == 0 and spark.read.parquet(f"{root}/_versions").count() == versions
