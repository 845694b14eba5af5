"""Attribution of sessions and logins to accounts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.operators import blocks
from usagelake.sources.sinks import commit_tables, read_tables


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_ts: str, right_ts: str, right_order: list[str], values: list[str], hot_rows: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it (ties: the last in right_order), else nulls.

    One shuffle by key and one running last value over the union of both sides: no range comparison of pairs. Where a key has more than
    `hot_rows` rows the value is carried over blocks (see `blocks`).
    """
    names = left.columns
    l = left.select(*names, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), *(F.lit(None).alias(f"_o{i}") for i in range(len(right_order))), F.lit(None).alias("_v"))
    r = right.select(*key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)), F.struct(*values).alias("_v"))
    order = ["_t", "_side", *(f"_o{i}" for i in range(len(right_order)))]
    both = r.where("_t is not null").unionByName(l.drop("_v", *(f"_o{i}" for i in range(len(right_order)))), allowMissingColumns=True)
    if blocks.hot(both, key, hot_rows):
        found = blocks.running(blocks.blocked(both, key, order), key, order, lasts={"_found": "_v"}).drop("_v", "_block").withColumnRenamed("_found", "_v")
    else:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_v", F.last("_v", True).over(w))
    found = found.where("_side = 1")
    return found.select(*names, *(F.when(F.col("_t").isNotNull(), F.col(f"_v.{v}")).alias(v) for v in values))


def sticky_upsert(old: DataFrame, new: DataFrame, key: list[str], sticky: list[str]) -> DataFrame:
    """New rows over old ones by key; `sticky` columns keep the old value where there is one."""
    rest = [c for c in new.columns if c not in key]
    o = old.select(*key, F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in rest))
    n = new.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in rest))
    value = lambda c: F.coalesce(f"_o_{c}", f"_n_{c}") if c in sticky else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))
    return o.join(n, key, "full_outer").select(*key, *(value(c).alias(c) for c in rest))


def login_account(logins: DataFrame, accounts: DataFrame) -> DataFrame:
    """logins(login_id, auth_account, auth_token_hash, email) with account_id: by account or token hash, else by an e-mail that is one account's only."""
    by_id = logins.join(accounts.select("account_id", F.col("auth_account").alias("_a")), F.col("auth_account") == F.col("_a")).select("login_id", "account_id", F.lit(0).alias("rank"))
    by_token = logins.join(accounts.select("account_id", F.col("auth_token_hash").alias("_h")), F.col("auth_token_hash") == F.col("_h")).select("login_id", "account_id", F.lit(0).alias("rank"))
    single = accounts.where("email <> ''").groupBy(F.lower("email").alias("_e")).agg(F.count("*").alias("n"), F.first("account_id").alias("account_id")).where("n = 1")
    by_mail = logins.join(single, F.lower("email") == F.col("_e")).select("login_id", "account_id", F.lit(1).alias("rank"))
    best = by_id.unionByName(by_token).unionByName(by_mail).groupBy("login_id").agg(F.min_by("account_id", F.struct("rank", "account_id")).alias("account_id"))
    return logins.join(best, "login_id", "left")


def local_account(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Usage account ids to local slots and labels; ids without one get a name of their first 16 characters."""
    other = F.concat(F.lit("cloud-usage-"), F.left("usage_account", F.lit(16)))
    return rows.join(mapping, "usage_account", "left").withColumns({"account_slot": F.coalesce("account_slot", other), "account_label": F.coalesce("account_label", other)})


def relabel(df: DataFrame, account: str, label: str, renamed: dict[str, str]) -> DataFrame:
    """New labels of accounts, wherever rows carry one."""
    out: Column = F.col(label)
    for k, v in renamed.items():
        out = F.when(F.col(account) == k, v).otherwise(out)
    return df.withColumn(label, out)


def relabel_trees(df: DataFrame, body: str, account: str, label: str) -> DataFrame:
    """JSON texts in which every object of the account, at any depth, has the new label; `changes` counts the objects that had another."""

    @F.udf("struct<body:string,changes:int>", useArrow=True)
    def renamed(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return text, 0
        n, todo = 0, [value]
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                if node.get("accountSlotId") == account and node.get("accountLabel") != label:
                    node["accountLabel"] = label
                    n += 1
                todo += node.values()
            elif isinstance(node, list):
                todo += node
        return (json.dumps(value, ensure_ascii=False), n) if n else (text, 0)

    return df.withColumn("_r", renamed(body)).withColumns({body: F.col("_r.body"), "changes": F.col("_r.changes")}).drop("_r")


def relabel_tables(spark: SparkSession, root: str, names: list[str], body: str, account: str, label: str) -> int:
    """Relabel an account in several committed tables of JSON texts (see `sinks.commit_tables`), all of them or none: the tables become visible
    together, and a failure leaves the labels of before in all. Returns how many objects had another label; without any nothing is written."""
    now = {n: relabel_trees(df, body, account, label) for n, df in read_tables(spark, root, names).items()}
    changes = sum(df.agg(F.coalesce(F.sum("changes"), F.lit(0))).first()[0] for df in now.values())
    if changes:
        commit_tables(spark, root, {n: df.drop("changes") for n, df in now.items()})
    return changes
