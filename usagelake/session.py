"""Session settings and table access shared by queries, tests and the bench."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def local_session(cpus: str = "8", app: str = "usagelake", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or that of setCheckpointDir. A session of one machine, as in tests,
    gets a folder of this process where both are unset; on a cluster that is an error, as no executor could read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="usagelake-"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str, rows: int = 250_000) -> DataFrame:
    """df by hash of a key, in as many partitions as it has rows for: what a task sorts or joins by the key stays of one size as df grows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *key)


def materialized(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read again, and its path: lineage ends here. The caller deletes what it no longer reads."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
