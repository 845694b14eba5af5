"""The corpus pipeline: stages of training-data operators, each over all that its predecessor kept.

toxicity drops documents of score 0.7 or more; near_duplicates keeps one document of each group of similar texts (the smallest id);
decontamination drops documents of which benchmark passages make up a twentieth or more of the words; secrets replaces secrets by a
mark; packing cuts what is left into windows of token ids.

Every stage judges rows: rows without an id, or that share one, each by their own text. Null and empty texts are neither toxic, near
duplicates nor contaminated, and pack into the end id alone. Repeated rows (same id, same text) get the same verdict, and
near_duplicates keeps one of them. An empty table stays empty. Further columns are passed on as they are, whatever their names, but by
packing, whose rows are pieces of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.llm import decontam, jaccard, packing, secret_scan, toxicity
from usagelake.llm.common import scratch, written

ORACLE_SQL = None  # neither a trained model nor tokenization can be said in SQL; tests hold the stages against brute force


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no name of its columns meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("row"))


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a score under 0.7. The model is trained on the labelled rows of docs that are not held out; without any of both labels
    it scores 0.5 throughout, and all rows stay."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.score(_rows(docs).select("row"), model, ["row"], "toxicity", inside="row").where("toxicity < 0.7"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts, that of the smallest id: see `jaccard.one_of_each` for rows that share an id or have none."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words less than a twentieth lies in benchmark passages."""
    found = decontam.contamination(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return _columns(found.where(~F.col("_contaminated")), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark; null texts stay null."""
    return secret_scan.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows: each token id of each row lies in exactly one; a null text is a document of the end id alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again by the next; what a stage wrote on its way goes when it is done, and so
    do its documents once the next stage has written its own. The last stage's documents stay, as the result reads them."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as own:
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            own.remove(path)
            if last:
                own.append(last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
