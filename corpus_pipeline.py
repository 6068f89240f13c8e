"""A training-data pipeline over `documents`: toxic documents, exact and near copies go, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again as
the next stage's docs. All but the last return the columns of documents. Rows that stay are whole and unchanged; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import saved, small
from tidegauge.llm.exact_dedup import exact_duplicates, normalised
from tidegauge.llm.minhash_dedup import near_duplicates
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.toxicity import fit_toxicity, with_toxicity

#: Documents with at least this score go.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents. Each row is decided by its own text: repeated ids don't matter, and null and empty
    texts are scored like texts without words."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_toxicity(docs, model, score_col="__toxic").where(F.col("__toxic") < TOXIC).drop("__toxic")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, with the smallest id. A row goes for its own id and text: another text under the id of a
    copy stays. Of rows that repeat both, and of copies without any id, one stays; null and empty texts are one text."""
    decided = saved(exact_duplicates(docs).select(F.col("doc_id").alias("__id"), F.col("text_print").alias("__text"), "kept"), "decided")
    keyed = docs.withColumn("__print", F.xxhash64(normalised(F.col("text"))))
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__text"))
    gone = small(decided.where("NOT kept").select("__id", "__text").distinct(), "copies")
    stay = keyed.join(gone, same, "left_anti")
    twice = saved(decided.where("kept").groupBy("__id", "__text").count().where("count > 1").select("__id", "__text"), "repeats")
    if not twice.isEmpty():
        stay = stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").dropDuplicates(["doc_id", "__print"]))
    return stay.drop("__print")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity of 0.8 or more), the document with the smallest id stays. Rows that
    share an id are one document, and go or stay together; rows with a null id and without words always stay."""
    decided = near_duplicates(docs, size=5, percent=80)
    gone = small(decided.where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document stands in sequences of 1024 tokens; each row is a document, null and empty texts one token long."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: A trained classifier decides what goes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
