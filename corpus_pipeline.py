"""A corpus pipeline of five stages: toxic documents go, one of each group of near copies stays, contaminated documents go,
secrets are taken out, and what is left is packed into sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import cut, shared_folder, table
from lodemap.llm.decontam import decontaminate
from lodemap.llm.jaccard_join import jaccard_join
from lodemap.llm.packing import pack_documents
from lodemap.llm.secrets_scan import redact_secrets
from lodemap.llm.toxicity import drop_toxic, fit, trainable


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many marks in front as tell it from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents over their language's toxicity threshold."""
    return drop_toxic(docs, fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), trainable()))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a Jaccard similarity of 0.8 in 5-word shingles: that of the smallest id.

    Of several rows with one id, one stays; rows without an id stay as they are.
    """
    judged = cut(jaccard_join(docs, width=5, percent=80))
    kept = judged.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    once = docs.join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    # Ids on several rows: rare, so that only their rows are dealt out by id.
    more = docs.join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return once.unionByName(more).unionByName(docs.filter("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item.

    Rows are told apart by id and text; null ids and texts stay unless hit; empty tables hit nothing.
    """
    hit = cut(decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "key"))
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return keyed.join(hit, keyed[key] == hit["key"], "left_anti").drop(key)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins: bin_id, capacity, used, n_pieces, doc_ids, starts, lengths, cost."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage), ("ngram_jaccard_join", near_copies_stage), ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage), ("best_fit_packing", packing_stage),
]

#: Classifier, pigeonhole join and packing can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again by the next."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
