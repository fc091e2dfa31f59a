"""The corpus pipeline: each stage takes what the stage before it kept.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``:

1. toxicity: documents that score at or above the threshold go (labels of ``sf_dir`` teach the model);
2. SimHash near-dedup: of each group of near-duplicates the document with the smallest doc_id stays;
3. benchmark decontamination: documents that hold an item of ``sf_dir``'s benchmark go;
4. secret scans: secrets that fewer than three owners have are replaced by a mark (all documents stay);
5. best-fit packing: the kept documents' ids, cut and packed into sequences of 2048.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import read, table
from tidewater.llm.decontamination import without_leaks
from tidewater.llm.packing import pack_documents
from tidewater.llm.secrets import redact
from tidewater.llm.simhash import one_of_each
from tidewater.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learnt scores, fingerprints, alignments and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
