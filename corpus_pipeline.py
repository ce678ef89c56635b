"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes every stage's
result to the shared folder and reads it back, so a lost executor repeats one stage at most. All stages but the last
return the columns of documents. Nulls, repeated rows and empty tables are handled as each operator states.

language_id      drops documents whose language can't be told (the operator's ``accepted``)
near_duplicates  keeps the document with the least doc_id of each class of linked texts
decontamination  drops documents that hold a benchmark item
personal_data    replaces confirmed spans by their kind and recounts n_chars
source_mixing    samples documents towards the target marginals, adding sampling_p
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantweave.llm import decontam, jaccard, lang_id, mixing, pii
from grantweave.llm.common import materialize, table

#: SQL can express neither the classifier nor the joins by sketches; tests compare small inputs with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
