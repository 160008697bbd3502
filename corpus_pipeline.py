"""A corpus pipeline of four stages, each written as Parquet and read again by the next.

Null texts, or texts without a letter, are rejected by the first stage. Rows of the same doc_id are
one document. Rows with a null doc_id are in no group and stay.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlatlas.llm import jaccard, langid, packing, pii
from crawlatlas.llm.common import materialize
from crawlatlas.session import configure
from crawlatlas.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with ``lang`` as predicted; the undetermined go."""
    configure(spark)
    model = langid.learn(*langid.sample(docs))
    found = langid.predict(docs, model, keep=("text", "source", "n_chars"))
    return found.where(F.col("lang_pred") != "und").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    configure(spark)
    groups = jaccard.near_duplicates(docs, 5, Fraction(8, 10))
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(materialize(gone, "gone"), "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    configure(spark)
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences."""
    configure(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY), CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Automata, components, pattern scores and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
