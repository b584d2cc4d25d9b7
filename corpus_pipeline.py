"""From raw documents to packed training sequences: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its result is written as
Parquet in the shared folder and read again. All stages but the last return the columns of ``documents``. NULL and
empty texts pass every filter; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blendwise.llm import decontamination, jaccard, packing, pii, toxicity
from blendwise.llm.common import stored, table
from blendwise.llm.queries import toxicity_model


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below 1/2; it learns from the labelled ones outside the held-out part."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir, docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join, that with the smallest id."""
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in windows of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with plain and disguised identifiers replaced by marks, and ``n_chars`` to match."""
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained weights, whole-text token ids and retrieval order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
