"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ortholens.llm.common import stash, table
from ortholens.llm.decontaminate import drop_contaminated
from ortholens.llm.mixing import mix
from ortholens.llm.near_dedup import keep_first
from ortholens.llm.pii import sanitise
from ortholens.llm.quality_rules import keep_good


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in text."""
    return sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' texts with what each output shard takes of them."""
    return mix(docs, with_text=True)


STAGES = [
    ("quality_rules", rules),
    ("near_dedup", near),
    ("decontamination", clean_of_benchmark),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed),
]

#: Near-duplicate classes rest on sampled hashes that DuckDB does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
