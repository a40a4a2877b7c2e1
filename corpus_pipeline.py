"""A training corpus from raw documents: stages of the ``llm`` operators, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, packing, queries, secrets, simhash, toxicity
from tickloom.llm.scratch import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. The model is learned from the labelled rows of the tables in ``sf_dir``."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays."""
    return simhash.keep_first(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated by ``benchmark`` go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; live-looking credentials are replaced in their texts."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and sequences of what is left."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contamination), ("secrets", live_secrets), ("packing", packed),
]

#: A learned score, fingerprints and token ids have no SQL form; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every intermediate table is stored, so a lost executor costs one stage at most."""
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
