"""Preparation of a training corpus: five stages over ``documents``, each an operator of newslens.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as parquet and read again as the next one's docs. All but the last return the
columns of documents.

Rows: null, blank and short texts fail the quality rules. A null doc_id makes a
document of its own. Of near copies, repeated rows among them, the one with the
smallest doc_id stays (null last; then the smallest text); texts that share a
doc_id and are no near copies all stay. A null source is a source of its own in
the mix. Texts are read whole. Other columns, of any name, go with their rows.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newslens.llm import mixing, packing, pii, quality_rules, token_groups
from newslens.llm.common import materialize
from newslens.llm.registry import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return token_groups.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document comes once, twice, in part or not at all, in the order of the mix's shards."""
    return mixing.mixed(docs, cut=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, with the ids of each piece."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("personal data", personal_data), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the personal data nor the tokens; tests/llm compares with brute force.
ORACLE_SQL = None
