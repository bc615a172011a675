"""A corpus from raw documents to tokens: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
each result to the shared folder and reads it back as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import bpe, mixing, simhash, substring, toxicity
from treeline.llm.shared import read, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("substring_dedup", substring.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL can't express the trained classifier, the fingerprints or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what the stages keep of the table's documents.

    Nulls, empty and long texts, repeated rows and further columns are dealt
    with stage by stage, as each stage's docstring says; an empty table gives
    no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
