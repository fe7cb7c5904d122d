"""From documents to training tokens, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credsweep.llm import bpe, mixing, ngram_join, toxicity
from credsweep.llm.common import read, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("near duplicates", ngram_join.stage),
    ("mix", mixing.stage),
    ("tokens", bpe.stage),
]

#: None: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
