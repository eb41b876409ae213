"""A training-data pipeline over documents, from the operators of courtside.llm.

Null and blank texts fail the quality rules and go; null ids are no ids, so such rows are near-duplicates of nothing; null
sources are one source; of repeated rows one stays, as of near-duplicates; further columns pass through all stages but
the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtside.llm import stages
from courtside.llm._common import materialize, table

STAGES = [
    ("quality_rules", stages.quality),
    ("minhash_dedup", stages.dedup),
    ("secret_scan", stages.secrets),
    ("source_mix", stages.mix),
    ("byte_bpe", stages.encode),
]

#: The stages choose documents by seeded hashes and encode bytes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
