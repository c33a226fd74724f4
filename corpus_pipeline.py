"""A corpus pipeline over the table documents; each stage's rows are written before the next begins.

python corpus_pipeline.py SF_DIR OUT_DIR
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eodscan.llm import common, decontaminate, jaccard_join, language_id, line_dedup, packing

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontaminate.stage),
    ("best_fit_packing", packing.stage),
]

ORACLE_SQL = None  # language identification is learned; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the result is the last one's."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.getOrCreate(), sys.argv[1]).write.parquet(sys.argv[2])
