"""A corpus from documents to tokens: each stage's table is written, then read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``; the
mixing stage repeats a document as often as the mix takes it.

Rows with null ids or texts, repeated ids, repeated rows and further columns, of
whatever name, go through all stages; an empty table gives an empty result. The
same tables give the same rows in each run, on any number of cores. The stages'
tables stay in the shared folder, under one folder a run, as the record of what
each stage decided; they can be removed once the result is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import exact_dedup, mixing, quality_trees, sentencepiece_codec, simhash
from threadloom.sources.session import shared_folder

STAGES = [
    ("quality_classifier", quality_trees.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("source_mixing", mixing.stage),
    ("sentencepiece_codec", sentencepiece_codec.stage),
]

#: No SQL can say what a fitted classifier and a SimHash join decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between them go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{place}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
