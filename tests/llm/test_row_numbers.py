"""Stages number their rows once: file splits that change between two scans change nothing."""

import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, exact_dedup, mixing, simhash

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.mark.parametrize("module", [exact_dedup, simhash, mixing])
def test_splits_change_between_scans(spark, tmp_path, monkeypatch, module):
    spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.sha2((F.col("id") % 150).cast("string"), 256)).alias("text"), F.lit("a").alias("source")).repartition(40, "doc_id").write.parquet(
        str(tmp_path / "docs")
    )
    docs = spark.read.parquet(str(tmp_path / "docs"))
    expected = sorted(map(tuple, module.stage(spark, docs, "").collect()))
    before = spark.conf.get(SPLITS)
    real = common.cut

    def cut(df):
        out = real(df)
        spark.conf.set(SPLITS, "4000")  # from now on, scans have other splits
        return out

    for m in (common, module):
        if hasattr(m, "cut"):
            monkeypatch.setattr(m, "cut", cut)
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert sorted(map(tuple, module.stage(spark, docs, "").collect())) == expected
    finally:
        spark.conf.set(SPLITS, before)
