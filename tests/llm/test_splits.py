"""Results don't depend on how files are split, in the first pass or the second."""

import pytest

from tessera.llm import lm_scoring, substring_dedup
from tessera.llm.queries import QUERIES


@pytest.fixture
def splits(spark):
    def set_to(n):
        spark.conf.set("spark.sql.files.minPartitionNum", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The documents as six files."""
    folder = str(tmp_path_factory.mktemp("six"))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_language_model_scores_alike(spark, parts, splits):
    every = []
    for n in (6, 1):
        splits(n)
        rows = spark.read.parquet(f"{parts}/documents.parquet")
        assert (rows.rdd.getNumPartitions() > 1) == (n > 1)
        every.append(sorted(map(tuple, lm_scoring.score_texts(rows, rows.doc_id % 5 != 1, bucket_bytes=100_000).collect())))
    assert every[0] == every[1]


def test_repeats_with_other_splits_in_the_second_pass(spark, parts, splits, monkeypatch):
    wanted = sorted(map(tuple, QUERIES["op4_substring_dedup"](spark, parts).collect()))
    count = substring_dedup.count_windows

    def then_split(*args):
        out = count(*args)
        splits(1)
        return out

    monkeypatch.setattr(substring_dedup, "count_windows", then_split)
    splits(6)
    assert sorted(map(tuple, QUERIES["op4_substring_dedup"](spark, parts).collect())) == wanted
