"""Queries against their SQL twins on documents that the test tables don't have."""

import duckdb
import pytest
from conftest import same_rows

from tessera.plans.registry import ORACLES, QUERIES


def twin(spark, folder, name, texts):
    """The query and its SQL on documents of these texts, all of one language."""
    rows = [(k, t, "es", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    same_rows(QUERIES[name](spark, str(folder)), con, ORACLES[name])


TWO_ENDINGS = ["acme co co", "acme group ltd", "co co", "ñandú co co", "acme co", "acme holding pvt ltd", "acme co co co"]


def test_two_legal_endings(spark, tmp_path):
    twin(spark, tmp_path, "named_block_keys", TWO_ENDINGS)


def test_heuristic_score_of_two_legal_endings(spark, tmp_path):
    # copies lie 1 and 2 apart, so that they are of other sources
    twin(spark, tmp_path, "heuristic_score", [t for t in TWO_ENDINGS for _ in range(3)])


def test_numbers_beside_accented_letters(spark, tmp_path):
    twin(spark, tmp_path, "heuristic_score", ["acme one two three four five rue " + x + " " + "x" * k for k, x in enumerate(["né5", "5é", "né5 7", "né_5", "né5"] * 4)])
