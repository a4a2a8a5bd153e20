"""The registered training-data queries: against SQL where it can express them, else against their contracts' totals."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import compare, connect  # noqa: E402

from isobar.llm.queries import ORACLE, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(ORACLE[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_returns_every_document(spark, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, SF).collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_held_out_languages_are_recognised(spark):
    got = QUERIES["op2_language_id"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.where("lang is not null").count()


def test_class_model_beats_unigrams_on_held_out_texts(spark):
    row = QUERIES["op10_brown_lm"](spark, SF).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert row[0] > row[1]
