import pytest

import __spark_entry__
from glyphward.plans.queries import ORACLES, QUERIES

from .comparing import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_entry_has_a_row_per_document(spark):
    assert __spark_entry__.entry(spark).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_plan_reads_two_columns_only(spark):
    plan = QUERIES["text_hygiene"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
