"""Every registered query gives the rows of its SQL, and the plans have the shape they should."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import differences, duck  # noqa: E402

from wordloom.catalog import inputs  # noqa: E402
from wordloom.catalog.oracles import ORACLES  # noqa: E402
from wordloom.catalog.queries import QUERIES, deck_words  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_sql(spark, con, name):
    problem = differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "rank", "word"] and rows.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deck_words_reads_three_columns_and_only_deals_them_out(spark):
    plan = plan_of(deck_words(spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    texts, known = plan.split("BroadcastExchange")
    # The inputs deal the texts out; the operators themselves shuffle nothing.
    assert texts.count("Exchange") == texts.count("REPARTITION_BY_NUM") <= 1 and "BroadcastHashJoin" in texts


def test_filters_reach_the_scan(spark):
    plan = plan_of(entry.queries()["keyset_page"](spark, SF_DIR))
    assert "GreaterThan(o_orderkey,700)" in plan and "TakeOrderedAndProject" in plan
    plan = plan_of(entry.queries()["paged_read"](spark, SF_DIR))
    assert "c_mktsegment,BUILDING" in plan


def test_numbering_shuffles_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(inputs.part_entries(spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = plan.split("FileScan")[0]
    assert "Window" in rows and rows.count("Exchange") == 1
