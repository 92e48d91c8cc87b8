import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import differences, duck  # noqa: E402

from wordloom.llm.catalog import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    assert differences(spark, duck(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) is None
