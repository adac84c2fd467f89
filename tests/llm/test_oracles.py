import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from asofkit.llm.queries import QUERIES, SQL  # noqa: E402
from asofkit.registry import Query  # noqa: E402
from oracle_check import compare, connect  # noqa: E402


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, name, sf):
    status, _, _, message = compare(spark, connect(sf), Query(name, QUERIES[name], SQL[name], ()), sf)
    assert status == "ok", f"{name}: {status} {message}"
