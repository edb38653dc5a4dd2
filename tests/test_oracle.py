"""Every query with SQL gives DuckDB's rows on the small tables; the others run and have plain versions in test_plain."""

import pytest

from siltstone.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences
from tests.test_plain import PLAIN

SF = "/root/testdata/sf0.001"
LARGER = {"complete_link_clusters": "/root/testdata/sf0.01"}  # ten suppliers have no neighbours


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        assert differences(spark, SF, name, QUERIES[name], ORACLE_SQL[name]) == ""
    if name not in ORACLE_SQL or name in PLAIN:
        sf = LARGER.get(name, SF)
        rows = QUERIES[name](spark, sf).collect()
        assert rows
        if name in PLAIN:
            PLAIN[name](rows, sf)
