import os

import pytest

from lodestat.plans import battery, governance, modelling, reporting  # noqa: F401

from .oracle import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(battery.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = battery.QUERIES[name](spark, SF)
    if name in battery.SQL:
        assert differences(duck(SF), df, battery.SQL[name])[:3] == []
    else:
        assert df.count() > 0
