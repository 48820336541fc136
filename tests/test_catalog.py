"""Every query of the library on the smallest tables, against its SQL where there is one."""

import pytest

from quillspark.catalog import documents, misc, search

QUERIES = search.QUERIES | documents.QUERIES | misc.QUERIES
ORACLES = search.ORACLES | documents.ORACLES | misc.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, same):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() > 0
