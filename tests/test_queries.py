"""Every query against the same in SQL, run by another engine."""

import pytest

from tessera import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, agree):
    agree(queries.QUERIES[name], queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["locus1", "locus2", "jaccard"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
