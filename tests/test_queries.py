"""Every registered query of the library against its SQL, on a small and, where TEST_SF_DIR says so, another size."""

import pytest

from tests.compare import differences, tables
from tidemark import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE_SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
