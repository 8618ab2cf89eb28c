import pytest

from oracle import compare, connect
from veriscope.llm import registry

registry.load_all()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, small, name):
    message, ok = compare(spark, connect(small), name, registry.QUERIES[name], registry.ORACLES[name], small)
    assert ok, message
