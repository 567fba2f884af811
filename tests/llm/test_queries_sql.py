"""The registered queries of the training-data operators that have SQL, against it."""

import pytest

from compare import difference
from conftest import FOLDER
from riskspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, database, name):
    assert difference(QUERIES[name](spark, FOLDER), database, ORACLES[name]) is None
