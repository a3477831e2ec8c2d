from __future__ import annotations

import pytest
from fixture_corpus import SCHEMA, make_rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, an extra column with a name that operators use themselves."""
    made = [(None, None, None, None, None), (5, "same text here, and quite some more of it", "en", None, 3), (5, "same text here, and quite some more of it", "en", None, 3), (7, None, None, "s", None), (None, "same text here, and quite some more of it", "en", "s", 1), (9, "", "en", "s", 0)]
    return spark.createDataFrame([(*r, "x", 1) for r in made], SCHEMA + ", cls string, bucket int")
