import pytest

from tidemark.llm.cluster import prepare


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)
