import pytest

from tests.llm.helpers import awkward_rows, frame


@pytest.fixture(scope="session")
def docs(spark):
    """The awkward rows, in several partitions."""
    return frame(spark, awkward_rows()).repartition(3)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["key", "token", "one", "two", "digest", "stratum", "n_words", "kept", "ids", "__key", "DOC"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.filter("false")
