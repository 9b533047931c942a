import pytest

from ..conftest import SF


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, with nulls, empty texts, a repeated row, ties, and a column of a clashing name."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a B"), (-4, "a B"), (-5, " \n\t "), (-6, "# x\n# x\n\n# x\n y"), (-7, "a b c a b c d a b c"), (-7, "a b c a b c d a b c"), (-8, "é" * 200)], "doc_id long, text string")
    return real.unionAll(odd).withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
