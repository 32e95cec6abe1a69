import pytest
from documents_made import CLASHES, make_rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def frame(spark):
    def build(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})

    return build


@pytest.fixture(scope="session")
def docs(frame, rows):
    return frame(rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
