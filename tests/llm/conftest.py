import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Build documents (doc_id, text), with two columns whose names operators use inside."""
    def build(rows):
        frame = spark.createDataFrame([(i, t, "s", "en") for i, t in rows],
                                      "doc_id long, text string, source string, lang string")
        return frame.withColumn("id", F.lit("other")).withColumn("mark", F.lit(1))

    return build
