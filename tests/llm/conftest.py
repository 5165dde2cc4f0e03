import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (id, text) pairs, with extra columns whose names operators use inside."""

    def build(pairs, extra=True):
        rows = [(i, t, "en", "s", len(t) if t else None) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for name in ("key", "h", "h1", "norm", "shard", "slot", "digest", "node", "a", "grp", "tie", "at", "part", "score"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return build
