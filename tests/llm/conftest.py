import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and repeated rows, ties, a long text and columns with clashing names."""
    words = " ".join(f"Word{i % 977}" for i in range(30_000))
    rows = [
        (None, "a b c d e f g h i j k", None, None), (1, None, "en", "s"), (2, "", "en", None), (3, "  \n\t ", None, "s"),
        (4, words, "en", "s"), (5, words, "en", "s"), (6, "same text here", "fr", "s"), (6, "same text here", "fr", "s"),
        (7, "12345 !!! 678", "de", "s"), (8, "Ünï çödé 日本語 текст <|endoftext|> 😀", "es", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "'x' as rank", "1 as _salt", "2 as h", "3 as words", "4 as size", "5 as shard", "6 as length", "7.0D as score", "'y' as lang_pred", "8 as term", "9 as _n", "10 as pos", "11 as key")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture
def duck_of(tmp_path):
    """A DuckDB connection over DataFrames, by table name."""
    import duckdb

    def made(**tables):
        c = duckdb.connect()
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / name))
            c.sql(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
        return c

    return made
