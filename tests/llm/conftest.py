import pytest


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, extra=False):
        """doc_id and text, and columns with names that operators use themselves."""
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "'x' AS kept", "1 AS id", "'y' AS norm", "2 AS component_id", "3 AS score", "'z' AS label", "4 AS first", "5 AS line")
        return df

    return make
