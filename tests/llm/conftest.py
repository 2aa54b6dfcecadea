import pytest


@pytest.fixture(scope="session")
def clashing():
    """Adds columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    def add(df, *names):
        return df.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])

    return add
