import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from servertide.llm.ship import ship

    ship(spark)


@pytest.fixture()
def docs(spark):
    """Documents from (id, text) pairs, with the other columns of the table."""

    def build(pairs):
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
