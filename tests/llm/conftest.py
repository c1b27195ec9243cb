import pytest

from flowwarden.plans.ship import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, schema=SCHEMA):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
