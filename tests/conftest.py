import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(**{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture
def cut_small(monkeypatch):
    """Cut every key with more than three rows into pieces."""
    from flowwarden.plans import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_PIECE", 3)
