import os
import sys
import warnings

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tideline.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warnings.simplefilter("ignore", FutureWarning)
    session = local_session(
        4, app="tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet")


@pytest.fixture
def heavy(spark, monkeypatch):
    """Make every key beyond 40 rows heavy and every chunk small."""
    from tideline.operators import joins, sequence

    monkeypatch.setattr(sequence, "CHUNK_ROWS", 20)
    monkeypatch.setattr(joins, "CHUNK_ROWS", 20)
    monkeypatch.setattr(sequence, "SLICE_ROWS", 50)
    spark.conf.set(sequence.HEAVY_ROWS_CONF, "40")
    yield
    spark.conf.unset(sequence.HEAVY_ROWS_CONF)
