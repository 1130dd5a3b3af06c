"""Every named query against its SQL twin, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from corpusgraph.catalog.fixtures import QUERIES  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    good, note, _ = compare(spark, duck, FOLDER, name)
    assert good, note


def test_flagship(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "file", "score", "place"]
    assert frame.count() > 0
