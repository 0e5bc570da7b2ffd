"""Every registered query against its SQL, over the whole small tables."""

import os

import pytest

from geoevents.plans import registry

from .compare import check, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, duck):
    verdict, _rows = check(name, spark, duck, FOLDER)
    assert verdict in ("ok", "no oracle")
