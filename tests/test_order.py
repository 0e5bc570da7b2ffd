"""Results that promise an order come in that order, without sorting before the comparison."""

import pytest

from geoevents.plans import registry

from . import compare

FOLDER = "/root/testdata/sf0.001"
# Query: the order it promises, as SQL over the columns of its twin.
ORDERED = {
    "canonical_order": "occurred_at DESC, id",
    "tour_order": "lat DESC, lng, id",
    "reading_list": "user_id, added_at DESC, event_id",
    "event_page": "occurred_at DESC, id",
}


@pytest.fixture(scope="module")
def duck():
    registry.load()
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", ORDERED)
def test_order(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = df.columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({registry.ORACLES[name]}) ORDER BY {ORDERED[name]}").fetchall()
    got = [tuple(r) for r in df.collect()]
    place = [columns.index(w.split()[0]) for w in ORDERED[name].split(", ")]
    assert len(got) == len(want)
    assert [tuple(r[i] for i in place) for r in got] == [tuple(r[i] for i in place) for r in want]
