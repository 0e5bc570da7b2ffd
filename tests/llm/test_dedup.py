"""Exact and near copies against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geoevents.llm import exact_dedup, near_dedup

from .helpers import ODD, documents, words, written

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return {g: (min((i for i in v if i is not None), default=None), len(v)) for g, v in groups.items()}


def check_groups(out, rows):
    want = plain_groups(rows)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in out)
    assert got == Counter((i, *want[SPACE.sub(" ", t or "")]) for i, t in rows)
    assert sum(r["kept"] for r in out) == len(want)


ROWS = [*enumerate(ODD), (3, "again"), (3, "again"), (None, "nobody"), (None, "a"), (90, " \t"), *((100 + k, "pile of copies") for k in range(300))]


@pytest.mark.parametrize("files", [1, 50])
def test_exact_groups(spark, tmp_path, files):
    docs = written(spark, documents(spark, ROWS).repartition(4), tmp_path)
    out = exact_dedup.exact_groups(docs, files_per_batch=files).collect()
    check_groups(out, ROWS)


def test_colliding_digests_are_told_by_their_bytes(spark, tmp_path):
    docs = written(spark, documents(spark, ROWS), tmp_path)
    out = exact_dedup.exact_groups(docs, digest=lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2).substr(1, 1).cast("string"))).collect()
    check_groups(out, ROWS)


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    prints, state = f"{tmp_path}/prints", f"{tmp_path}/state"
    part = lambda ids: spark.createDataFrame([(i, "f", i, bytearray([i % 3])) for i in ids], "doc_id long, file string, row long, digest binary")
    part([5, 6, 7]).write.parquet(prints)
    exact_dedup.run_state(spark, prints, state)
    part([1, 2, 3]).write.mode("append").parquet(prints)
    exact_dedup.run_state(spark, prints, state)
    exact_dedup.run_state(spark, prints, state)
    got = {bytes(r["digest"]): (r["first_id"], r["n"]) for r in exact_dedup.read_state(spark, state).collect()}
    assert got == {b"\x00": (3, 2), b"\x01": (1, 2), b"\x02": (2, 2)}


def test_dedup_keeps_all_columns_and_takes_tables_of_no_file(spark):
    docs = documents(spark, ["a b", "a  b", "c", None, ""], extra=True)
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_dedup_of_nothing(spark, tmp_path):
    docs = written(spark, documents(spark, []), tmp_path)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.deduplicated(docs).count() == 0


def plain_components(rows, size):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i if i is not None else 10**18, least.get(find(k), 10**18))
    return Counter((i, len(sets[k]), least[find(k)] if sets[k] and i is not None else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
def test_near_components(spark, seed):
    rng = random.Random(seed)
    rows = [*enumerate(ODD), (None, "a"), (2000, "twice"), (2000, "twice told"), (2001, "twice told")]
    for family in range(12):
        base = words(rng, rng.choice([3, 5, 12, 40, 150, 1500])).split()
        for _ in range(12):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [text[k], "more"]])
                text = text or ["z"]
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    rows.append((500_000, words(rng, 20000, 10**6)))
    out = near_dedup.grouped(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_components(rows, 4)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)


def test_a_pile_of_near_copies_gives_few_pairs(spark):
    rng = random.Random(5)
    base = words(rng, 200).split()
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(i % 9):
            text[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    sets = near_dedup.sets_of(documents(spark, rows), 4, whole=True).drop("doc_id").dropDuplicates(["digest"])
    assert near_dedup.links(sets).count() < 3 * len(rows)
    out = near_dedup.grouped(documents(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_components(rows, 4)


def test_long_texts_inside_longer_ones_are_linked(spark):
    rng = random.Random(8)
    rows = []
    for shingles in [900, 1024, 5000, 20000]:
        for percent in [105, 110, 117, 125, 126]:
            text = words(rng, shingles + 3, 10**9).split()
            more = words(rng, shingles * percent // 100 - shingles, 10**9).split()
            rows += [(len(rows) + 1, " ".join(text)), (len(rows), " ".join(text + more))]
    out = near_dedup.grouped(documents(spark, rows)).collect()
    assert sum(r["kept"] for r in out) == 4 * (4 + 2)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == plain_components(rows, 4)


def test_links_are_confirmed_before_their_components_are_read(spark, capsys):
    text = " ".join(f"w{k}" for k in range(60))
    out = near_dedup.grouped(documents(spark, [text, text + " more", "other words of a short text"]))
    out.explain("formatted")
    plan = capsys.readouterr().out
    # The driver holds and rewrites the plan at every step of the run: no pair of sets may be confirmed in it again.
    assert "array_intersect" not in plan and plan.count("Exchange") < 20
    assert sorted(r["component_id"] for r in out.collect()) == [0, 0, 2]


def test_near_components_of_nothing(spark):
    assert near_dedup.grouped(documents(spark, [])).count() == 0
    assert [r["kept"] for r in near_dedup.grouped(documents(spark, [None, "", None])).collect()] == [True] * 3
