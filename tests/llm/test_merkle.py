"""Digests and proofs of the manifest against trees built by hand."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geoevents.llm import merkle

from .helpers import EXTRA, ODD, SCHEMA


def h(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(*fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 3 * 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def plain(rows, now):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        fields = (doc, source, lang, n)
        groups[(source is not None, (source or "").encode())].append((doc is not None, doc or 0, leaf(*fields, text), leaf(*fields, now(doc, text)), doc))
    trees = []
    for source in sorted(groups):
        groups[source].sort(key=lambda r: r[:3])
        trees.append(levels([r[2] for r in groups[source]]))
    top = levels([t[-1][0] for t in trees])
    out = Counter()
    for k, source in enumerate(sorted(groups)):
        for i, (_, _, own, changed, doc) in enumerate(groups[source]):
            proof = steps(trees[k], i) + steps(top, k)
            for left, right in proof:
                changed = h(left + changed + right)
            out[doc, own, trees[k][-1][0], top[-1][0], tuple(proof), changed] += 1
    return out


def without_lines(doc, text):
    return text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


def check(spark, rows, height, schema=SCHEMA, extra=()):
    out = merkle.verified(spark.createDataFrame([r + extra for r in rows], schema), merkle.tampered(), height).collect()
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"]), r["folded_root"]) for r in out)
    assert got == plain(rows, without_lines)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in out)
    return out


@pytest.mark.parametrize(("height", "n"), [(1, 40), (2, 9), (2, 10), (2, 100), (5, 260)])
def test_proofs_lead_to_the_root(spark, height, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "a\nb", "plain", "\n", "é\n🙂"]), rng.choice(["en", None]), "hot" if i % 3 else rng.choice(["a", "b", "ä", "", None]), i % 7 or None) for i in range(n)]
    out = check(spark, rows, height)
    assert {r["verified"] for r in out} == {True, False}


def test_odd_rows(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(None, "x\ny", None, None, None)] * 3 + [(3, "again\n", "en", "s", 1), (3, "again\n", "en", "s", 1), (3, "other", "en", "s", 1)]
    rows += [(900, "long\n" * 200_000, "de", "other", 5)]
    check(spark, rows, 2, SCHEMA + EXTRA + ", tree string, block long, pos long, digest string, proof int, leaf string, _range int", (0.5, None, "x", "y", "z", 1, "t", 1, 2, "d", 3, "l", 4))


def test_single_leaf_and_none(spark):
    (row,) = merkle.verified(spark.createDataFrame([(4, "t", "en", "s", 1)], SCHEMA)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == leaf(4, "s", "en", 1, "t") and row["proof"] == []
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_source_a_tree(spark):
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(30)]
    check(spark, rows, 2)


def test_a_changed_text_does_not_verify(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 4}", 1) for i in range(50)], SCHEMA)
    out = merkle.verified(docs, F.when(F.col("doc_id") == 17, F.lit("changed")).otherwise(F.col("text")))
    assert [r["doc_id"] for r in out.filter("not verified").collect()] == [17]
