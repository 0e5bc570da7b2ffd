"""Trained operators on held-out rows, and the whole pipeline against plain loops."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from geoevents.llm import linear, quality, toxicity

from .helpers import ODD, documents, words, written


def test_label_model_tells_good_voters_from_bad_and_finds_the_copied_one():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    noisy = lambda right: np.where(rng.random(len(y)) < right, y, ~y).astype(int)
    a, b, c = noisy(0.95), noisy(0.85), noisy(0.6)
    twin = np.where(rng.random(len(y)) < 0.97, c, 1 - c)
    votes, back = np.unique(np.stack([a, b, c, twin], axis=1), axis=0, return_inverse=True)
    labelled = np.zeros((len(votes), 2))
    np.add.at(labelled, (back[:300], y[:300].astype(int)), 1)
    unlabelled = np.bincount(back[300:], minlength=len(votes)).astype(float)
    model = linear.LabelModel().fit(votes, unlabelled, labelled)
    assert model.parent[3] == 2 or model.parent[2] == 3
    assert abs(model.prior[1] - 0.2) < 0.05
    right = ((model.posterior(votes)[back, 1] > 0.5) == y).mean()
    assert right > 0.94


def test_logistic_fits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (rng.random(3000) < linear.sigmoid(x @ [2, -1, 0] + 0.5)).astype(float)
    w = linear.newton(x, y)
    assert np.abs(w - [2, -1, 0, 0.5]).max() < 0.3
    slope, shift = linear.platt(x @ [4, -2, 0], y)
    assert abs(slope - 0.5) < 0.1 and abs(shift - 0.5) < 0.2


def toxic_corpus(spark, n=900):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        t, y = words(rng, rng.randint(5, 120)).split(), int(rng.random() < 0.25)
        for _ in range(rng.randint(1, 3) if y else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["idiot", "scum", "moron", "grobnak" + rng.choice("aeiou") + "s"]))
        rows.append((i, " ".join(t)))
        labels.append((i, y, 1))
    odd = [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "stray"), (5, "stray twin of five")]
    labels += [(3, 0, 1), (None, 1, 1), (4, None, 1), (20_000, 1, 1)]
    return rows + odd, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {i: y for i, y, _ in labels[:n]}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    rows, labels, truth = toxic_corpus(spark)
    docs = documents(spark, rows, extra=True)
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model, "toxicity").select("doc_id", "text", "toxicity", toxicity.held_out().alias("held")).collect()
    assert len(out) == len(rows)
    assert all(0 <= r["toxicity"] <= 1 and r["held"] == (r["doc_id"] is None or held(r["doc_id"])) for r in out)
    aside = [r for r in out if r["doc_id"] is not None and r["doc_id"] in truth and held(r["doc_id"]) and r["doc_id"] != 5]
    assert np.mean([(r["toxicity"] >= 0.5) == bool(truth[r["doc_id"]]) for r in aside]) > 0.95
    empty = {r["toxicity"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_every_family_of_either_half_votes(spark, monkeypatch):
    rows, labels, _ = toxic_corpus(spark)
    monkeypatch.setattr(toxicity, "FEATURES", 3)
    induced = toxicity.fit(documents(spark, rows), labels).voters.induced
    assert [family for family, _ in induced] == [0, 1, 2, 3] * 2
    assert all(len(table) == 3 for _, table in induced)


def test_toxicity_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    docs = documents(spark, ["you idiot moron", "fine words", None])
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()}
    assert out[0] > 0.5 > out[1] and out[1] == out[2]
    nothing = documents(spark, [])
    assert toxicity.scored(nothing, toxicity.fit(nothing, none)).count() == 0


def quality_corpus(spark, n=500):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        t, y = words(rng, rng.randint(20, 120)), int(rng.random() < 0.75)
        if not y:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", " | "), t.replace(" ", "### "), " ".join([w for w in t.split() for _ in range(9)])][i % 4]
        rows.append((i, t))
        labels.append((i, y, 0))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_corpus(spark)
    odd = [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "stray")]
    docs = documents(spark, rows + odd, extra=True)
    known = spark.createDataFrame([*labels, (3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.scored(docs, quality.fit(docs, known), "quality").collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["quality"] <= 1 for r in out)
    truth = {i: y for i, y, _ in labels}
    aside = [r for r in out if r["doc_id"] in truth and held(r["doc_id"])]
    assert np.mean([(r["quality"] >= 0.5) == bool(truth[r["doc_id"]]) for r in aside]) > 0.97
    kept = quality.kept(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in out if r["quality"] >= 0.5)


def test_quality_without_labels_or_columns(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark, ODD)
    assert quality.kept(docs, none).count() == len(ODD)
    bare = docs.select("doc_id", "text")
    known = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], "doc_id long, quality int")
    assert quality.scored(bare, quality.fit(bare, known)).count() == len(ODD)
    assert quality.scored(documents(spark, []), quality.fit(documents(spark, []), known)).count() == 0


def test_cotraining_hands_labels_over():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    a, b = y[:, None] * 2 - 1 + rng.normal(size=(2000, 1)) * 0.4, y[:, None] * 2 - 1 + rng.normal(size=(2000, 1)) * 0.4
    shown = np.where(np.arange(2000) < 40, y, -1)
    model = quality.cotrain(a, b, shown, np.arange(2000) % 4 == 0)
    assert ((model.scores(a, b) >= 0.5) == y).mean() > 0.98


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = quality_corpus(spark, 300)
    rng = random.Random(9)
    items = [(k, words(rng, 25, 10_000)) for k in range(5)]
    rows += [(1000 + k, rows[k][1].replace(" ", "  ", 2)) for k in range(0, 60, 3)]
    long = [words(rng, 200, 10_000) for _ in range(5)]
    rows += [(2000 + k, t) for k, t in enumerate(long)] + [(3000 + k, t + " and a little more") for k, t in enumerate(long)]
    rows += [(4000 + k, words(rng, 60) + " " + t + " " + words(rng, 60)) for k, (_, t) in enumerate(items)]
    rows += [(5000, None), (5001, ""), (5002, "one"), (None, "no id " + words(rng, 30))]
    written(spark, documents(spark, rows, extra=True).repartition(3), folder)
    written(spark, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
    written(spark, spark.createDataFrame(items, "item_id long, text string"), folder, "benchmark")
    return str(folder), dict(items)


def test_each_stage_against_plain_loops(spark, corpus, tmp_path):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs.collect()
        docs = written(spark, stage(spark, docs, folder), tmp_path, f"s{k}")
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        seen.append((before, docs.collect()))
    (raw, good), (_, single), (_, near), (_, clean) = seen
    # Quality: nothing well-formed goes, little junk stays although few rows are labelled.
    junk = lambda t: bool(re.search(r"!! |###| \| ", t or "")) or any(a == b == c for a, b, c in zip((t or "").split(), (t or "").split()[1:], (t or "").split()[2:]))
    gone = {r["doc_id"] for r in raw} - {r["doc_id"] for r in good}
    assert sum(not junk(r["text"]) and len((r["text"] or "").split()) > 5 for r in raw if r["doc_id"] in gone) <= 2
    assert sum(junk(r["text"]) for r in good) <= 0.25 * sum(junk(r["text"]) for r in raw)
    first: dict = {}
    for r in good:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        first[key] = min(first.get(key, (10**9, None)), (r["doc_id"] if r["doc_id"] is not None else 10**9, r["doc_id"]), key=lambda x: x[0])
    assert sorted(r["doc_id"] or -1 for r in single) == sorted(i or -1 for _, i in first.values())
    five = {r["doc_id"]: {tuple(w[k : k + 5]) for w in [(r["text"] or "").lower().split()] for k in range(max(1, len(w) - 4)) if w} for r in single if r["doc_id"] is not None}
    stay = {i for i, s in five.items() if not any(j < i and s and five[j] and 100 * len(s & five[j]) >= 80 * len(s | five[j]) for j in five)}
    assert {r["doc_id"] for r in near} == stay | {r["doc_id"] for r in single if r["doc_id"] is None}
    windows = {" ".join(t.split()[k : k + 10]) for t in items.values() for k in range(16)}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near if not any(w in (r["text"] or "") for w in windows)}
    assert len(clean) < len(near)


def test_near_copies_go_row_by_row_where_ids_repeat(spark, tmp_path):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 100, 10_000) for _ in range(4))
    rows = [(1, a), (7, a + " more"), (7, b), (8, c), (8, c + " more"), (9, c + " again"), (8, d), (6, d + " more"), (None, a), (None, a + " more"), (3, None), (3, "")]
    want = sorted([a, b, d + " more", a, a + " more", "", ""])
    for docs in (documents(spark, rows, extra=True), written(spark, documents(spark, rows, extra=True).repartition(3), tmp_path)):
        out = corpus_pipeline.without_near_copies(spark, docs, "")
        assert out.columns == docs.columns
        found = out.collect()
        chosen = [r["text"] for r in found if (r["text"] or "").startswith(c)]
        assert len(chosen) == 1 and chosen[0] in (c, c + " more")
        assert sorted(r["text"] or "" for r in found if not (r["text"] or "").startswith(c)) == want


def test_pipeline_runs_through(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0]).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in out) and 100 < len(out) < 300
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
