"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoevents.llm import spelling as S

from .helpers import ODD, documents


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain(counts, times=2):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= times * counts[w]:
                form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form.get(w), counts.get(form.get(w)), root)
    return out


def result(spark, counts):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in S.variants(words).collect()}


def test_neighbourhood_holds_every_edit_of_the_reduced_word():
    rng = np.random.default_rng(1)
    for n in [1, 2, 5, 9]:
        symbols = rng.integers(0, S.SYMBOLS, n).astype(np.uint64)
        edits = [np.delete(symbols, i) for i in range(n)] + [np.insert(symbols, j, np.uint64(s)) for j in range(n + 1) for s in range(S.SYMBOLS)]
        edits += [np.concatenate([symbols[:i], np.array([s], np.uint64), symbols[i + 1 :]]) for i in range(n) for s in range(S.SYMBOLS) if s != symbols[i]]
        assert set(S.neighbourhood(symbols).tolist()) == {S.form_key(e) for e in edits}


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice("abcdefgàé") for _ in range(rng.randrange(5, 9)))
        for _ in range(6):
            counts[word] = rng.choice([3, 4, 6, 12, 13, 50, 200])
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1 :] or "a", word[:k] + rng.choice("abxÿ") + word[k:], word[:k] + rng.choice("abxÿ") + word[k + 1 :]])
    counts |= {"x" * 3000: 3, "x" * 3001: 9, "x" * 1500 + "y" + "x" * 1499: 4}
    assert result(spark, counts) == plain(counts)


def test_long_chains_and_ties(spark):
    counts = {"a" * (5 + k): 3 * 2**k for k in range(40)} | {"words": 5, "wordz": 10, "wordx": 10, "worda": 9}
    got = result(spark, counts)
    assert got == plain(counts)
    assert got["aaaaa"][4] == "a" * 44 and got["words"][2] == "wordx"


def test_a_reduced_form_of_many_words_is_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_WORDS", 4)
    counts = {"".join(w): 3 + k for k, w in enumerate({tuple(random.Random(i).choice("abc") for _ in range(5)) for i in range(400)})}
    assert result(spark, counts) == plain(counts)


def test_words_of_documents(spark):
    rng = random.Random(6)
    pool = ["Straße", "STRASSE", "Wörter", "wörter", "letters", "letterz", "don't", "x×y÷zzz", "naïveté", "ab", "日本語words"]
    rows = [*enumerate(ODD), *((100 + i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(60)), (100, "letters " * 500), (None, "letters lettres " * 5), (7, "letters " * 3)]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    docs = documents(spark, rows, extra=True).withColumn("word", F.lit("clash")).withColumn("run", F.lit(1)).withColumn("form", F.lit(2))
    words = S.vocabulary(S.runs(docs).select(F.coalesce(S.noisy(F.col("run"), F.col("doc_id")), "run").alias("word")))
    assert {r["word"]: r["n"] for r in words.collect()} == {w: n for w, n in counts.items() if n >= 3}


def test_no_words(spark):
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert result(spark, {"alone": 3}) == {"alone": (3, 0, None, None, "alone")}
