"""Token counts against the public library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoevents.llm import token_counts as T

from .helpers import ODD, documents

PATH = public_tokenizers.path(T.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter(library):
    known = {t: len(library.encode(t, add_special_tokens=False).ids) for t in ["the", "a", "foo", "'s", "!", "word", "straße"]}
    with open(PATH, encoding="utf-8") as f:
        c = T.TokenCounter(f.read(), T.Table(known))
    c.prepare()
    return c


def same(counter, library, texts):
    got = np.concatenate([counter.counts(pa.array(texts[k : k + 1000])) for k in range(0, len(texts), 1000)]).tolist()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_every_settled_character(counter, library):
    chars = [chr(c) for c in np.flatnonzero(counter.safe)]
    assert len(chars) > 20_000
    same(counter, library, [f"a{c}b {c}{c} 1{c}2 {c}'s" for c in chars])


def test_other_characters_go_by_the_library(counter, library):
    same(counter, library, [f"{chr(c)}a x{chr(c)}" for c in [*range(0x300, 0x3000), *range(0xAC00, 0xAC40), *range(0x1F600, 0x1F640), 0xFFFD, 0x10FFFF]])
    same(counter, library, ["İstanbul", "éa", "ΣΑΣ ΟΔΟΣ", "\U0001f600 smile", "ﬁ ligature", "한국어", "ǅ ŉ", "\x00 \x7f"])


def test_random_texts(counter, library):
    rng = random.Random(3)
    pool = [*"abst'''rvelmd  !?.1234\n\tÉé’ \x1c\x1f\x85中", "'s", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|x", "foo", "the ", "straße"]
    same(counter, library, ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(5000)])


def test_table_tells_all_its_entries_and_no_others():
    rng = random.Random(9)
    known = {"".join(rng.choice("abé\0") for _ in range(rng.randrange(1, 17))): rng.randrange(1, 255) for _ in range(3000)}
    table = T.Table(known)
    asked = [*known, *("".join(rng.choice("abé\0") for _ in range(rng.randrange(1, 20))) for _ in range(3000))]
    assert table.lengths(*T.units_of(asked)).tolist() == [known.get(t, -1) if len(t) <= T.UNITS else -1 for t in asked]


@pytest.mark.parametrize(("table", "rows"), [(T.TABLE, T.SAMPLE_ROWS), (3, 50), (10, 0)])
def test_counts_are_exact_whatever_the_table_holds(spark, library, table, rows):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["The", "quick", "don't", "naïve", "x1y2", "q" * rng.randrange(1, 90), "…", "<|endoftext|>"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["supercalifragilistic " * 120_000]
    docs = documents(spark, texts, extra=True).withColumn("n_tokens", F.lit("clash")).withColumn("token", F.lit(1)).withColumn("k", F.lit(1)).repartition(3)
    out = T.counted(docs, table=table, rows=rows)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["n_tokens"] for r in out.select("doc_id", "n_tokens").collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_repeated_and_missing_ids_and_nothing(spark):
    docs = documents(spark, [(1, "one two"), (1, "one two"), (None, "three"), (2, None)])
    assert sorted(((r["doc_id"] or -1), r["n_tokens"]) for r in T.counted(docs).collect()) == [(-1, 1), (1, 2), (1, 2), (2, 0)]
    assert T.counted(documents(spark, [])).count() == 0


def test_another_cutting_rule_is_refused(counter):
    other = T.TokenCounter(counter.spec.replace('"NFC"', '"NFD"'), T.Table({}))
    with pytest.raises(ValueError, match="cutting rule"):
        other.prepare()
