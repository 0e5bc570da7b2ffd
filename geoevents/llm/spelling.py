"""Spelling variants: frequent words that differ by one code point, found through words written in a reduced alphabet.

1. Words of all texts are counted; each task adds up its own rows before the shuffle.
2. A letter is hashed to one of ``SYMBOLS`` symbols. Words one edit apart have reduced forms that are equal or one edit apart.
3. For every distinct reduced form the full one-edit neighbourhood is generated (deletions, replacements, insertions), as rolling hashes of the neighbours. Being
   neighbours is mutual, so of two forms the one with the smaller hash names the other, and only these keys are kept.
4. The keys are joined with the reduced vocabulary, forms are resolved to their words, and the words themselves decide (edit distance exactly one).

A word's form is the most frequent word near it if that is at least ``TIMES`` as frequent; the root is the end of the chain of forms. Numbers at least double
along a chain, so it has no circles and no more than log2 of the largest number of links; pointers double each round, so few rounds settle all.

The vocabulary is spread by the words' hashes; a reduced form that many words share is cut into slices of about ``SLICE_WORDS`` words, so pairs of slices are what a
task works on. Near words of one word are few (all its one-edit variants at most), whatever the corpus.

Null texts hold no words. Words of any length count: the neighbourhood of a very long run is generated in numpy from prefix hashes, not as strings. Repeated rows and
repeated ids count each for themselves; a row without an id is never altered (there is no number to draw). Ties are broken by code-point order. Other columns are
not read, whatever their names. An empty table gives no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved
from .merkle import CRC
from .words import C1, C2, mix

NAME = "op13_spelling"
LEAST_LETTERS, LEAST_TIMES, TIMES = 5, 3, 2
#: Symbols of the reduced alphabet.
SYMBOLS = 8
SLICE_WORDS = 64
#: One in ALTERED occurrences is misspelt on purpose, see ``noisy``.
ALTERED = 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_LETTER = r"[^a-zÀ-ÿ]+"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters in the texts, A-Z lowered."""
    low = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.split(low, NO_LETTER)).alias("run")).filter(F.length("run") >= LEAST_LETTERS)


def noisy(run: Column, doc_id: Column) -> Column:
    """The run, or for one in ALTERED of (id, run) the run without one code point that the same number picks."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % ALTERED == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    return words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def symbols_of(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) * C1 + C2) % np.uint64(SYMBOLS)


def rolled(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes (one more than symbols) and the powers that shift them."""
    n = len(symbols)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, C1)]), dtype=np.uint64)
    # A polynomial in 2 ** 64 from the front: symbol i weighs power[i]; 1 is added so that no symbol is nothing.
    terms = (symbols + np.uint64(1)) * power[:n]
    return np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)]), power


def key(total: np.ndarray, size) -> np.ndarray:
    return mix(total ^ (np.asarray(size, dtype=np.uint64) * C2)).astype(np.int64)


def neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Keys of all forms one edit away: deletions, replacements, insertions, without repeats."""
    n = len(symbols)
    prefix, power = rolled(symbols)
    rest = prefix[-1] - prefix  # weight of everything from i on
    every = np.arange(SYMBOLS, dtype=np.uint64)[:, None] + np.uint64(1)
    inverse = np.uint64(pow(int(C1), -1, 1 << 64))
    i = np.arange(n)
    deleted = key(prefix[i] + rest[i + 1] * inverse, n - 1)
    replaced = prefix[i] + rest[i + 1] + every * power[i]
    replaced = key(replaced[every != symbols[i] + np.uint64(1)], n)
    j = np.arange(n + 1)
    inserted = key((prefix[j] + every * power[j] + rest[j] * C1).ravel(), n + 1)
    return np.unique(np.concatenate([deleted, replaced, inserted]))


def form_key(symbols: np.ndarray) -> int:
    return int(key(rolled(symbols)[0][-1:], len(symbols))[0])


def reduced(words: DataFrame) -> DataFrame:
    """(word, n, form): the key of each word's reduced form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [form_key(symbols_of(np.frombuffer(w.encode("utf-32-le"), np.uint32))) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(forms, pa.int64())], names=["word", "n", "form"])

    return words.mapInArrow(work, "word string, n long, form long")


def meeting_forms(words: DataFrame) -> DataFrame:
    """(a, b): reduced forms one edit apart, a < b, of which both belong to words. One word stands for its form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends, start = [], [0], 0
            forms, texts = batch.column("form"), batch.column("word").to_pylist()
            for k, (form, word) in enumerate(zip(forms.to_pylist(), texts)):
                keys = neighbourhood(symbols_of(np.frombuffer(word.encode("utf-32-le"), np.uint32)))
                keys = keys[keys > form]
                found.append(keys)
                ends.append(ends[-1] + len(keys))
                if ends[-1] > 1 << 18 or k == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(forms.slice(start, k + 1 - start).to_numpy(zero_copy_only=False), np.diff(ends))), pa.array(np.concatenate(found))], names=["a", "b"])
                    found, ends, start = [], [0], k + 1

    # Different words of one form have the same neighbourhood, so any of them will do.
    forms = words.groupBy("form").agg(F.min("word").alias("word"))
    pairs = forms.select("form", "word").repartition(partitions(words.sparkSession)).mapInArrow(work, "a long, b long")
    return pairs.join(forms.select(F.col("form").alias("b")), "b")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all ordered pairs of words (word, form) that differ by one code point."""
    slices = F.ceil(F.col("held") / SLICE_WORDS).cast("int")
    sized = words.groupBy("form").agg(F.count(F.lit(1)).alias("held")).withColumn("slices", slices).drop("held")
    sliced = words.join(sized, "form").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int"))
    sliced = saved(sliced.select("word", "form", "slice", "slices"), "sliced")
    forms = sliced.groupBy("form").agg(F.max("slices").alias("slices"))
    apart = meeting_forms(words)
    met = apart.select("a", "b").union(forms.select("form", "form"))
    # Both forms' slices meet pair by pair; of a form with itself, each pair of slices once.
    placed = met.join(forms.toDF("a", "na"), "a").join(forms.toDF("b", "nb"), "b")
    blocks = placed.withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    blocks = blocks.withColumn("sb", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("sa")).otherwise(0), F.col("nb") - 1)))
    left, right = sliced.select("word", "form", "slice").toDF("x", "a", "sa"), sliced.select("word", "form", "slice").toDF("y", "b", "sb")
    pairs = blocks.select("a", "b", "sa", "sb").join(left, ["a", "sa"]).join(right, ["b", "sb"])
    own = (F.col("a") != F.col("b")) | (F.col("sa") != F.col("sb")) | (F.col("x") < F.col("y"))
    near = pairs.filter(own & (F.levenshtein("x", "y", 1) == 1)).select("x", "y")
    return near.union(near.select("y", "x")).toDF("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round every pointer jumps to where its target points."""
    at = saved(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        # A target is pointed to by its near words only, which are few.
        step = saved(at.join(at.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, times: float = TIMES) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n, root."""
    held = saved(reduced(words), "words")
    near = near_words(held)
    counts = held.select("word", "n")
    met = near.join(counts.toDF("near", "near_n"), "near")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    judged = counts.join(best, "word", "left").withColumn("near_n", -F.col("best.less"))
    holds = F.col("near_n") >= times * F.col("n")
    judged = saved(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words, form and root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = runs(docs).select(F.coalesce(noisy(F.col("run"), F.col("doc_id")), "run").alias("word"))
    return variants(vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), held AS (SELECT doc_id, run, count(*) AS times FROM found WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, times, doc_id || ':' || run AS said, [ord(c) FOR c IN string_split(doc_id || ':' || run, '')] AS codes FROM held),
hashed AS (SELECT run, times, coalesce(""" + CRC.format(codes="flatten([CASE WHEN c < 128 THEN [c::BIGINT] ELSE [(192 + (c >> 6))::BIGINT, (128 + (c & 63))::BIGINT] END FOR c IN codes])") + r""", 1) AS h FROM coded),
noisy AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT DISTINCT word, n, CASE WHEN k = 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS rest FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, a.n, b.n AS near_n FROM cut a JOIN cut b USING (rest)
  WHERE a.word <> b.word AND levenshtein(a.word, b.word) <= 2 AND (
    length(a.word) = length(b.word) AND len([1 FOR i IN range(1, length(a.word) + 1) IF substr(a.word, i, 1) <> substr(b.word, i, 1)]) = 1
    OR length(a.word) = length(b.word) + 1 AND b.word = rest OR length(b.word) = length(a.word) + 1 AND a.word = rest)
), best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS reached, 0 AS step FROM forms UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word) r USING (word)
"""
