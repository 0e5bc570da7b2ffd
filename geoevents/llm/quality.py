"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view sees shares of characters, kinds of neighbouring characters, repetition and word lengths; the metadata view sees
language, source and recorded length. Each round, both are fitted; each then hands its surest rows of an unlabelled pool to the other
as pseudo-labels. In the end both views are calibrated on labelled rows kept aside, and a small model of the two
calibrated views scores every document.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``TRAIN_ROWS`` of them; the pool has at most
``POOL_ROWS`` other rows. Both are chosen by a hash of the id. Null texts count as empty, a null language or source is a value of its own,
a null length is the number of characters; of contradicting labels of one id the larger counts; repeated rows are scored each. Without
labels of both kinds every document is kept with score 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets_of, pieces, saved
from .linear import newton, platt, sigmoid
from .toxicity import held_out
from .words import SPACED, find_words, word_hashes

NAME = "op9_quality"
TRAIN_ROWS, POOL_ROWS, ROUNDS = 12_000, 12_000, 5
#: A view hands over at most this share of the pool per label and round, and only rows it is this sure of.
HAND_OVER, SURE = 0.05, 0.95
REJECT = 0.5
SOURCES, LANGUAGES, LENGTHS = 64, 16, 16
# Kinds of bytes: lower letter, upper letter, digit, space, line end, sentence mark, other sign, beyond ASCII.
KINDS = np.full(256, 6, dtype=np.int64)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[32], KINDS[10], KINDS[128:] = 0, 1, 2, 3, 4, 7
KINDS[[33, 34, 39, 40, 41, 44, 46, 58, 59, 63]] = 5
TEXT_WIDTH = 128 + 64 + 6
META_WIDTH = SOURCES + LANGUAGES + LENGTHS


def text_view(array: pa.Array) -> np.ndarray:
    """rows x TEXT_WIDTH."""
    n = len(array)
    words = find_words(array, SPACED)
    offsets = offsets_of(array)
    lengths = np.diff(offsets)
    # find_words lowers A-Z, so the bytes are taken afresh.
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), lengths)
    size = np.maximum(lengths, 1)[:, None]
    plain = data < 128
    shares = np.bincount(row[plain] * 128 + data[plain], minlength=n * 128).reshape(n, 128) / size
    kind = KINDS[data]
    same = row[1:] == row[:-1]
    steps = np.bincount((row[1:] * 64 + kind[:-1] * 8 + kind[1:])[same], minlength=n * 64).reshape(n, 64) / size
    h, owner = word_hashes(words), words.row
    counts = np.maximum(words.counts, 1)
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / counts
    order = np.lexsort((h, owner))
    ho, oo = h[order], owner[order]
    fresh = np.ones(len(ho), dtype=bool)
    fresh[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
    distinct = np.bincount(oo[fresh], minlength=n) / counts
    letters = words.end - words.start
    mean = np.bincount(owner, weights=letters, minlength=n) / counts
    long = np.bincount(owner[letters > 25], minlength=n) / counts
    extra = np.stack([again, distinct, mean / 10, long, np.log1p(words.counts) / 10, (words.counts == 0).astype(float)], axis=1)
    return np.hstack([np.log1p(1000 * shares), np.log1p(1000 * steps), extra])


def meta_view(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """rows x META_WIDTH: one mark each for source, language and length."""
    import zlib

    n = len(lang)
    out = np.zeros((n, META_WIDTH))
    slot = lambda value, size: 0 if value is None else 1 + zlib.crc32(str(value).encode("utf-8", "replace")) % (size - 1)
    for start, size, values in ((0, SOURCES, source), (SOURCES, LANGUAGES, lang)):
        coded = pc.dictionary_encode(values)
        kinds = np.array([slot(v, size) for v in coded.dictionary.to_pylist()] or [0])
        at = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[np.arange(n), start + np.where(at < 0, 0, kinds[np.maximum(at, 0)])] = 1
    size = np.log2(1 + np.maximum(chars.fill_null(0).to_numpy(zero_copy_only=False).astype(float), 0))
    out[np.arange(n), SOURCES + LANGUAGES + np.minimum(size.astype(int), LENGTHS - 1)] = 1
    return out


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    blend: np.ndarray

    def scores(self, texts: np.ndarray, metas: np.ndarray) -> np.ndarray:
        a, b = (s * margin(x, w) + c for x, w, (s, c) in ((texts, self.text, self.calibration[0]), (metas, self.meta, self.calibration[1])))
        return sigmoid(np.stack([a, b], axis=1) @ self.blend[:-1] + self.blend[-1])


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def cotrain(texts: np.ndarray, metas: np.ndarray, y: np.ndarray, aside: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y`` is 0, 1 or -1 for rows of the pool; rows ``aside`` calibrate and are not learned from."""
    views = (texts, metas)
    learn, pool = (y >= 0) & ~aside, np.flatnonzero(y < 0)
    labels = [y.astype(float).copy(), y.astype(float).copy()]
    used = [learn.copy(), learn.copy()]
    for _ in range(rounds):
        w = [newton(views[v], labels[v], rows=np.flatnonzero(used[v])) for v in (0, 1)]
        for v in (0, 1):
            p = sigmoid(margin(views[v][pool], w[v]))
            other = 1 - v
            most = max(1, int(HAND_OVER * len(pool)))
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                open_rows = pool[~used[other][pool]]
                certain = sure[~used[other][pool]]
                best = np.argsort(-certain, kind="stable")[:most]
                best = best[certain[best] >= SURE]
                labels[other][open_rows[best]] = value
                used[other][open_rows[best]] = True
    w = [newton(views[v], labels[v], rows=np.flatnonzero(used[v])) for v in (0, 1)]
    check = (y >= 0) & aside
    if len(set(y[check].tolist())) < 2:
        check = y >= 0
    truth = y[check].astype(float)
    margins = [margin(views[v][check], w[v]) for v in (0, 1)]
    fits = tuple(platt(m, truth) for m in margins)
    both = np.stack([s * m + c for m, (s, c) in zip(margins, fits)], axis=1)
    return Model(w[0], w[1], fits, newton(both, truth, ridge=1e-2))


def prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with the inputs of both views in ``_view``; a table may lack lang, source or n_chars."""
    column = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)
    chars = F.coalesce(column("n_chars", "double"), F.length("text").cast("double"), F.lit(0.0))
    return docs.withColumns({"_lang": column("lang", "string"), "_source": column("source", "string"), "_chars": chars})


def views_of(text: pa.Array, lang: pa.Array, source: pa.Array, chars: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    start = 0
    for piece, _ in pieces(iter([text]), 2 << 20):
        n = len(piece)
        if n:
            yield text_view(piece), meta_view(lang.slice(start, n), source.slice(start, n), chars.slice(start, n))
        start += n


def sample(docs: DataFrame, labels: DataFrame, train_rows: int, pool_rows: int) -> DataFrame:
    """(y, aside, view): feature rows of labelled ids and of a pool of others, each a bounded number chosen by a hash of the id."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    others = docs.select("doc_id").filter("doc_id is not null").join(known, "doc_id", "left_anti").distinct()
    chosen = chosen.unionByName(others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool_rows).withColumn("y", F.lit(-1)))
    # At most train_rows + pool_rows rows of a few bytes.
    rows = prepared(docs).join(F.broadcast(saved(chosen, "quality-ids")), "doc_id")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.hstack(v) for v in views_of(*(batch.column(c) for c in ("text", "_lang", "_source", "_chars")))]
            flat = np.concatenate(found).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("aside"), lists], names=["y", "aside", "view"])

    return rows.select("y", aside.alias("aside"), F.coalesce("text", F.lit("")).alias("text"), "_lang", "_source", "_chars").mapInArrow(view, "y int, aside boolean, view array<float>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS) -> Model | None:
    table = sample(docs, labels, train_rows, pool_rows).toArrow()
    y = table.column("y").to_numpy().astype(int)
    if len(set(y[y >= 0].tolist())) < 2:
        return None
    x = table.column("view").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    aside = table.column("aside").to_numpy(zero_copy_only=False).astype(bool)
    del table
    model = cotrain(x[:, :TEXT_WIDTH], x[:, TEXT_WIDTH:], y, aside, rounds)
    del x
    # The driver gives the sample's memory back.
    pa.default_memory_pool().release_unused()
    return model


def scored(docs: DataFrame, model: Model | None, into: str = "quality") -> DataFrame:
    """``docs`` with a score from 0 (reject) to 1 for each row."""
    if model is None:
        return docs.withColumn(into, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(arrays: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, lang, source, chars in arrays:
            found = [shared.value.scores(*v) for v in views_of(text, lang, source, chars)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    score.__annotations__ = {"arrays": Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    ready = prepared(docs)
    column = F.arrow_udf(score, "double")(F.coalesce("text", F.lit("")), F.col("_lang"), F.col("_source"), F.col("_chars"))
    return ready.withColumn(into, column).drop("_lang", "_source", "_chars")


def kept(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``reject``."""
    return scored(docs, fit(docs, labels), "_quality_score").filter(F.col("_quality_score") >= reject).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model, "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).alias("kept"))
