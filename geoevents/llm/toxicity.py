"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior labels.

Voters are lexicons (fixed lists, and words and word beginnings that labelled rows of either half show) and patterns of style.
The label model is fitted on the vote patterns of all documents and estimates how reliable each voter is and which voters
depend on one another. Its posterior labels on a bounded sample of labelled rows train a linear classifier over words and word beginnings;
that classifier alone scores the texts.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, from at most ``TRAIN_ROWS`` of them, taken by a
hash of the id. Labels, lang, source and doc_id are no inputs of a score. Null texts count as empty and get the score of a text
without words; repeated rows are scored each; of contradicting labels of one id the larger counts. Without labels the fixed lists vote alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, texts
from .linear import LabelModel, platt, sigmoid, sparse_logistic
from .words import LETTERS, Words, find_in, find_words, prefix_hashes, word_hashes

NAME = "op1_toxicity"
#: Labelled rows the classifier is fitted on, and features it may use.
TRAIN_ROWS, FEATURES = 20_000, 4_096
#: Families of features: whole words, and beginnings of so many bytes.
BEGINNINGS = (4, 5, 6)
LEAST_Z, LEAST_ODDS = 3.0, 1.0
#: A lexicon that labelled rows show holds what is toxic at least this often where it stands, and stands in so many toxic rows.
LEAST_PRECISION, LEAST_SUPPORT = 0.75, 3

#: Text that a task hashes at once, in bytes: four families of hashes take some forty times as much.
SLICE_BYTES = 2 << 20

# Insults and words of address, by language.
INSULTS = (
    "stupid idiot idiots moron morons dumb fool loser losers pathetic worthless disgusting trash garbage scum clown filthy vermin imbecile "
    "jerk coward liar freak creep bastard bitch crap damn shit fuck fucking asshole hate kill ugly useless"
).split()
FOREIGN_INSULTS = (
    "idiota idiotas imbécil estúpido estúpida tonto tonta basura asqueroso inútil payaso cabrón mierda puta "
    "idiote imbécile connard connasse salope ordure pathétique débile crétin merde dégoûtant "
    "dumm dummkopf trottel arschloch scheiße abschaum versager widerlich wertlos drecksack schwachkopf"
).split()
ADDRESS = "you your yours tu te toi vous du dich dir ihr eres usted".split()


def hashed(words: list[str]) -> np.ndarray:
    found = find_words(pa.array([" ".join(words)]), LETTERS)
    return np.unique(word_hashes(found))


def families(words: Words) -> list[np.ndarray]:
    return [word_hashes(words), *(prefix_hashes(words, n) for n in BEGINNINGS)]


@dataclass
class Voters:
    """Sorted hash tables: fixed lists and, per half of the labelled rows and family, what that half shows."""

    induced: list[tuple[int, np.ndarray]] = field(default_factory=list)  # (family, table)

    @property
    def size(self) -> int:
        return 5 + len(self.induced)

    def votes(self, array: pa.Array) -> np.ndarray:
        """rows x voters of 0/1."""
        words = find_words(pc.utf8_lower(array), LETTERS)
        rows, n = words.row, len(array)
        hashes = families(words)
        out = np.zeros((n, self.size), dtype=np.int64)
        english, foreign = find_in(hashed(INSULTS), hashes[0]) >= 0, find_in(hashed(FOREIGN_INSULTS), hashes[0]) >= 0
        out[rows[english], 0] = 1
        out[rows[foreign], 1] = 1
        # An insult within three words of a word of address.
        insult, address = np.flatnonzero(english | foreign), np.flatnonzero(find_in(hashed(ADDRESS), hashes[0]) >= 0)
        if len(insult) and len(address):
            near = np.searchsorted(address, insult - 3)
            other = address[np.minimum(near, len(address) - 1)]
            close = (np.abs(other - insult) <= 3) & (rows[other] == rows[insult])
            out[rows[insult[close]], 2] = 1
        out[:, 3] = pc.match_substring_regex(array, "[A-Z]{4,}[^a-z]+[A-Z]{4,}").to_numpy(zero_copy_only=False)
        out[:, 4] = pc.match_substring_regex(array, "[!?]{2,}").to_numpy(zero_copy_only=False)
        for k, (family, table) in enumerate(self.induced):
            out[rows[find_in(table, hashes[family]) >= 0], 5 + k] = 1
        return out


@dataclass
class Model:
    voters: Voters
    labels: LabelModel | None
    tables: list[np.ndarray]  # per family the sorted hashes of its features
    weights: list[np.ndarray]
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, array: pa.Array) -> np.ndarray:
        words = find_words(pc.utf8_lower(array), LETTERS)
        total = np.full(len(array), self.bias)
        for rows, columns, weights in zip(*features(words, self.tables), self.weights):
            total += np.bincount(rows, weights=weights[columns], minlength=len(array))
        return sigmoid(self.slope * total + self.shift)


def features(words: Words, tables: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per family the distinct (row, feature) pairs."""
    all_rows, all_columns = [], []
    row = words.row
    for table, h in zip(tables, families(words)):
        at = find_in(table, h)
        on = np.flatnonzero(at >= 0)
        pairs = np.unique(row[on] * max(1, len(table)) + at[on])
        all_rows.append(pairs // max(1, len(table)))
        all_columns.append(pairs % max(1, len(table)))
    return all_rows, all_columns


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows never learned from; an unknown id is one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(half, y, text) of at most ``limit`` labelled ids, chosen by a hash of the id."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    half = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).cast("int")
    # At most ``limit`` rows of a few bytes.
    return saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(half.alias("half"), "y", "text"), "toxic-train")


def feature_counts(train: DataFrame) -> DataFrame:
    """(family, h, half, pos, neg): rows of either label that have the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for array, _ in pieces(iter([batch.column("text")]), SLICE_BYTES):
                y = batch.column("y").slice(start, len(array)).to_numpy(zero_copy_only=False)
                half = batch.column("half").slice(start, len(array)).to_numpy(zero_copy_only=False)
                start += len(array)
                words = find_words(pc.utf8_lower(array), LETTERS)
                row = words.row
                for family, h in enumerate(families(words)):
                    values, code = np.unique(h, return_inverse=True)
                    pairs = np.unique(code * len(array) + row)
                    code, rows = pairs // max(1, len(array)), pairs % max(1, len(array))
                    for k in (0, 1):
                        pos = np.bincount(code[(half[rows] == k) & (y[rows] == 1)], minlength=len(values))
                        neg = np.bincount(code[(half[rows] == k) & (y[rows] == 0)], minlength=len(values))
                        on = np.flatnonzero(pos)  # only features of some toxic row can speak for toxicity ...
                        off = np.flatnonzero((pos == 0) & (neg > 0))
                        on = np.concatenate([on, off])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(on), family), pa.int32()), pa.array(values[on].view(np.int64)), pa.array(np.full(len(on), k), pa.int32()), pa.array(pos[on], pa.int64()), pa.array(neg[on], pa.int64())],
                            names=["family", "h", "half", "pos", "neg"],
                        )

    counted = train.mapInArrow(count, "family int, h long, half int, pos long, neg long")
    return counted.groupBy("family", "h").agg(*(F.coalesce(F.sum(F.when(F.col("half") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("pos", "neg")))


def odds(pos: Column, neg: Column, up: int, down: int) -> tuple[Column, Column]:
    """Smoothed log odds of a feature, and how many standard errors they are."""
    value = F.log((pos + 0.5) / (up + 1.0)) - F.log((neg + 0.5) / (down + 1.0))
    return value, value / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    train = training_rows(docs, labels, train_rows)
    sizes = {(r["half"], r["y"]): r["n"] for r in train.groupBy("half", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    up, down = [sizes.get((k, 1), 0) for k in (0, 1)], [sizes.get((k, 0), 0) for k in (0, 1)]
    if not sum(up) or not sum(down):
        return fixed_model()
    counts = saved(feature_counts(train), "toxic-counts")
    # What each half shows, at most FEATURES per half and family.
    induced = []
    for k in (0, 1):
        _, z = odds(F.col(f"pos{k}"), F.col(f"neg{k}"), up[k], down[k])
        precise = F.col(f"pos{k}") >= LEAST_PRECISION * (F.col(f"pos{k}") + F.col(f"neg{k}") + 0.5)
        shown = counts.filter(precise & (F.col(f"pos{k}") >= LEAST_SUPPORT)).select("family", "h", z.alias("z")).filter(F.col("z") >= LEAST_Z)
        for family in range(1 + len(BEGINNINGS)):
            rows = shown.filter(F.col("family") == family).orderBy(F.col("z").desc(), "h").limit(FEATURES).collect()
            induced.append((family, np.unique(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))))
    voters = Voters(induced)
    value, z = odds(F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1"), sum(up), sum(down))
    strong = counts.select("family", "h", value.alias("value"), z.alias("z"), (F.col("pos0") + F.col("pos1")).alias("pos")).filter((F.col("z") >= LEAST_Z) & (F.col("value") >= LEAST_ODDS) & (F.col("pos") >= LEAST_SUPPORT))
    rows = strong.orderBy(F.col("z").desc(), "family", "h").limit(FEATURES).collect()
    tables = [np.unique(np.array([r["h"] for r in rows if r["family"] == f], dtype=np.int64).view(np.uint64)) for f in range(1 + len(BEGINNINGS))]
    # Vote patterns: at most 2 ** voters kinds, counted over all documents.
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    patterns = docs.select(voted(shared)(F.col("text")).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    sample = train.select("y", voted(shared)(F.col("text")).alias("pattern"), featured(tables)(F.col("text")).alias("features")).toPandas()
    kinds = sorted({r["pattern"] for r in patterns} | set(sample["pattern"]))
    place = {p: i for i, p in enumerate(kinds)}
    votes = (np.array(kinds, dtype=np.int64)[:, None] >> np.arange(voters.size)) & 1
    labelled = np.zeros((len(kinds), 2))
    np.add.at(labelled, (sample["pattern"].map(place).to_numpy(), sample["y"].to_numpy()), 1)
    unlabelled = np.zeros(len(kinds))
    for r in patterns:
        unlabelled[place[r["pattern"]]] = r["n"]
    model = LabelModel().fit(votes, np.maximum(unlabelled - labelled.sum(axis=1), 0), labelled)
    posterior = model.posterior(votes)[sample["pattern"].map(place).to_numpy(), 1]
    sizes = [len(x) for x in sample["features"]]
    row, column = np.repeat(np.arange(len(sample)), sizes), np.concatenate([np.asarray(x, dtype=np.int64) for x in sample["features"]] or [np.zeros(0, np.int64)])
    width = sum(map(len, tables))
    weights, bias = sparse_logistic(row, column, posterior, width)
    logit = np.bincount(row, weights=weights[column], minlength=len(sample)) + bias
    slope, shift = platt(logit, sample["y"].to_numpy().astype(float))
    cuts = np.cumsum([len(t) for t in tables])[:-1]
    return Model(voters, model, tables, np.split(weights, cuts), bias, slope, shift)


def fixed_model() -> Model:
    """Without labels of both kinds: the fixed lists as one feature each."""
    table = np.unique(np.concatenate([hashed(INSULTS), hashed(FOREIGN_INSULTS)]))
    empty = np.zeros(0, np.uint64)
    return Model(Voters(), None, [table, *[empty] * len(BEGINNINGS)], [np.full(len(table), 2.0), *[np.zeros(0)] * len(BEGINNINGS)], -1.5)


def _by_piece(work, kind: str):
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = []
        for array, last in pieces(arrays, SLICE_BYTES):
            parts.append(work(array))
            if last:
                yield pa.concat_arrays(parts)
                parts = []

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def voted(shared):
    return _by_piece(lambda array: pa.array(shared.value.votes(array) @ (1 << np.arange(shared.value.size)), pa.int64()), "bigint")


def featured(tables: list[np.ndarray]):
    """Feature numbers across all families."""

    def work(array: pa.Array) -> pa.Array:
        rows, columns = features(find_words(pc.utf8_lower(array), LETTERS), tables)
        starts = np.cumsum([0, *map(len, tables)])
        row, column = np.concatenate(rows), np.concatenate([c + s for c, s in zip(columns, starts)])
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(array)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(column[order], pa.int32()))

    return _by_piece(work, "array<int>")


def scored(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row's ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, _by_piece(lambda array: pa.array(shared.value.scores(texts(array)), pa.float64()), "double")(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
