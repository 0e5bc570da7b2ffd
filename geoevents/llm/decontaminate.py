"""Benchmark decontamination: one FM-index per shard of training text, searched backward for the phrases of test items.

Phrases are the windows of ``WINDOW`` consecutive words of an item; a shorter item is one phrase, an item without words none. A
shard is what one task gathers, about ``SHARD_WORDS`` words. Its words become symbols of the phrases' vocabulary; a word that no
phrase has can be in no occurrence, so it only separates, and stretches shorter than the shortest phrase are separators too. All
phrases step backward through wavelet-matrix ranks at once; occurrences are located by sampled suffix positions, and overlapping
or touching ones are merged to removal spans.

The benchmark is taken in blocks of ``BLOCK_BYTES`` of text, each broadcast and searched in a pass of its own over the same rows, so
what is broadcast has a bound. Null texts have no words. Repeated rows count each; an item without an id can hit words but is not listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import offsets_of, pieces
from .fm_index import FMIndex
from .words import ALNUM, find_words, word_hashes

NAME = "op3_decontaminate"
WINDOW = 10
SHARD_WORDS = 1 << 20
SHARD_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
RESULT = "struct<n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int, end:int>>>"


@dataclass
class Phrases:
    vocabulary: np.ndarray  # sorted word hashes; the symbol of entry i is i + 1
    symbols: list[np.ndarray]
    items: list[list[str]]

    @property
    def shortest(self) -> int:
        return min((len(p) for p in self.symbols), default=1)


def phrases_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    words = find_words(pa.array([text or "" for _, text in rows], pa.string()), ALNUM)
    vocabulary, symbols = np.unique(word_hashes(words), return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    owners: dict[bytes, set[str]] = {}
    for (item, _), a, b in zip(rows, words.first[:-1].tolist(), words.first[1:].tolist()):
        size = min(window, b - a)
        for i in range(a, b - size + 1) if size else ():
            owners.setdefault(symbols[i : i + size].tobytes(), set()).update([] if item is None else [item])
    return Phrases(vocabulary, [np.frombuffer(k, np.int64) for k in owners], [sorted(v) for v in owners.values()])


class Slice:
    """Some rows of a shard: the words that can take part in an occurrence, and where they stand."""

    def __init__(self, array: pa.Array, last: bool, phrases: Phrases) -> None:
        words = find_words(array, ALNUM)
        self.rows, self.last, self.n_words, self.bytes = len(array), last, words.counts, len(words.data)
        h, vocabulary = word_hashes(words), phrases.vocabulary
        symbol = np.zeros(len(h), dtype=np.int64)
        if len(vocabulary):
            # A table over the leading 16 bits tells most foreign words at once.
            lead = np.zeros(1 << 16, dtype=bool)
            lead[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
            maybe = np.flatnonzero(lead[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
            symbol[maybe] = np.where(vocabulary[at] == h[maybe], at + 1, 0)
        row = words.row
        known = symbol > 0
        starts = known.copy()
        starts[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(starts)
        stretch = np.cumsum(starts) - 1
        sizes = np.bincount(stretch[known], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        keep = known.copy()
        keep[known] = sizes[stretch[known]] >= phrases.shortest
        kept = np.flatnonzero(keep)
        fresh = np.ones(len(kept), dtype=bool)
        fresh[1:] = (kept[1:] != kept[:-1] + 1) | (row[kept[1:]] != row[kept[:-1]])
        # One separator before each stretch.
        place = np.arange(len(kept)) + np.cumsum(fresh)
        self.text = np.zeros(int(place[-1]) + 1 if len(kept) else 0, dtype=np.int64)
        self.text[place] = symbol[kept]
        self.row = np.full(len(self.text), -1, dtype=np.int64)
        self.row[place] = row[kept]
        points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        # Code points of the row before each kept word's start and up to its end.
        row_start = np.zeros(self.rows, dtype=np.int64)
        offsets = offsets_of(array)
        row_start[:] = points[offsets[:-1] - offsets[0]]
        self.start, self.end = np.zeros(len(self.text), np.int32), np.zeros(len(self.text), np.int32)
        self.start[place] = points[words.start[kept]] - row_start[row[kept]]
        self.end[place] = points[words.end[kept]] - row_start[row[kept]]

    def result(self, hit: np.ndarray, found: list[tuple[int, int]], phrases: Phrases) -> pa.Array:
        """``hit`` marks the symbols of this slice inside an occurrence; ``found`` holds (row, phrase)."""
        items: dict[int, set[str]] = {}
        for row, phrase in found:
            items.setdefault(row, set()).update(phrases.items[phrase])
        n_hit = np.bincount(self.row[hit], minlength=self.rows).astype(np.int64)
        opens, closes = hit.copy(), hit.copy()
        opens[1:] &= ~hit[:-1]
        closes[:-1] &= ~hit[1:]
        rows = self.row[opens]
        spans: dict[int, list] = {}
        for r, a, b in zip(rows.tolist(), self.start[opens].tolist(), self.end[closes].tolist()):
            spans.setdefault(r, []).append({"start": a, "end": b})
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(self.n_words.astype(np.int64)), pa.array(n_hit), pa.array([sorted(items.get(r, ())) for r in range(self.rows)], pa.list_(pa.string())), pa.array([spans.get(r, []) for r in range(self.rows)], kinds)],
            names=["n_words", "n_hit", "items", "spans"],
        )


def search_shard(slices: list[Slice], phrases: Phrases) -> list[pa.Array]:
    text = np.concatenate([s.text for s in slices])
    base = np.concatenate([[0], np.cumsum([len(s.text) for s in slices])])
    cover = np.zeros(len(text) + 1, dtype=np.int64)
    where: list[list[tuple[int, int]]] = [[] for _ in slices]
    if len(text) and phrases.symbols:
        index = FMIndex(text, len(phrases.vocabulary) + 1)
        low, high = index.search(phrases.symbols)
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        if len(found):
            ranks = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            places, phrase = index.locate(ranks), np.repeat(found, counts)
            sizes = np.array([len(p) for p in phrases.symbols])[phrase]
            np.add.at(cover, places, 1)
            np.add.at(cover, places + sizes, -1)
            piece = np.searchsorted(base, places, "right") - 1
            row = np.concatenate([s.row for s in slices])[places]
            for k, r, p in np.unique(np.stack([piece, row, phrase], axis=1), axis=0).tolist():
                where[k].append((r, p))
    hit = np.cumsum(cover)[:-1] > 0
    return [s.result(hit[base[k] : base[k + 1]], where[k], phrases) for k, s in enumerate(slices)]


def search_texts(arrays: Iterator[pa.Array], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[pa.Array]:
    """For each array of texts an array of ``RESULT`` structs."""
    shard: list[Slice] = []
    parts: list[pa.Array] = []

    def finish() -> Iterator[pa.Array]:
        for s, result in zip(shard, search_shard(shard, phrases)):
            parts.append(result)
            if s.last:
                yield pa.concat_arrays(parts)
                parts.clear()
        shard.clear()

    for array, last in pieces(arrays):
        shard.append(Slice(array, last, phrases))
        if sum(len(s.text) for s in shard) >= shard_words or sum(s.bytes for s in shard) >= SHARD_BYTES:
            yield from finish()
    if shard:
        yield from finish()


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leak", block_bytes: int = BLOCK_BYTES, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items (sorted ids), spans (code points, end exclusive, merged).

    With several blocks the spans of each are merged by ``merged``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    names = []
    for k in range(blocks):
        # A block is about block_bytes of text.
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        shared = spark.sparkContext.broadcast(phrases_of(rows, window))
        names.append(f"_leak_{k}")
        docs = docs.withColumn(names[-1], _search(shared, shard_words)(F.col(text)))
    if blocks == 1:
        return docs.withColumnRenamed(names[0], into)
    return docs.withColumn(into, merged(F.array(*names), text)).drop(*names)


def _search(shared, shard_words: int):
    """The search for one block of phrases."""

    def search(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from search_texts(arrays, shared.value, shard_words)

    search.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(search, RESULT)


def merged(parts, text):
    """One result from those of several blocks: spans are united, so words hit by two blocks count once."""

    def unite(parts: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for blocks, body in zip(parts.to_pylist(), texts.to_pylist()):
            spans: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for b in blocks for s in b["spans"]):
                if spans and (s[0] <= spans[-1][1] or not _has_word((body or "")[spans[-1][1] : s[0]])):
                    spans[-1][1] = max(spans[-1][1], s[1])
                else:
                    spans.append(list(s))
            n_hit = sum(int(find_words(pa.array([(body or "")[a:b]]), ALNUM).counts[0]) for a, b in spans)
            out.append({"n_words": blocks[0]["n_words"], "n_hit": n_hit, "items": sorted({i for b in blocks for i in b["items"]}), "spans": [{"start": a, "end": b} for a, b in spans]})
        kinds = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        return pa.array(out, kinds)

    unite.__annotations__ = {"parts": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(unite, RESULT)(parts, text)


def _has_word(gap: str) -> bool:
    return bool(find_words(pa.array([gap]), ALNUM).counts[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window, and the items they come from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )
