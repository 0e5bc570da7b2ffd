"""Request feeds by blocks: equal configs are one, and a task scores a block of configs against a block of events of one layer.

The scores worked out here are only a sieve. They lie within ``MARGIN`` of the exact ones, so of a block every event stays that can be among the first of a config; the exact score
of these few is worked out by the expressions of ``functions.score`` afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo as G
from ..functions import score as M

CONFIG_BLOCK, EVENT_BLOCK, CHUNK = 1_024, 8_192, 128
#: Scores are rounded to six places.
MARGIN = 2e-6


def asked_key(names: list[str]):
    """The same key for configs that ask for the same."""
    return F.sha2(F.to_json(F.struct(*names)), 256)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)


def units(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Points on the unit sphere."""
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)


def first_copies(fields: list[np.ndarray], ids: list[str], n: int) -> np.ndarray:
    """Positions of the rows that are among the first ``n`` by id of those equal in all fields; no feed of ``n`` shows more of them."""
    rank = np.argsort(np.argsort(np.array(ids, dtype=object), kind="stable"))
    order = np.lexsort((rank, *fields))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for f in fields:
        new[1:] |= f[order][1:] != f[order][:-1]
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return np.sort(order[place < n])


def keyword_table(keywords: list, texts: list[str], words: list) -> tuple[np.ndarray, dict]:
    """(hits of every different keyword in every different text, row of a keyword)."""
    where: dict[str, list[int]] = {}
    for i, tokens in enumerate(words):
        for t in tokens or []:
            where.setdefault(t, []).append(i)
    rows: dict[tuple, int] = {}
    for k in (k for ks in keywords for k in ks or []):
        rows.setdefault((k["phrase"], tuple(k["parts"] or ())), len(rows))
    hits = np.zeros((len(rows), len(texts)))
    for (phrase, parts), r in rows.items():
        for p in parts:
            hits[r, where.get(p, [])] = 0.5
        if phrase is not None:
            hits[r, [i for i, t in enumerate(texts) if phrase in t]] = 1.0
    return hits, rows


def best_of_block(configs: pa.Table, events: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(config, event): positions of every pair that can be among the first ``n`` of the config."""
    none = np.zeros(0, dtype=np.int64)
    if not len(configs) or not len(events):
        return none, none
    known: dict[str, int] = {}
    first: list[int] = []
    text_of = np.zeros(len(events), dtype=np.int64)
    for i, t in enumerate(events["full"].to_pylist()):
        if t not in known:
            known[t] = len(known)
            first.append(i)
        text_of[i] = known[t]
    lat, lng, significance, base = (numbers(events[c]) for c in ("lat", "lng", "significance", "base"))
    kept = first_copies([lat, lng, significance, base, text_of], events["id"].to_pylist(), n)
    lat, lng, significance, base, text_of = lat[kept], lng[kept], significance[kept], base[kept], text_of[kept]
    wanted = configs["keywords"].to_pylist()
    hits, row = keyword_table(wanted, list(known), events["tokens"].take(pa.array(first)).to_pylist())
    placed = np.isfinite(lat) & np.isfinite(lng)
    spot = units(np.where(placed, lat, 0.0), np.where(placed, lng, 0.0))
    floor = numbers(configs["floor"])
    points = configs["coordinates"].to_pylist()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(configs), CHUNK):
        part = range(a, min(a + CHUNK, len(configs)))
        share = np.full((len(part), len(known)), 0.5)
        # Neutral without coordinates; an unknown place is half the world away.
        near = np.repeat([0.0 if points[u] else 0.5 for u in part], len(lat)).reshape(len(part), len(lat))
        for i, u in enumerate(part):
            if wanted[u]:
                share[i] = np.minimum(1.0, hits[[row[k["phrase"], tuple(k["parts"] or ())] for k in wanted[u]]].sum(axis=0) / len(wanted[u]))
        usable = [[p for p in points[u] or [] if p and p["lat"] is not None and p["lng"] is not None] for u in part]
        for j in range(max(map(len, usable))):
            rows = [i for i, ps in enumerate(usable) if len(ps) > j]
            at = units(np.array([usable[i][j]["lat"] for i in rows]), np.array([usable[i][j]["lng"] for i in rows]))
            score = np.maximum(0.0, 1.0 - G.EARTH_KM * np.arccos(np.clip(at @ spot.T, -1.0, 1.0)) / M.COORD_SCORE_MAX_KM)
            score[:, ~placed] = 0.0
            near[rows] = np.maximum(near[rows], score)
        total = M.W_COORD * near + M.W_KEYWORD * share[:, text_of] + base
        total[np.isnan(total)] = np.inf
        total[~(significance >= floor[a : part.stop, None])] = -np.inf
        if len(lat) > n:
            limit = np.partition(total, len(lat) - n, axis=1)[:, len(lat) - n] - MARGIN
        else:
            limit = np.full(len(part), -np.inf)
        i, e = np.nonzero((total >= limit[:, None]) & (total > -np.inf))
        found.append((i + a, kept[e]))
    return np.concatenate([i for i, _ in found]), np.concatenate([e for _, e in found])


def sieved(wanted: DataFrame, events: DataFrame, n: int, config_block: int = CONFIG_BLOCK, event_block: int = EVENT_BLOCK) -> DataFrame:
    """Configs beside all events of their layer that can be among their first ``n``, and few others.

    wanted: asked, layer_id, keywords (prepared), coordinates, floor; events: id, layer_id, lat, lng, significance, base (what is the same for everybody), tokens, full, and more.
    """
    blocks = lambda df, size, name: df.groupBy("layer_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    # One row per layer.
    sizes = blocks(wanted, config_block, "config_blocks").join(blocks(events, event_block, "event_blocks"), "layer_id")
    own = lambda column, count: F.pmod(F.xxhash64(column), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = wanted.join(sizes, "layer_id").select(F.col("layer_id").alias("_layer"), own("asked", "config_blocks").alias("cb"), every("event_blocks").alias("eb"), *[c for c in wanted.columns if c != "layer_id"])
    right = events.join(sizes, "layer_id").select("layer_id", every("config_blocks").alias("cb"), own("id", "event_blocks").alias("eb"), *[c for c in events.columns if c != "layer_id"])
    asked, shown = ["asked", "keywords", "coordinates"], [c for c in events.columns if c not in ("layer_id", "base")]
    schema = T.StructType([wanted.schema[c] for c in asked] + [events.schema[c] for c in shown])

    def work(configs: pa.Table, rows: pa.Table) -> pa.Table:
        c, e = best_of_block(configs, rows, n)
        mine, theirs = configs.select(asked).take(pa.array(c)), rows.select(shown).take(pa.array(e))
        return pa.Table.from_arrays([*mine.columns, *theirs.columns], names=[*asked, *shown])

    met = left.groupBy("_layer", "cb", "eb").cogroup(right.groupBy("layer_id", "cb", "eb"))
    return met.applyInArrow(work, schema)
