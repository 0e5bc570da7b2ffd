"""Near-duplicates by bottom-k sketches: one hash function, inverted lists of retained values, exact Jaccard on full sets.

A text's set holds the hashes of its distinct word shingles (ASCII lower case; words are runs without white space); a text with fewer words
is one shingle, one without words has an empty set and no links. Texts are linked when 100 * intersection >= 80 * union.

1. Equal sets form classes, which go on as one. Each class keeps its ``K`` smallest hashes.
2. Values kept by one class alone cannot link. A class goes on if enough of its kept values are shared to reach the similarity; the
   binomial spread of a sketch is allowed for by ``SPREAD`` standard deviations.
3. The classes that are left take part with their whole sets. Values are put in order of rarity over all these sets; to overlap enough,
   two sets must share one among their rarest few, the fewer the more alike their sizes. Only those go to the inverted lists.
4. In every list the class with fewest values of its own is compared with all others. Members linked to it are in one component, so
   pairs among them are not listed; only members not linked to it meet the rest of the list. A pile of copies thus gives pairs in proportion to its size.
5. Pairs are estimated on the sketch of their union, then confirmed on full sets. Components follow from the links.

Rows are documents of their own, also where ids repeat. Null texts count as empty; rows without an id link with nothing and stay.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import pieces, saved
from .exact_dedup import located
from .words import SPACED, find_words, shingle_sets

NAME = "op10_near_dedup"
SHINGLE, PERCENT = 4, 80
K, SPREAD = 64, 4.0
#: Sizes within this factor share a bucket.
BUCKET = 1.02


def least_shared(k: int) -> int:
    """Values that sketches of k share at least when the sets are similar enough (up to SPREAD deviations)."""
    p = PERCENT / 100
    return math.floor(p * k - SPREAD * math.sqrt(p * (1 - p) * k))


def small_enough(k: int) -> int:
    """Up to this size a set and all sets it can link with are kept whole."""
    return k * PERCENT // 100


def sets_of(docs: DataFrame, shingle: int, whole: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest, n, held, *carry): digest of the set, its size, its K smallest hashes or all of them in rising order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for array, _ in pieces(iter([batch.column("text")])):
                ids, *others = (batch.column(c).slice(start, len(array)) for c in ("doc_id", *carry))
                start += len(array)
                # 63 bits, so that signed comparison keeps the order.
                sets = [np.unique(s >> np.uint64(1)) for s in shingle_sets(find_words(array, SPACED), shingle)]
                held = [s if whole else s[:K] for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in held])])
                values = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)),
                        *others,
                    ],
                    names=["doc_id", "digest", "n", "held", *carry],
                )

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry)
    kinds = "".join(f", {c} {kind}" for c, kind in taken.select(*carry).dtypes)
    return taken.mapInArrow(work, f"doc_id long, digest binary, n long, held array<bigint>{kinds}")


def able(classes: DataFrame) -> DataFrame:
    """Classes (digest, rep) whose kept values are shared often enough for a link to exist."""
    values = classes.select("digest", F.explode("held").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").select("v")
    met = values.join(shared, "v").groupBy("digest").agg(F.count(F.lit(1)).alias("met"))
    need = F.when(F.col("n") <= small_enough(K), F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(least_shared(K)))
    return classes.join(met, "digest").filter(F.col("met") >= need).select("digest", "rep")


def lists(sets: DataFrame) -> DataFrame:
    """Entries of the inverted lists: v, digest, n, own (share of values no other set has), most (largest partner it can serve), bucket."""
    kept = sets.select("digest", "n", F.explode("held").alias("v"))
    shared = kept.groupBy("v").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    met = kept.join(shared, "v")
    # At most the shingles of one text.
    by_set = Window.partitionBy("digest")
    ranked = met.withColumn("common", F.count(F.lit(1)).over(by_set)).withColumn("rank", F.row_number().over(by_set.orderBy("f", "v")))
    place = F.col("n") - F.col("common") + F.col("rank") - 1
    # Sizes a and b need an overlap of PERCENT / (100 + PERCENT) * (a + b); a value at this place leaves at most n - place of it.
    most = (F.col("n") - place) * (100 + PERCENT) / PERCENT - F.col("n")
    entries = ranked.select("v", "digest", "n", ((F.col("n") - F.col("common")) / F.col("n")).alias("own"), most.alias("most"), bucket(F.col("n")).alias("bucket"))
    return entries.filter(F.col("most") * 100 >= F.col("n") * PERCENT)


def bucket(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(BUCKET)).cast("int")


def fits(a: str, b: str) -> Column:
    """Whether two entries can serve one another."""
    return (F.col(f"{a}.most") >= F.col(f"{b}.n")) & (F.col(f"{b}.most") >= F.col(f"{a}.n")) & (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * PERCENT)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: estimated on the union's sketch, then counted on full sets."""
    sketches = sets.select("digest", F.slice("held", 1, K).alias("s"), "n")
    both = pairs.join(sketches.toDF("a", "sa", "na"), "a").join(sketches.toDF("b", "sb", "nb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    found = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # Sets kept whole need no allowance.
    least = F.when(F.col("na") + F.col("nb") <= K, F.size(union) * PERCENT / 100).otherwise(F.least(F.lit(least_shared(K)), F.size(union) * PERCENT / 100))
    likely = both.filter(found >= least).select("a", "b")
    full = sets.select("digest", "held", "n")
    exact = likely.join(full.toDF("a", "ha", "na"), "a").join(full.toDF("b", "hb", "nb"), "b")
    inter = F.size(F.array_intersect("ha", "hb"))
    return exact.filter(inter * 100 >= (F.col("na") + F.col("nb") - inter) * PERCENT).select("a", "b")


def links(sets: DataFrame) -> DataFrame:
    """Confirmed pairs (a, b) of digests that connect all that is linked, saved: their users read them several times, and would plan and find them anew each time."""
    entries = saved(lists(sets), "lists")
    centre = entries.groupBy("v").agg(F.min(F.struct("own", "digest", "n", "most")).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    centres = saved(centre.select("v", F.col("c.digest").alias("digest"), F.col("c.n").alias("n"), F.col("c.most").alias("most")), "centres")
    members = entries.alias("x").join(centres.alias("c"), "v").filter(F.col("x.digest") != F.col("c.digest"))
    near = members.filter(fits("x", "c")).select(*ordered("x.digest", "c.digest")).distinct()
    first = saved(confirmed(near, sets), "links")
    # Entries that are not linked to the centre of their list meet the whole list.
    linked = first.select(F.col("a").alias("x"), F.col("b").alias("y")).union(first.select("b", "a"))
    placed = members.select("v", F.col("x.digest").alias("digest"), F.col("x.n").alias("n"), F.col("x.most").alias("most"), F.col("x.bucket").alias("bucket"), F.col("c.digest").alias("centre"))
    loose = saved(placed.join(linked, (F.col("digest") == F.col("x")) & (F.col("centre") == F.col("y")), "left_anti"), "loose")
    low, high = bucket(F.col("n") * PERCENT / 100), bucket(F.least(F.col("most"), F.col("n") * 100 / PERCENT))
    visits = loose.withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, high))))
    met = visits.alias("x").join(placed.alias("y"), ["v", "bucket"]).filter((F.col("x.digest") != F.col("y.digest")) & fits("x", "y"))
    rest = met.select(*ordered("x.digest", "y.digest")).distinct()
    return first.union(saved(confirmed(rest, sets), "rest-links"))


def placed_rows(docs: DataFrame, shingle: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, *carry): doc_id, n, *carry, component, root, alone.

    ``component`` tells components apart, also where ids repeat; ``root`` is the smallest id in it.
    """
    rows = saved(sets_of(docs, shingle, whole=False, carry=carry), "sketches")
    some = rows.filter("n > 0 and doc_id is not null")
    classes = saved(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("held").alias("held")), "classes")
    chosen = saved(able(classes), "able")
    # The texts of the classes that are left, to take their sets whole.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    whole = sets_of(texts, shingle, whole=True).join(chosen.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    sets = saved(whole.groupBy("digest").agg(F.first("n").alias("n"), F.first("held").alias("held")), "sets")
    found = links(sets)
    roots = components(found, "a", "b").toDF("digest", "root")
    named = saved(roots.join(chosen.select("digest", "rep"), "digest"), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked = named.join(least, "root").select("digest", "least", F.col("root").alias("component"))
    home = classes.select("digest", "rep").join(linked, "digest", "left").select("digest", F.coalesce("component", "digest").alias("component"), F.coalesce("least", "rep").alias("root"))
    placed = rows.select("doc_id", "n", "digest", *carry).join(home, "digest", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    root = F.when(alone, F.col("doc_id")).otherwise(F.col("root"))
    return placed.select("doc_id", "n", *carry, "component", root.alias("root"), alone.alias("alone"))


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    placed = placed_rows(docs, shingle)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("alone") | (F.col("doc_id") == F.col("root"))).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per component, of the smallest id and, where it repeats, the first place."""
    marked = docs
    try:
        docs.select("_metadata.file_path")
    except AnalysisException:
        marked = saved(docs, "content")
    rows = saved(placed_rows(located(marked), shingle, ("file", "row")).filter("not alone"), "placed")
    # Only components whose smallest id repeats need a choice by place.
    firsts = rows.filter("doc_id = root").groupBy("component").agg(F.min(F.struct("file", "row")).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    later = rows.filter("doc_id = root").join(firsts, "component").filter((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row")))
    dropped = rows.filter("doc_id <> root").select("file", "row").union(later.select("file", "row")).toDF("_file", "_row")
    placed = marked.select("*", F.col("_metadata.file_path").alias("_at_file"), F.col("_metadata.row_index").alias("_at_row"))
    gone = (F.col("_at_file") == F.col("_file")) & (F.col("_at_row") == F.col("_row"))
    return placed.join(dropped, gone, "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its component."""
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
