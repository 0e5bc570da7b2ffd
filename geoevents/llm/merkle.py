"""Merkle manifest of a table by time-forward processing: digests travel up to the parents, proof suffixes travel down to the leaves.

Every row is a leaf; leaves of one source stand in a row by ``doc_id`` and every ``ARITY`` consecutive nodes have a parent, up to the
source's subroot. The subroots, in order of their sources, are the leaves of one more tree, whose top is the root.

Nodes are worked on in the order of their labels, and each sends a message to a label that comes later: a child its digest to
its parent on the way up, a parent the proof above it to its children on the way down. The queue of these messages is external: Spark's
sort by (tree, block, position) brings them to the task of a block of ``ARITY ** HEIGHT`` consecutive nodes, on disk where they are many. Only the part of
the queue inside one block is a heap in memory, and a block has a fixed size. Blocks of one source go to many tasks, so no source is too large for a task,
and a stage leaves one node per block: there are log(rows) / log(ARITY ** HEIGHT) stages, each saved before the next.

Null fields have a digest text of their own, so a null and an empty text differ. A null ``source`` is a tree of its own and comes first;
rows with a null ``doc_id`` come first in their source. Rows of one ``doc_id`` are ordered by their digests; wholly equal rows are leaves each.
Texts of any length are hashed in the JVM and never travel further. Other columns of the table are neither hashed nor read, whatever their names. An empty
table has no leaves and gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, running, saved

NAME = "op11_merkle"
ARITY = 3
#: Levels of a block.
HEIGHT = 5
#: What a leaf's digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields in a row: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(one, fields)).cast("binary"), 256)


def parent_digest(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def level_sizes(n: int, height: int, whole: bool) -> list[int]:
    """Nodes per level over ``n`` nodes; a tree that is ``whole`` ends with its first single node, any other block at ``height``."""
    sizes = [n]
    while sizes[-1] > 1 if whole else len(sizes) <= height:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


class Block:
    """Consecutive nodes of a tree and what is above them. Labels count level by level, so parents come after their children."""

    def __init__(self, digests: list[bytes], height: int, whole: bool) -> None:
        self.sizes = level_sizes(len(digests), height, whole)
        self.first = list(accumulate(self.sizes, initial=0))
        self.digest = digests + [b""] * (self.first[-1] - len(digests))
        self.sweep_up()

    def parents(self) -> Iterator[tuple[int, range]]:
        """(label, labels of its children) in rising order."""
        for level in range(1, len(self.sizes)):
            below, end = self.first[level - 1], self.first[level]
            for i in range(self.sizes[level]):
                start = below + i * ARITY
                yield end + i, range(start, min(start + ARITY, end))

    def sweep_up(self) -> None:
        """Child digests go to the parents through a queue ordered by the parent's label."""
        to = {c: label for label, children in self.parents() for c in children}
        queue = [(to[c], c, self.digest[c]) for c in range(self.sizes[0]) if c in to]
        for label, _ in self.parents():
            arrived = []
            while queue and queue[0][0] == label:
                arrived.append(heapq.heappop(queue)[2])
            self.digest[label] = parent_digest(arrived)
            if label in to:
                heapq.heappush(queue, (to[label], label, self.digest[label]))

    @property
    def top(self) -> bytes:
        return self.digest[-1]

    def sweep_down(self, above: list[dict]) -> list[list[dict]]:
        """The proof of every lowest node, from the proof ``above`` the block, through a queue in falling order of labels."""
        queue = [(1 - len(self.digest), above)]
        for label, children in reversed(list(self.parents())):
            _, proof = heapq.heappop(queue)
            texts = [self.digest[c].hex() for c in children]
            for k, c in enumerate(children):
                step = {"left": "".join(texts[:k]), "right": "".join(texts[k + 1 :])}
                heapq.heappush(queue, (-c, [step, *proof]))
        return [proof for _, proof in sorted(queue, key=itemgetter(0), reverse=True)]


def in_blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(tree, block, rows without these two) of a stream sorted by both."""
    rows = chain.from_iterable(zip(*(batch.column(name).to_pylist() for name in ("tree", "block", *names))) for batch in batches)
    for (tree, block), members in groupby(rows, key=itemgetter(0, 1)):
        yield tree, block, [m[2:] for m in members]


def stage_up(nodes: DataFrame, height: int) -> DataFrame:
    """The node above each block: (tree, pos, digest)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in in_blocks(batches, ("digest",)):
            built = Block([d for (d,) in rows], height, whole=block == 0 and len(rows) < ARITY**height)
            yield pa.RecordBatch.from_pylist([{"tree": tree, "pos": block, "digest": built.top}], pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary())]))

    blocks = with_blocks(nodes, height).select("tree", "block", "pos", "digest")
    return blocks.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos").drop("pos").mapInArrow(work, "tree string, pos long, digest binary")


def with_blocks(nodes: DataFrame, height: int) -> DataFrame:
    # Whole numbers: a double would round positions beyond 2 ** 53.
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**height}"))


def stage_down(nodes: DataFrame, above: DataFrame, height: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(tree, pos, digest, subroot, proof, *carry) of all nodes, from (tree, pos, subroot, proof) of the nodes above their blocks."""
    kinds = dict(nodes.dtypes)
    schema = "tree string, pos long, digest binary, subroot binary, proof array<struct<left:string,right:string>>" + "".join(f", `{c}` {kinds[c]}" for c in carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field(c).type for c in carry]
            batches = chain([batch], batches)
            break
        else:
            return
        fields = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("subroot", pa.binary()), ("proof", PATH), *zip(carry, types)])
        for tree, _, rows in in_blocks(batches, ("pos", "digest", "subroot", "proof", *carry)):
            # The message from above has no digest and sorts first.
            (_, _, subroot, proof, *_), members = rows[0], rows[1:]
            built = Block([m[1] for m in members], height, whole=members[0][0] == 0 and len(members) < ARITY**height)
            columns = [[tree] * len(members), [m[0] for m in members], [m[1] for m in members], [subroot] * len(members), built.sweep_down(proof)]
            columns += [[m[4 + k] for m in members] for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    messages = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), "subroot", "proof", *(F.lit(None).cast(kinds[c]).alias(c) for c in carry))
    members = with_blocks(nodes, height).select("tree", "block", "pos", "digest", F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast(dict(above.dtypes)["proof"]).alias("proof"), *carry)
    sent = messages.unionByName(members)
    return sent.repartition(partitions(nodes.sparkSession), "tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(work, schema)


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``, the 0-based place inside ``tree`` by ``order``, for trees of any size and any number of trees."""
    ranged = running(rows, [F.col("tree"), *map(F.col, order)], label)
    sizes = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # A range goes on with at most one tree that began before it, so this has no more rows than there are ranges.
    begun = sizes.select("tree", "_range", F.sum("_size").over(before).alias("_begun")).filter("_begun is not null")
    local = Window.partitionBy("_range", "tree").orderBy(*order)
    numbered = ranged.withColumn("_n", F.row_number().over(local)).join(F.broadcast(begun), ["tree", "_range"], "left")
    return numbered.withColumn("pos", (F.col("_n") - 1 + F.coalesce("_begun", F.lit(0))).cast("long")).drop("_n", "_begun", "_range")


def stages_up(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The given nodes, the nodes above their blocks, and so on until every tree has one node."""
    stages = [nodes]
    while not stages[-1].filter("pos > 0").isEmpty():
        stages.append(saved(stage_up(stages[-1], height), "nodes"))
    return stages


def stages_down(stages: list[DataFrame], above: DataFrame, height: int, carry: tuple[str, ...]) -> DataFrame:
    """Proofs of the first stage's nodes, from those of the trees' tops."""
    for nodes in stages[-2:0:-1]:
        above = saved(stage_down(nodes, above, height).select("tree", "pos", "subroot", "proof"), "proofs")
    return stage_down(stages[0], above, height, carry) if len(stages) > 1 else stages[0].join(above.select("tree", "subroot", "proof"), "tree")


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs`` (the columns FIELDS): doc_id, leaf, subroot, root (hex), proof, and what is carried along.

    ``proof`` holds one step per level, from the leaf to the root: the digests left and right of the node, each joined as text. ``fold`` takes a
    leaf through it. ``carry`` are expressions over ``docs`` by name.
    """
    spark, carry = docs.sparkSession, carry or {}
    named = {f"carried_{k}": c for k, c in enumerate(carry.values())}
    # "0" is the tree of no source, which comes first.
    tree = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string")))
    leaves = docs.select("doc_id", tree.alias("tree"), F.unhex(leaf_digest(*map(F.col, FIELDS))).alias("digest"), *(c.alias(n) for n, c in named.items()))
    own = saved(placed(leaves, ["doc_id", "digest"], "leaves"), "placed")
    up = stages_up(own, height)
    subroots = up[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    sources = saved(placed(subroots, ["source_tree"], "sources"), "subroots")
    over = stages_up(sources, height)
    top = over[-1].first()
    root = top["digest"].hex() if top else None
    above = over[-1].select("tree", "pos", F.col("digest").alias("subroot"), F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("proof"))
    proved = stages_down(over, above, height, ("source_tree",))
    tops = saved(proved.select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "proof"), "tops")
    out = stages_down(up, tops, height, ("doc_id", *named))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", hexed("digest").alias("leaf"), hexed("subroot"), F.lit(root).cast("string").alias("root"), "proof", *(F.col(n).alias(k) for n, k in zip(named, carry)))


def siblings(proof: Column | str) -> Column:
    """All digests of a proof as one text, left to right, from the leaf to the root."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def verified(docs: DataFrame, text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """``manifest`` of ``docs`` with ``folded_root`` and ``verified``, where ``text`` is what each row's text has become since."""
    now = leaf_digest(*(F.col(c) if c != "text" or text is None else text for c in FIELDS))
    proved = manifest(docs, {"leaf_now": F.unhex(now)}, height)
    folded = proved.withColumn("folded_root", fold(F.lower(F.hex("leaf_now")), "proof"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root")).drop("leaf_now")


def tampered() -> Column:
    """The text as tampering leaves it: without line feeds where the checksum of the row's id is even. A null id is never picked."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(picked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digests, its proof, and whether it still leads to the root after the tampering."""
    proved = verified(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=tampered())
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 of a text, one step per byte and eight per bit, as DuckDB has no function for it.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE = """
WITH RECURSIVE picked AS (
  SELECT doc_id, source, lang, n_chars, text,
         CASE WHEN """ + CRC.format(codes="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)") + """ % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now
  FROM documents
), hashed AS (
  SELECT doc_id, coalesce('1' || source, '0') AS tree,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || coalesce(strlen(now) || ':' || now, '-')) AS leaf_now
  FROM picked
), leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, i, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, max(i) OVER (PARTITION BY tree) AS last FROM nodes) WHERE last > 0 GROUP BY tree, level, i // 3
), tops AS (SELECT tree, arg_max(d, level) AS subroot FROM nodes GROUP BY tree),
sources AS (SELECT tree, subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM tops),
over_nodes AS (
  SELECT 0 AS level, i, subroot AS d FROM sources
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, max(i) OVER () AS last FROM over_nodes) WHERE last > 0 GROUP BY level, i // 3
), every AS (SELECT 1 AS part, tree, level, i, d FROM nodes UNION ALL SELECT 2, '', level, i, d FROM over_nodes),
steps AS (
  SELECT part, tree, level, i,
         coalesce(string_agg(d, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || coalesce(string_agg(d, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step,
         level = max(level) OVER (PARTITION BY part, tree) AS is_top
  FROM every WINDOW run AS (PARTITION BY part, tree, level, i // 3 ORDER BY i)
), proofs AS (
  SELECT l.doc_id, l.leaf, l.leaf_now, l.tree, l.i, s.subroot, coalesce(list(p.step ORDER BY p.part, p.level) FILTER (p.step IS NOT NULL), []) AS proof
  FROM leaves l JOIN sources s ON s.tree = l.tree
  LEFT JOIN steps p ON NOT p.is_top AND ((p.part = 1 AND p.tree = l.tree AND p.i = l.i // (3 ** p.level)::BIGINT) OR (p.part = 2 AND p.i = s.i // (3 ** p.level)::BIGINT))
  GROUP BY ALL
), folded AS (
  SELECT *, (SELECT arg_max(d, level) FROM over_nodes) AS root,
         list_reduce(list_prepend(leaf_now, proof), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
  FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
