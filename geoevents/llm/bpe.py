"""Byte-level BPE over a given vocabulary, encoding and decoding, in two tiers.

A minimal perfect hash over the vocabulary's byte strings resolves every pre-token that is a token as a whole: one probe and one
comparison. The others are merged from single bytes, lowest rank first and leftmost among equals, with a heap over a linked list.
Nothing is trained; the file of ranks is a parameter, read on the driver and broadcast (its size is that of the vocabulary).

Null texts count as empty and give no ids. Special tokens do not exist: their strings are ordinary text. Null or foreign ids cannot be decoded
and raise an error; a null list of ids decodes to no bytes.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces
from .words import C1, hashes, mix

NAME = "op4_bpe"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A worker remembers at most so many pre-tokens of at most so many characters; the rest is worked out again.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
#: Ids that are decoded in one step.
AT_ONCE = 1 << 16


class PerfectHash:
    """Minimal perfect hash by hash and displace: a bucket's displacement sends its keys to free slots of exactly n."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n)
        h = self.base(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        free = np.ones(self.n, dtype=bool)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slot = np.zeros(self.n, dtype=np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            todo, d = np.flatnonzero(sizes == size), 0
            while len(todo):
                d += 1
                members = order[starts[todo][:, None] + np.arange(size)]
                at = self.slots(h[members], d)
                # Of buckets that want the same slot the first has it, the others try the next displacement.
                _, first, which = np.unique(at, return_index=True, return_inverse=True)
                holder = first[which].reshape(at.shape) // size
                own = (holder == np.arange(len(todo))[:, None]).all(axis=1) & free[at].all(axis=1)
                ordered = np.sort(at, axis=1)
                own &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                free[at[own]] = False
                slot[members[own]], self.shift[todo[own]] = at[own], d
                todo = todo[~own]
        # A bucket of one key names its slot directly.
        single = np.flatnonzero(sizes == 1)
        slot[order[starts[single]]] = rest = np.flatnonzero(free)
        self.shift[single] = -1 - rest
        self.key_at = np.empty(self.n, dtype=np.int64)
        self.key_at[slot] = np.arange(self.n)

    @staticmethod
    def base(keys: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        return hashes(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def slots(self, h: np.ndarray, shift) -> np.ndarray:
        return (mix(h ^ np.asarray(shift, dtype=np.int64).astype(np.uint64) * C1) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """Number of the only key of the set that each given one can equal."""
        h = self.base(keys)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.key_at[np.where(shift < 0, -1 - shift, self.slots(h, np.maximum(shift, 0)))]


class Decoder:
    """The bytes of every token, end to end."""

    def __init__(self, ranks: dict[bytes, int], size: int) -> None:
        by_id = [b""] * size
        for t, i in ranks.items():
            by_id[i] = t
        self.length = np.fromiter(map(len, by_id), dtype=np.int64, count=size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all lists of ids in a row and the number of bytes of each list. Some ``AT_ONCE`` ids are looked up at a time, whatever the lists' lengths."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        ends = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.length[ids], out=ends[1:])
        data = np.empty(ends[-1], dtype=np.uint8)
        for start in range(0, len(ids), AT_ONCE):
            some, first, last = ids[start : start + AT_ONCE], ends[start], ends[min(start + AT_ONCE, len(ids))]
            source = np.repeat(self.offset[some] - ends[start : start + len(some)], self.length[some]) + np.arange(first, last)
            data[first:last] = self.bytes[source]
        limits = ends[np.concatenate([[0], np.cumsum(counts)])]
        return data, np.diff(limits)


class Codec:
    def __init__(self, lines: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.tokens = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), dtype=np.int64, count=len(self.tokens))
        self.whole = self.ids.astype(np.int32).tobytes()
        self.perfect = PerfectHash(self.tokens)
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.decoder = Decoder(self.ranks, size)
        self.pattern = pattern
        self.size = size
        ranks = self.ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Tokens by the two tokens they can be joined from.
        joins = {ranks[t[:k]] * size + ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.join_keys = np.sort(np.fromiter(joins, dtype=np.int64, count=len(joins)))
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], dtype=np.int64)
        self.doubles = self.joined(np.repeat(self.single, 256), np.tile(self.single, 256))
        # Ids as the bytes of int32 numbers: a third of the memory of tuples, and joined without a Python number per id.
        self.memory: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memory": {}}

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each two neighbours make, -1 if none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == keys, self.join_ids[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (bytes of int32 numbers) of pieces that are no tokens as a whole, all merged side by side.

        The bytes of all pieces are one linked list with a break after each piece. A heap holds the ranks of joins that are open; the
        lowest rank is taken and joined wherever it stands, leftmost first where two places overlap. Pieces don't touch, so each goes through
        the joins it would go through alone, as long as no join opens one of a lower rank; where one does, the piece is merged on its own.
        """
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        n = len(data)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        ends = np.cumsum(sizes)
        part = self.single[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1], before[(ends - sizes)[sizes > 0]] = -1, -1
        pair = np.full(n, -1, dtype=np.int64)
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.doubles[data[inner] * 256 + data[inner + 1]]
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            heads = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for r, some in zip(ranks[heads].tolist(), np.split(places, heads[1:])):
                if r in waiting:
                    waiting[r].append(some)
                else:
                    waiting[r] = [some]
                    heappush(heap, r)

        if len(open_ := np.flatnonzero(pair >= 0)):
            note(open_)
        odd: set[int] = set()
        while heap:
            r = heappop(heap)
            lists = waiting.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[pair[at] == r]
            if not len(at):
                continue
            other = after[at]
            touching = other[:-1] == at[1:]
            if touching.any():
                k = np.arange(len(at))
                alternate = (k - np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), k, 0))) % 2 == 0
                at, other = at[alternate], other[alternate]
            beyond = after[other]
            part[at], part[other] = r, -1
            pair[at] = pair[other] = -1
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            ahead = before[at]
            left = np.unique(np.concatenate([at[more], ahead[ahead >= 0]]))
            if len(left):
                pair[left] = new = self.joined(part[left], part[after[left]])
                if len(left := left[new >= 0]):
                    note(left)
                    if new[new >= 0].min() < r:
                        odd |= set(owner[left[pair[left] < r]].tolist())
        kept = part >= 0
        ids = part[kept].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner[kept], minlength=len(pieces)))).tolist()
        return [ids[start:end] if k not in odd else np.array(self.merge_alone(pieces[k]), dtype=np.int32).tobytes() for k, (start, end) in enumerate(zip([0, *ends], ends))]

    def merge_alone(self, piece: bytes) -> list[int]:
        """The same for one piece."""
        n, rank = len(piece), self.ranks.get
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # pair[i]: rank of the part at i with the next one, -1 if they make no token. Heap entries order by rank, then by place.
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue  # one of the two has changed since
            j = after[i]
            k = after[i] = after[j]
            part[i] = both = part[i] + part[j]
            part[j], pair[i], pair[j] = None, -1, -1
            if k < n:
                before[k] = i
                pair[i] = new = rank(both + part[k], -1)
                if new >= 0:
                    heappush(heap, new * n + i)
            k = before[i]
            if k >= 0:
                pair[k] = new = rank(part[k] + both, -1)
                if new >= 0:
                    heappush(heap, new * n + k)
        ranks = self.ranks
        return [ranks[p] for p in part if p is not None]

    def learn(self, new: list[str], into: dict[str, bytes]) -> None:
        """Ids of distinct pre-tokens."""
        keys = [t.encode("utf-8", "surrogatepass") for t in new]
        found = self.perfect.lookup(keys)
        rest: list[tuple[str, bytes]] = []
        for t, key, i in zip(new, keys, found.tolist()):
            token = self.tokens[i]
            if token == key:
                into[t] = self.whole[4 * i : 4 * i + 4]
            else:
                rest.append((t, key))
        into.update(zip((t for t, _ in rest), self.merge([key for _, key in rest])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        import regex

        split = regex.compile(self.pattern).findall
        cut = [split(t) for t in texts]
        known = self.memory
        here = set(chain.from_iterable(cut))
        if len(known) > REMEMBERED:
            # What comes again is worth keeping; most others are seen once.
            known = self.memory = {t: known[t] for t in here if t in known}
        new = [t for t in here if t not in known]
        if new:
            self.learn(new, known)
        flat = [b"".join(map(known.__getitem__, tokens)) for tokens in cut]
        counts = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) // 4
        ids = np.frombuffer(b"".join(flat), dtype=np.int32)
        for t in new:
            if len(t) > REMEMBERED_LENGTH:
                del known[t]
        return ids, counts


def codec(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of ``path``, broadcast. The file is read on the driver alone."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Codec(f.read(), pattern))


def encoded(text: Column | str, shared) -> Column:
    """array<int> of token ids."""

    def encode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A slice is handed on at once: neither the worker nor Spark holds the results of a whole batch.
        for piece, _ in pieces(arrays, 2 << 20):
            ids, counts = shared.value.encode(piece.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))

    encode.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>")(text)


def decoded(ids: Column | str, shared) -> Column:
    """The bytes that lists of ids stand for. ``shared`` is a broadcast Decoder."""

    def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            lists = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            yield bytes_of(shared.value, flat.to_numpy(zero_copy_only=False), counts)

    decode.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "binary")(ids)


def bytes_of(decoder: Decoder, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value per list of ids, worked out some 1M ids at a time."""
    parts, start = [], 0
    ends = np.concatenate([[0], np.cumsum(counts)])
    while start < len(counts) or not parts:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 20), "right")) - 1)
        stop = min(stop, len(counts))
        data, sizes = decoder.decode(flat[ends[start] : ends[stop]], counts[start:stop])
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        parts.append(pa.BinaryArray.from_buffers(pa.binary(), stop - start, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]))
        start = stop
    return pa.concat_arrays(parts)


def round_trip(text: Column | str, shared) -> Column:
    """struct<ids, decoded>: the ids of a text and the bytes that these ids stand for, by one worker in one step."""

    def work(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A slice is handed on at once: neither the worker nor Spark holds the results of a whole batch.
        for piece, _ in pieces(arrays, 2 << 20):
            ids, counts = shared.value.encode(piece.to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.StructArray.from_arrays([lists, bytes_of(shared.value.decoder, ids, counts)], ["ids", "decoded"])

    work.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, "struct<ids:array<int>,decoded:binary>")(text)


def tokenised(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``docs`` with the columns ``ids`` (array<int>) and ``decoded`` (binary, decoded from the ids).

    Columns of these two names are replaced; other names can be given. All other columns stay, whatever they are called.
    """
    import public_tokenizers

    shared = codec(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    both = f"_{uuid.uuid4().hex}"
    done = docs.withColumn(both, round_trip("text", shared))
    return done.withColumns({ids: F.col(both)["ids"], back: F.col(both)["decoded"]}).drop(both)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and the text back from them, as digests."""
    return digests(tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
