"""Token counts by a two-tier lookup of pre-tokens inside the map tasks; no pre-token is ever shuffled.

Tier one is a compact hash table of frequent pre-tokens and the number of tokens each makes: plain integer arrays, broadcast once, of at most
``TABLE`` entries. Whole slices of text are cut into pre-tokens and looked up at once. What the table lacks is tier two: a worker remembers the lengths it has worked
out (``REMEMBERED`` entries, short ones only) and encodes the rest with the vocabulary's own merges.

The table is filled from a sample of about ``SAMPLE_ROWS`` rows, picked at random all over the input. It decides which tier answers and nothing
else: every row's count is exact, whatever the sample holds. Each tier compares whole pre-tokens, so hashes may collide.

Null texts count as empty: no bytes, no tokens. Texts of any length are read whole, in slices of about 2 MB (a longer text is a slice of its own). Strings of special
tokens inside a text are one token each, as the tokenizer's file says. Repeated rows and repeated or null ids count each for themselves. A column
named like ``into`` is replaced; all others stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces
from .words import C1, mix

NAME = "op12_token_counts"
VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Most frequent pre-tokens that the broadcast table holds, and the rows (on average) that it is made from.
TABLE, SAMPLE_ROWS = 32_768, 10_000
#: Tasks that count the sample; each returns at most TABLE pre-tokens.
SAMPLE_TASKS = 4
#: A worker remembers at most so many pre-tokens of at most so many characters.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64
#: UTF-16 units of an entry of the table.
UNITS = 16
SLICE = 2 << 20

# The cutting rule that the fast path below follows. Files with another rule are cut by the library.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ranges whose characters are settled in all Unicode versions; normalising and lowering them goes character by character.
SETTLED = [(0x0, 0x2FF), (0x386, 0x3CE), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]
SPACE, LETTER, NUMBER, OTHER = range(4)
MASKS = np.array([(1 << (16 * n)) - 1 for n in range(4)] + [(1 << 64) - 1], dtype=np.uint64)


def character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per UTF-16 unit: lowered form, kind, and whether the fast path may take it."""
    lower, kind, safe = np.arange(1 << 16, dtype=np.uint16), np.full(1 << 16, OTHER, dtype=np.uint8), np.zeros(1 << 16, dtype=bool)
    settled = set(chain.from_iterable(range(a, b + 1) for a, b in SETTLED))
    for c in settled:
        char, group = chr(c), unicodedata.category(chr(c))
        low = char.lower()
        safe[c] = group != "Cn" and len(low) == 1 and ord(low) in settled and unicodedata.normalize("NFC", char) == char and not unicodedata.combining(char) and unicodedata.normalize("NFC", low) == low
        lower[c] = ord(low) if safe[c] else c
        kind[c] = LETTER if group[0] == "L" else NUMBER if group[0] == "N" else SPACE if group[0] == "Z" or c in (*range(9, 14), 0x85) else OTHER
    return lower, kind, safe


class Table:
    """Pre-tokens of up to UNITS UTF-16 units and their lengths in tokens: open addressing over integer arrays."""

    def __init__(self, lengths: dict[str, int]) -> None:
        taken = [t for t in lengths if len(t.encode("utf-16-le")) <= 2 * UNITS]
        units, start, size = units_of(taken)
        self.size = size.astype(np.uint8)
        self.words = words_at(units, start, size)
        self.tokens = np.array([lengths[t] for t in taken], dtype=np.uint8)
        self.mask = (1 << max(4, (4 * len(taken)).bit_length())) - 1
        self.slot = np.full(self.mask + 1, -1, dtype=np.int32)
        for i, at in enumerate((self.hashed(self.words, size) & np.uint64(self.mask)).tolist()):
            while self.slot[at] >= 0:
                at = (at + 1) & self.mask
            self.slot[at] = i

    @staticmethod
    def hashed(words: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64)
        for w in words:
            h = mix(h * C1 ^ w)
        return h

    def lengths(self, units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, -1 where the table lacks it."""
        out = np.full(len(start), -1, dtype=np.int64)
        todo = np.flatnonzero(size <= UNITS)
        words, sizes = words_at(units, start[todo], size[todo]), size[todo]
        at = (self.hashed(words, sizes) & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            entry = self.slot[at]
            same = (entry >= 0) & (self.size[entry] == sizes) if len(self.size) else np.zeros(len(todo), dtype=bool)
            hit = np.flatnonzero(same)
            hit = hit[(self.words[:, entry[hit]] == words[:, hit]).all(axis=0)]
            out[todo[hit]] = self.tokens[entry[hit]]
            entry[hit] = -1
            go = np.flatnonzero(entry >= 0)
            todo, words, sizes, at = todo[go], words[:, go], sizes[go], (at[go] + 1) & self.mask
        return out


def units_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 units of all tokens end to end, with the start and size of each."""
    encoded = [t.encode("utf-16-le", "surrogatepass") for t in tokens]
    size = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 2
    return np.frombuffer(b"".join(encoded), np.uint16), np.cumsum(size) - size, size


def words_at(units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first UNITS units of each slice as rows of 64-bit words, zero beyond its end."""
    padded = np.concatenate([units, np.zeros(UNITS + 4, np.uint16)])
    blocks = np.ndarray(shape=(len(units) + UNITS + 1,), dtype="<u8", buffer=padded, strides=(2,))
    return np.stack([blocks[start + 4 * k] & MASKS[np.clip(size - 4 * k, 0, 4)] for k in range(UNITS // 4)])


class TokenCounter:
    """Counts the tokens of texts by a tokenizer's file; made anew in each worker from what was broadcast."""

    def __init__(self, spec: str, table: Table) -> None:
        self.spec, self.table = spec, table
        self.ready = False

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "table": self.table, "ready": False}

    def prepare(self) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        said = json.loads(self.spec)
        self.tokenizer = Tokenizer.from_str(self.spec)
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.fast = said["normalizer"] == NORMALIZER and [p.get("pattern") for p in said["pre_tokenizer"]["pretokenizers"]] == [{"Regex": PATTERN}, None]
        if not self.fast:
            raise ValueError("the tokenizer's file has another cutting rule than this operator follows")
        self.lower, self.kind, self.safe = character_tables()
        special = [re.escape(t["content"]) for t in said["added_tokens"]]
        self.special = re.compile("|".join(sorted(special, key=len, reverse=True)) or r"(?!)")
        self.memory: dict[str, int] = {}
        self.ready = True

    def encode(self, token: str) -> int:
        ((mapped, _),) = self.bytes.pre_tokenize_str(token)
        return len(self.tokenizer.model.tokenize(mapped))

    def remembered(self, tokens: list[str]) -> list[int]:
        """Tier two: lengths of pre-tokens by the worker's memory, else by merging."""
        known = self.memory
        if len(known) > REMEMBERED:
            here = set(tokens)
            known = self.memory = {t: n for t, n in known.items() if t in here}
        out = []
        for t in tokens:
            n = known.get(t)
            if n is None:
                n = self.encode(t)
                if len(t) <= REMEMBERED_LENGTH:
                    known[t] = n
            out.append(n)
        return out

    def cut(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens of all rows that the fast path takes: units, start, size, row; and which rows it leaves out."""
        if not self.ready:
            self.prepare()
        text = "".join(array.to_pylist())
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        del text
        ends = np.cumsum(pc.utf8_length(array).to_numpy(zero_copy_only=False).astype(np.int64))
        odd = points >= 1 << 16
        units = np.where(odd, 0, points).astype(np.uint16)
        odd |= ~self.safe[units]
        # Any "<|" may begin a special token.
        odd[:-1] |= (units[:-1] == ord("<")) & (units[1:] == ord("|"))
        left = np.zeros(len(array), dtype=bool)
        left[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        units = self.lower[units]
        kind = self.kind[units]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        heads = np.zeros(len(units) + 2, dtype=bool)
        heads[starts[starts < len(units)]] = True
        for r in np.flatnonzero(left):
            kind[starts[r] : ends[r]] = SPACE
        edge = heads[: len(units)].copy()
        edge[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # Contractions: an apostrophe that begins a run of its own, with one or two letters of the same row behind it.
        quote = np.flatnonzero(edge[:-1] & (units[:-1] == ord("'")) & (kind[1:] == LETTER) & ~heads[1 : len(units)]) if len(units) > 1 else np.zeros(0, np.int64)
        if len(quote):
            padded = np.concatenate([units, np.zeros(2, np.uint16)])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))) & ~heads[quote + 2] & (quote + 2 < len(units))
            for which, n in ((short, 1), (pair & ~short, 2)):
                at = quote[which]
                edge[at + 1] = False
                behind = at + n + 1
                edge[behind[behind < len(units)]] = True
        begin = np.flatnonzero(edge)
        size = np.diff(np.concatenate([begin, [len(units)]]))
        word = kind[begin] != SPACE
        begin, size = begin[word], size[word]
        return units, begin, size, np.searchsorted(ends, begin, "right"), left

    def cut_slowly(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text as the library cuts it, and its special tokens."""
        parts = self.special.split(text)
        out: list[str] = []
        for part in parts:
            plain = self.tokenizer.normalizer.normalize_str(part)
            out += [plain[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out, len(parts) - 1

    def counts(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        units, start, size, row, left = self.cut(array)
        n = self.lengths(units, start, size)
        total = np.bincount(row, weights=n, minlength=len(array)).astype(np.int64)
        for r in np.flatnonzero(left).tolist():
            tokens, special = self.cut_slowly(array[r].as_py())
            total[r] = special + int(self.lengths(*units_of(tokens)).sum())
        return total

    def lengths(self, units: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = self.table.lengths(units, start, size)
        missed = np.flatnonzero(n < 0)
        if len(missed):
            raw = units.tobytes()
            n[missed] = self.remembered([raw[2 * a : 2 * (a + k)].decode("utf-16-le") for a, k in zip(start[missed].tolist(), size[missed].tolist())])
        return n


def frequent(docs: DataFrame, spec: str, table: int = TABLE, rows: int = SAMPLE_ROWS) -> Table:
    """The most frequent pre-tokens of a sample with their lengths in tokens."""
    n = docs.count()
    picked = docs.filter(F.rand(12) < rows / max(n, 1)).select(F.coalesce("text", F.lit("")).alias("text")).repartition(SAMPLE_TASKS)
    shared = docs.sparkSession.sparkContext.broadcast(TokenCounter(spec, Table({})))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for array, _ in pieces((b.column("text") for b in batches), SLICE):
            units, start, size, *_ = shared.value.cut(array)
            raw, short = units.tobytes(), np.flatnonzero(size <= UNITS)
            seen.update(raw[2 * a : 2 * (a + k)] for a, k in zip(start[short].tolist(), size[short].tolist()))
            if len(seen) > 8 * table:
                seen = Counter(dict(seen.most_common(4 * table)))
        top = [(t.decode("utf-16-le"), k) for t, k in seen.most_common(table) if k > 1]
        yield pa.RecordBatch.from_pydict({"token": [t for t, _ in top], "n": [shared.value.encode(t) for t, _ in top], "k": [k for _, k in top]}, pa.schema([("token", pa.string()), ("n", pa.int64()), ("k", pa.int64())]))

    # At most SAMPLE_TASKS * table rows, whatever the input.
    found = picked.mapInArrow(work, "token string, n long, k long").collect()
    shared.destroy()
    times: Counter[str] = Counter()
    for r in found:
        times[r["token"]] += r["k"]
    lengths = {r["token"]: r["n"] for r in found if r["n"] < 256}
    return Table({t: lengths[t] for t, _ in sorted(times.items(), key=lambda x: (-x[1], x[0]))[:table] if t in lengths})


def counted(docs: DataFrame, vocabulary: str | None = None, into: str = "n_tokens", table: int = TABLE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (with a column ``text``) and the number of tokens of each text. The vocabulary's file is read on the driver alone."""
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(TokenCounter(spec, frequent(docs, spec, table, rows)))

    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = []
        for piece, last in pieces(arrays, SLICE):
            parts.append(shared.value.counts(piece))
            if last:
                yield pa.array(np.concatenate(parts), pa.int64())
                parts = []

    count.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(count, "long")("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text."""
    docs = counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
