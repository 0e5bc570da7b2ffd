"""Secret scans: patterns of well-known shapes, and passwords told by the number of guesses they would take.

Three base patterns find assignments, access keys and long hexadecimal strings. Values beside words for credentials are then weighed: the
cheapest way to build the value from words of a ranked list, dates, repeats, keyboard walks and brute-force stretches gives its guess cost
(log10), found by dynamic programming over its end positions. Values that cost at least ``LEAST_COST`` and are no placeholders are
spans of the kind ``guess``, unless a base assignment already covers them. The ranked list comes from the order of a public vocabulary's tokens.

Null texts count as empty. Spans count code points, end exclusive. Only characters of ASCII match letters "in either case".
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

NAME = "op2_secrets"
VOCABULARY = "byte_bpe_50k.tiktoken"
LEAST_COST = 7.0
#: Longest single segment; longer stretches are several. It bounds the work per character, not the value.
SEGMENT = 64
RESULT = "struct<n_assign bigint, n_access bigint, n_hex bigint, base string, spans string>"

# Fixed patterns. Runs are taken whole, so the shortest length can stand in the pattern of ``hex``.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Words for credentials, and what may stand between one and its value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|login)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "api", "key", "credential", "auth", "login")
PLACEHOLDER = re.compile(r"^(?:[x*#.\-_]+|<.*>|\$?\{.*\}?|%.*%|(?:your|my|the|some)[_-].*|example.*|changeme|none|null|true|false|undefined|https?:.*)$", re.IGNORECASE)
# Passwords people choose most, most frequent first, and rows of a keyboard.
COMMON = (
    "123456 password 123456789 12345678 12345 qwerty abc123 password1 111111 iloveyou letmein monkey dragon sunshine princess welcome admin "
    "login football master hello freedom whatever shadow michael superman batman trustno1 secret passw0rd root toor guest test default changeme"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.")
LEET = str.maketrans("4@83160$57", "aabelgosst")
DATE = re.compile(r"(?:19|20)\d\d|(?:(?:19|20)\d\d)([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)")


def next_keys() -> set[str]:
    """Pairs of keys side by side, either way, plain."""
    return {p for row in KEYBOARD for a, b in zip(row, row[1:]) for p in (a + b, b + a)}


NEXT_KEYS = next_keys()


class GuessCost:
    """log10 of the guesses a value would take; ``ranks`` orders words from the most frequent."""

    def __init__(self, ranks: dict[str, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)

    def word(self, part: str) -> float | None:
        low = part.lower()
        plain = low.translate(LEET)
        rank = self.ranks.get(low)
        turned = 0.0
        if rank is None and plain != low:
            rank, turned = self.ranks.get(plain), math.log10(2 ** sum(a != b for a, b in zip(low, plain)))
        if rank is None:
            return None
        # Capitals cost a choice each, a first capital alone costs one bit.
        capitals = sum(c.isupper() for c in part)
        case = 0.0 if not capitals else math.log10(2) if capitals == len(part) or (capitals == 1 and part[0].isupper()) else math.log10(math.comb(len(part), capitals) + 1)
        return math.log10(rank + 2) + turned + case

    @staticmethod
    def brute(part: str) -> float:
        size = sum(n for n, has in ((26, any(c.islower() for c in part)), (26, any(c.isupper() for c in part)), (10, any(c.isdigit() for c in part)), (33, any(not c.isalnum() for c in part))) if has)
        return len(part) * math.log10(max(size, 10))

    def cost(self, value: str) -> float:
        """Cheapest segmentation; every further segment costs the choice of its kind."""
        n = len(value)
        best = [0.0] + [math.inf] * n
        dates = {}
        for i in range(n):
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    dates[i, j] = math.log10(365 * 120) if j - i > 4 else math.log10(120)
        low = value.lower()
        walk = [0] * (n + 1)  # keys of the walk that ends before each position
        run = [0] * (n + 1)  # length of the run of one character that ends there
        for j in range(1, n + 1):
            walk[j] = walk[j - 1] + 1 if j > 1 and low[j - 2 : j] in NEXT_KEYS else 1
            run[j] = run[j - 1] + 1 if j > 1 and value[j - 1] == value[j - 2] else 1
        for j in range(1, n + 1):
            for i in range(max(0, j - SEGMENT), j):
                size, part = j - i, value[i:j]
                found = self.brute(part)
                if size <= self.longest and (w := self.word(part)) is not None:
                    found = min(found, w)
                if (i, j) in dates:
                    found = min(found, dates[i, j])
                if size >= 3 and walk[j] >= size:
                    found = min(found, math.log10(47 * 4 * size))
                if size >= 3 and run[j] >= size:
                    found = min(found, math.log10(95 * size))
                # A block said several times costs the block and the count.
                if size >= 4:
                    for k in range(2, size // 2 + 1):
                        if size % k == 0 and part == part[:k] * (size // k):
                            found = min(found, self.brute(part[:k]) + math.log10(size // k))
                            break
                best[j] = min(best[j], best[i] + found + (math.log10(4) if i else 0.0))
        return best[n]


@lru_cache(maxsize=4)
def ranked(path: str) -> dict[str, int]:
    """Words of three letters and more in the order of a vocabulary file, the common passwords first."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f]
    words = list(COMMON)
    words += [w for t in tokens if (w := t.strip().decode("utf-8", "ignore").lower()).isascii() and w.isalpha() and len(w) >= 3]
    return {w: i for i, w in reversed(list(enumerate(dict.fromkeys(words))))}


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, order of kind, kind, end), sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, base: list[tuple[int, int, str, int]], cost: GuessCost, least: float) -> list[tuple[int, int, str, int]]:
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        a, value = m.start(1), m[1].rstrip(".:!?)")
        covered = any(s[2] == "assign" and s[0] <= a < s[3] for s in base)
        if len(value) >= 6 and not covered and not PLACEHOLDER.match(value) and cost.cost(value) >= least:
            found.append((a, 3, "guess", a + len(value)))
    return found


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def scan(text: str, cost: GuessCost, least: float = LEAST_COST) -> dict:
    base = base_spans(text)
    kinds = [s[2] for s in base]
    return {"n_assign": kinds.count("assign"), "n_access": kinds.count("access"), "n_hex": kinds.count("hex"), "base": joined(base), "spans": joined(sorted(base + guessed_spans(text, base, cost, least)))}


def scanned(docs: DataFrame, vocabulary: str | None = None, least: float = LEAST_COST, into: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``into``: counts per base kind, base spans and all spans as kind:start:end lists."""
    import public_tokenizers

    # The list is as long as the vocabulary file, some 50,000 short words.
    shared = docs.sparkSession.sparkContext.broadcast(GuessCost(ranked(vocabulary or public_tokenizers.path(VOCABULARY))))
    kinds = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = []
        for piece, last in pieces(arrays):
            parts.append(pa.array([scan(t, shared.value, least) for t in piece.to_pylist()], kinds))
            if last:
                yield pa.concat_arrays(parts)
                parts = []

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(run, RESULT)(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as counts and spans."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), into="s")
    return found.select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", F.sha2("s.base", 256).alias("base_sha256"), "s.spans")
