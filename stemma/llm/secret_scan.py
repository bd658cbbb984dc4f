"""Secrets in texts: known forms by pattern, other random strings by a battery of tests.

Base spans come from three patterns (assigned values, access keys, hexadecimal strings). Beside
them, each run of 20 or more characters of an encoding's alphabet is a candidate. Its encoding is
inferred (hexadecimal, base32, lower case and digits, letters and digits, base64) and tested for
randomness over that alphabet: a chi-squared test of uniformity, a runs test about the middle of the
alphabet and a test of serial correlation, combined by Bonferroni. A candidate that these don't
reject is set against text by its letters' counts and neighbours: how likely text is to have them,
over how likely a random string of the inferred encoding is. By Markov's inequality that ratio is a
p-value for text, however the candidates depend on one another. Over the candidates of a document, the
Benjamini-Hochberg procedure with weights in proportion to length holds the share of false
discoveries under ``RATE``. What passes is a span of kind ``random`` unless a base span covers part
of it.

Nulls: a null text has no spans, and redaction leaves it null. Very long texts: whole. Repeated
rows: each for itself. Empty tables: empty result. Other columns pass through; names given here
replace columns of the same name. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import with_columns
from stemma.llm.segments import slices

# fixed values: the patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
#: Characters of a candidate at least, and the alphabet of all encodings; a '=' is padding only at a value's end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Alphabets, the narrowest first; a candidate has the first that holds all its characters.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
SETS = [(a, frozenset(a)) for a in ALPHABETS]
#: A candidate that is less likely than this as a random string is not one.
RANDOM_P = 1e-3
#: The rate of false discoveries.
RATE = 1e-3
#: Text as a chain: the share of neighbours of different kinds (letters of a case, digits, marks), the share of each
#: kind, and the letters' counts in ten thousand, a mean over English, German, French and Spanish.
TEXT_CHANGES = 0.12
KIND_SHARES = (0.5, 0.2, 0.15, 0.15)
LETTER_COUNTS = dict(zip("abcdefghijklmnopqrstuvwxyz", (850, 160, 330, 430, 1510, 130, 180, 260, 730, 40, 60, 450, 260, 780, 610, 210, 70, 670, 720, 690, 400, 110, 110, 30, 80, 60), strict=True))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: list[int], k: int) -> float:
    """p-value of the chi-squared statistic over k letters (Wilson and Hilferty's approximation)."""
    n, df = len(values), k - 1
    counts = [0] * k
    for v in values:
        counts[v] += 1
    x = sum(c * c for c in counts) * k / n - n
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: list[int], k: int) -> float:
    """p-value of the Wald-Wolfowitz test of runs below and above the middle of the alphabet."""
    high = [2 * v >= k for v in values]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    found = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    return _two_sided((found - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_correlation(values: list[int]) -> float:
    """p-value of the correlation of neighbours."""
    n = len(values)
    mean = sum(values) / n
    around = [v - mean for v in values]
    var = sum(x * x for x in around)
    if not var:
        return 0.0
    r = sum(x * y for x, y in zip(around, around[1:], strict=False)) / var
    return _two_sided((r + 1 / n) * math.sqrt(n))


def randomness(token: str) -> float:
    """p-value of the battery: small for what isn't random over its inferred alphabet."""
    token = token.rstrip("=")
    letters = set(token)
    alphabet = next((a for a, s in SETS if letters <= s), None)
    if alphabet is None:
        return 0.0
    place = {c: i for i, c in enumerate(alphabet)}
    values, k = [place[c] for c in token], len(alphabet)
    return min(1.0, 3 * min(uniformity(values, k), runs(values, k), serial_correlation(values)))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_TOTAL = sum(LETTER_COUNTS.values())
#: Logarithm of the share of a character among those of its kind.
WITHIN = {c: math.log(n / _TOTAL) for low, n in LETTER_COUNTS.items() for c in (low, low.upper())} | {c: math.log(1 / 10) for c in "0123456789"} | {c: math.log(1 / 4) for c in "+/-_"}
#: Logarithm of the chance that a kind follows another.
FOLLOWS = [[math.log(1 - TEXT_CHANGES if i == j else TEXT_CHANGES * KIND_SHARES[j] / (1 - KIND_SHARES[i])) for j in range(4)] for i in range(4)]


def as_text(token: str) -> float:
    """p-value of text: its likelihood over that of a random string of the inferred encoding, 1 at most."""
    token = token.rstrip("=")
    letters = set(token)
    k = next((len(a) for a, s in SETS if letters <= s), None)
    if k is None:
        return 1.0
    kinds = [_kind(c) for c in token]
    log = math.log(KIND_SHARES[kinds[0]]) + sum(FOLLOWS[a][b] for a, b in zip(kinds, kinds[1:], strict=False)) + sum(WITHIN[c] for c in token)
    return math.exp(min(0.0, log + len(token) * math.log(k)))


def discoveries(tokens: list[str]) -> list[bool]:
    """Of a document's candidates: which are random strings, by weighted Benjamini-Hochberg."""
    n = len(tokens)
    mean = sum(map(len, tokens)) / n
    ps = [as_text(t) * mean / len(t) for t in tokens]
    order = sorted(range(n), key=ps.__getitem__)
    passed = max((k for k, i in enumerate(order, 1) if ps[i] <= RATE * k / n), default=0)
    found = {i for i in order[:passed] if randomness(tokens[i]) >= RANDOM_P}
    return [i in found for i in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    if not text or not (":" in text or "=" in text or max(map(len, text.split()), default=0) >= 16):
        return [], []
    base = base_spans(text)
    seen = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)]
    starts, reach = [a for a, *_ in base], list(accumulate((b for *_, b in base), max))  # ends of what begins up to each
    seen = [x for x in seen if not (k := bisect_left(starts, x[1])) or reach[k - 1] <= x[0]]
    more = [(a, 3, b) for (a, b, _), yes in zip(seen, discoveries([t for *_, t in seen]), strict=True) if yes] if seen else []
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with ``[kind]`` for each span; of spans that overlap, the first and longest stands for all."""
    out, at = [], 0
    for a, k, b in sorted(spans, key=lambda x: (x[0], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_assign, n_access, n_hex, base_sha256 (of the base spans as written) and spans (kind:start:end, comma-joined)."""

    def run(texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for at, rows in slices(texts):
            found = [scan(t) for t in texts.slice(at, rows).to_pylist()]
            yield {
                **{f"n_{KINDS[k]}": pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(3)},
                "base_sha256": pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                "spans": pa.array([written(spans) for _, spans in found], pa.string()),
            }

    return with_columns(df, text_col, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with placeholders for the secrets in its texts, and the length of texts that change in ``length_col``."""

    def run(texts: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for at, rows in slices(texts):
            found = texts.slice(at, rows).to_pylist()
            yield {"__redacted": pa.array([redacted(t, spans) if (spans := scan(t)[1]) else None for t in found], pa.string())}

    out = with_columns(df, text_col, run, "__redacted string")
    new = {text_col: F.coalesce("__redacted", text_col)}
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        new[length_col] = F.when(F.col("__redacted").isNotNull(), F.length("__redacted").cast(kind)).otherwise(F.col(length_col))
    return out.withColumns(new).select(*df.columns)
