"""Secret scans: fixed forms of credentials, and stretches whose characters are too evenly mixed for words.

Beside the fixed forms, runs of token characters are candidates. A window slides over a
candidate; counts of its characters change by one in and one out, and so do the sum that its
Shannon entropy is made of and the counts of its character classes. A window whose classes have a
limit, and whose entropy reaches it, belongs to a secret, unless an allow-list knows it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import sliced

# The base kinds, in the order in which spans of one start are listed, what they match, and the length that the
# named group must have. Letters of the first are matched in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
ENTROPY = "entropy"
KINDS = (*(k for k, *_ in BASE), ENTROPY)

#: Without one of these a text has no span of the first kind.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

LOWER, UPPER, DIGIT, SYMBOL = 1, 2, 4, 8
CLASS = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", LOWER), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), **dict.fromkeys("0123456789", DIGIT), **dict.fromkeys("+/_.=-", SYMBOL)}
HEX_LETTERS = frozenset("abcdefABCDEF")


@dataclass(frozen=True)
class Limits:
    """Which windows are secrets, and what is not one all the same.

    ``window`` characters are looked at together. Entropies are in bits a character: ``hexadecimal``
    for digits with the letters a to f of one case, ``one_case`` for digits with other letters of
    one case, ``mixed`` for digits with letters of both. Letters alone and digits alone are words
    and numbers; so are windows of one case with fewer than three digits or more than a tenth of
    symbols, and mixed ones with more than a quarter: they have no limit. ``allowed``: forms that
    are no secrets; a span of which one covers a part adds nothing. All values are parameters,
    set to tell random strings from the words, numbers and paths of prose.
    """

    window: int = 20
    hexadecimal: float = 2.9
    one_case: float = 3.55
    mixed: float = 3.7
    allowed: tuple[str, ...] = field(
        default=(
            r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|your[_-]",
            r"\b[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\b",
            r"(?i)abcdefgh|01234567|12345678|98765432",
            r"\bsha(?:1|256|384|512)-",
            r"(?:\b\d{1,4}[./_-]){2,}\d{1,4}",
        )
    )


def windows(text: str, limits: Limits) -> list[tuple[int, int]]:
    """Spans of windows of a candidate that reach their limit, joined where they overlap."""
    size, n = limits.window, len(text)
    if n < size:
        return []
    # c log2 c by count: the entropy of a window is log2(size) less their sum over size.
    weight = _weights(size)
    counts: dict[str, int] = {}
    lower = upper = digit = symbol = hex_letters = 0
    total, found = 0.0, []
    least = {k: (weight[size] - v * size) for k, v in (("hex", limits.hexadecimal), ("one", limits.one_case), ("mixed", limits.mixed))}
    for i, c in enumerate(text):
        if i >= size:
            old = text[i - size]
            kind = CLASS[old]
            lower, upper, digit, symbol = lower - (kind == LOWER), upper - (kind == UPPER), digit - (kind == DIGIT), symbol - (kind == SYMBOL)
            hex_letters -= old in HEX_LETTERS
            k = counts[old]
            counts[old] = k - 1
            total += weight[k - 1] - weight[k]
        kind = CLASS[c]
        lower, upper, digit, symbol = lower + (kind == LOWER), upper + (kind == UPPER), digit + (kind == DIGIT), symbol + (kind == SYMBOL)
        hex_letters += c in HEX_LETTERS
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += weight[k + 1] - weight[k]
        if i >= size - 1 and digit and lower + upper:
            name = "mixed" if lower and upper else "hex" if hex_letters == lower + upper and not symbol else "one"
            if total <= least[name] + 1e-9 and (symbol * 4 <= size if name == "mixed" else symbol * 10 <= size and digit >= 3):
                start = i - size + 1
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
    return found


def _weights(size: int) -> list[float]:
    from math import log2

    return [0.0, *(k * log2(k) for k in range(1, size + 1))]


class Scanner:
    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{limits.window},}}")
        self.allowed = [re.compile(a) for a in limits.allowed]

    def base(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """The base spans of each kind. Where no character could begin one, no pattern is tried."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k, *_ in BASE}
        low = text.lower()
        for kind, pattern, group, least in BASE:
            if kind == "assign" and not any(n in low for n in NAMES) or kind == "access" and "AKIA" not in text:
                continue
            if kind == "hex":
                out[kind] = self.in_words(text, pattern, least)
            else:
                out[kind] = [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        return out

    @staticmethod
    def in_words(text: str, pattern: re.Pattern, least: int) -> list[tuple[int, int]]:
        """Matches of at least this length of a pattern without spaces: only long enough words are searched."""
        out, at = [], 0
        for word in text.split(" "):
            if len(word) >= least:
                out += [(at + m.start(), at + m.end()) for m in pattern.finditer(word) if m.end() - m.start() >= least]
            at += len(word) + 1
        return out

    def added(self, text: str, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What the windows add: parts of candidates that no base span covers and the allow-list does not know."""
        out = []
        for start, end in self.in_words(text, self.run, self.limits.window):
            found = windows(text[start:end], self.limits)
            if not found:
                continue
            # The allow-list sees a little of what stands around a candidate.
            left, right = max(0, start - 8), min(len(text), end + 8)
            known = [(left + m.start(), left + m.end()) for a in self.allowed for m in a.finditer(text[left:right])]
            for a, b in found:
                span = (start + a, start + b)
                if not any(x < span[1] and span[0] < y for x, y in (*known, *base)):
                    out.append(span)
        return out

    def scan(self, text: str | None) -> tuple[int, int, int, str, str]:
        text = text or ""
        base = self.base(text)
        spans = [(start, i, end) for i, (kind, *_) in enumerate(BASE) for start, end in base[kind]]
        digest = hashlib.sha256(self.said(spans).encode()).hexdigest()
        more = self.added(text, sorted((s, e) for s, _, e in spans))
        return *(len(base[k]) for k, *_ in BASE), digest, self.said(spans + [(s, len(BASE), e) for s, e in more])

    @staticmethod
    def said(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_secrets(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row's whole text.

    Spans are kind:start:end in code points, by start, then kind, joined by commas. A null or empty text has none.
    Repeated rows are scanned each, null ids stay, other columns are ignored, and an empty table
    gives no rows. Base spans stay whatever the allow-list says; a window that touches one adds nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(limits)
        for b in sliced(batches):
            found = list(zip(*map(scanner.scan, b.column(1).to_pylist()), strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
