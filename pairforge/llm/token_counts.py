"""Token counts by heap-and-linked-list pair merging, without emitting identifiers."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import sliced

SPACE = "▁"

#: Counts kept per Python worker. The store is emptied when full.
MEMO = 500_000
MEMO_CHARS = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in protocol-buffer form."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


# Field numbers and settings of a sentencepiece model file.
PIECES, TRAINER, NORMALISER = 1, 2, 3
PIECE_TYPE, MODEL_TYPE, WHITE_AS_SUFFIX = 3, 3, 24
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE, RULES = 2, 3, 4, 5, 6
BPE, COUNTED_TYPES = 2, {1: "normal", 2: "unknown", 3: "control", 6: "byte"}


def refuse_unknown(proto: bytes) -> None:
    """Raise ValueError for a model that is not counted rightly: not BPE, with a normaliser, or with pieces of other types."""
    model = list(_fields(proto))
    trainer = dict(_fields(b"".join(v for k, v in model if k == TRAINER)))
    normaliser = dict(_fields(b"".join(v for k, v in model if k == NORMALISER)))
    if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(WHITE_AS_SUFFIX):
        raise ValueError("only BPE models that put the space mark first are counted")
    if normaliser.get(CHARSMAP) or normaliser.get(RULES) or normaliser.get(REMOVE_EXTRA, 1) or not normaliser.get(DUMMY_PREFIX, 1) or not normaliser.get(ESCAPE, 1):
        raise ValueError("only models with an identity normaliser are counted")
    types = {dict(_fields(v)).get(PIECE_TYPE, 1) for k, v in model if k == PIECES}
    if not types <= set(COUNTED_TYPES):
        raise ValueError("a model with user-defined or unused pieces is not counted")


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with an identity normaliser.

    No piece of such a model has a space mark after another character, so merges never
    cross the start of a run of space marks, nor a line break when no piece holds one. A
    text falls into chunks there, and chunks are counted independently.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece holds a space mark after another character")
        order = {s: i for i, s in enumerate(sorted({s for _, s in pieces}, reverse=True))}
        self.rank = {p: order[s] for p, s in pieces}
        self.byte_fallback = byte_fallback
        seen = {c for p in self.rank for c in p}
        stops = "".join(c for c in "\n\r\t" if c not in seen)
        self.chunks = re.compile(f"[{stops}]|{SPACE}*[^{SPACE}{stops}]+|{SPACE}+" if stops else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.memo: dict[str, int] = {}

    @classmethod
    def from_model(cls, proto: bytes) -> PieceCounter:
        import sentencepiece

        refuse_unknown(proto)
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not special[i]]
        return cls(pieces, any(sp.is_byte(i) for i in range(n)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.memo) > MEMO:
            self.memo.clear()
        get, total = self.memo.get, 0
        for chunk in self.chunks(SPACE + text.replace(" ", SPACE)):
            n = get(chunk)
            total += self._chunk(chunk) if n is None else n
        return total

    def _chunk(self, chunk: str) -> int:
        n = self.merged(chunk)
        if len(chunk) <= MEMO_CHARS:
            self.memo[chunk] = n
        return n

    def merged(self, chunk: str) -> int:
        """Initial symbols minus merges. A symbol without a piece counts its UTF-8 bytes."""
        rank, n = self.rank, len(chunk)
        if chunk in rank and n == 1:
            return 1
        at = list(chunk)
        weight = [1 if c in rank or not self.byte_fallback else len(c.encode()) for c in at]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(at[i] + at[i + 1])) is not None]
        heapq.heapify(heap)
        total = sum(weight)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not at[i] or j >= n or len(at[i]) + len(at[j]) != size:
                continue
            total -= weight[i] + weight[j] - 1
            at[i] += at[j]
            at[j], weight[i] = "", 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(at[i] + at[k])) is not None:
                    heapq.heappush(heap, (r, i, len(at[i]) + len(at[k])))
            h = before[i]
            if h >= 0 and (r := rank.get(at[h] + at[i])) is not None:
                heapq.heappush(heap, (r, h, len(at[h]) + len(at[i])))
        return total


@cache
def _counter(proto: bytes) -> PieceCounter:
    return PieceCounter.from_model(proto)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    The file at ``model_path`` is read on the driver, so executors need no copy of it.
    A null or empty text has no bytes and no tokens. Repeated rows are counted each, null
    ids stay, other columns are ignored, and an empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(shared.value).count
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            tokens = [count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
