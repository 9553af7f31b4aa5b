"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

A byte-pair encoding is fixed by its neighbouring tokens: a sequence is the encoding of its
bytes exactly if each pair of neighbours is the encoding of its own bytes. So after any
prefix of a text the last token is unique, and the encodings of all prefixes form a tree.
A later token can start only where the bytes since then begin some token of the vocabulary;
tokens on which all such places agree are settled and are emitted. A state of the transducer
is the last settled token and the bytes after it; transitions are made when first taken.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import sliced

#: Transitions and pair verdicts kept per Python worker; a full store is emptied, within a pre-token too.
MEMO = 700_000
#: Pre-tokens and words kept per Python worker, in each of two generations.
PIECES, WORDS = 450_000, 450_000
MEMO_CHARS = 64
#: The share of these sizes that is used where memory is shared with other work.
LEAN = 0.15
#: Bytes of a pre-token that are looked up at once.
HEAD = 5

NONE = -2

# Split patterns whose pre-tokens do not reach across a single space between words.
WORDWISE = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """Encodes one pre-token at a time, byte by byte, with bounded lookahead."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0) -> None:
        self.ranks, self.most = ranks, int(MEMO * share)
        self.token = {r: b for b, r in ranks.items()}
        self.length = {r: len(b) for b, r in ranks.items()}
        #: The vocabulary as a trie: node * 256 + byte to node, each node's token or NONE, and whether a longer token goes on.
        self.child: dict[int, int] = {}
        self.ends_token, self.goes_on = [NONE], bytearray(1)
        for raw, rank in ranks.items():
            node = 0
            for byte in raw:
                self.goes_on[node] = 1
                at = node << 8 | byte
                if at not in self.child:
                    self.child[at] = len(self.ends_token)
                    self.ends_token.append(NONE)
                    self.goes_on.append(0)
                node = self.child[at]
            self.ends_token[node] = rank
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        #: The last token of each prefix of the pending bytes, beginning with the settled one; the lengths
        #: of the prefixes after which a token may start, and how far into the trie each has come; the pending bytes.
        self.states: list[tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...], bytes]] = [((-1,), (0,), (0,), b"")]
        self.number: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        #: By state * 256 + byte: the next state * 2, and 1 more if the step settles tokens.
        self.steps: dict[int, int] = {}
        self.settles: dict[int, tuple[int, ...]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        #: The first HEAD bytes of a pre-token: the state after them and the tokens settled.
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The encoding by definition: merge the lowest-ranked neighbours until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left; left is -1 at the start, where right must encode itself."""
        name = left + 1 << 32 | right
        known = self.fits.get(name)
        if known is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            want = [right] if left < 0 else [left, right]
            known = self.fits[name] = self.merge(b"".join(self.token[t] for t in want)) == want
        return known

    def path(self, last: tuple[int, ...] | list[int], end: int) -> tuple[int, ...]:
        out: tuple[int, ...] = ()
        while end:
            out = (last[end], *out)
            end -= self.length[last[end]]
        return out

    def make(self, state: int, byte: int) -> int:
        """The transition of a state on a byte."""
        last, opened, nodes, pending = self.states[state]
        child, length, n, new = self.child, self.length, len(pending) + 1, NONE
        live, reached = [], []
        for i, node in zip(opened, nodes, strict=True):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if new == NONE and (t := self.ends_token[node]) != NONE and self.compatible(last[i], t):
                new = t
            if self.goes_on[node]:
                live.append(i)
                reached.append(node)
        live.append(n)
        reached.append(0)
        last = (*last, new)
        # The place where the encodings of all open prefixes part.
        cut = live[0]
        for i in live:
            while i != cut:
                if i > cut:
                    i -= length[last[i]]
                else:
                    cut -= length[last[cut]]
        # The settled token tells only whether a token may start after it; else states are one.
        settled = last[cut] if live[0] == cut else NONE
        name = (settled, (pending + bytes((byte,)))[cut:])
        k = self.number.get(name)
        if k is None:
            k = self.number[name] = len(self.states)
            self.states.append(((settled, *last[cut + 1 :]), tuple([i - cut for i in live]), tuple(reached), name[1]))
        at = state << 8 | byte
        if cut:
            self.settles[at] = self.path(last, cut)
        step = self.steps[at] = k << 1 | (cut > 0)
        return step

    def begin_again(self, state: int) -> int:
        """Empty the stores within a pre-token: all but the state that it has come to, which gets another number."""
        kept = self.states[state]
        self.clear()
        name = (kept[0][0], kept[3])
        if name not in self.number:
            self.number[name] = len(self.states)
            self.states.append(kept)
        return self.number[name]

    def walk(self, state: int, data: bytes, tokens: list[int]) -> int:
        get = self.steps.get
        for byte in data:
            step = get(state << 8 | byte)
            if step is None:
                if len(self.steps) > self.most:
                    state, get = self.begin_again(state), self.steps.get
                step = self.make(state, byte)
            if step & 1:
                tokens += self.settles[state << 8 | byte]
            state = step >> 1
        return state

    def encode(self, piece: bytes) -> list[int]:
        if len(self.steps) > self.most:
            self.clear()
        whole = self.ranks.get(piece)
        if whole is not None and not self.compatible(-1, whole):
            return [whole]  # an entry that no merges lead to; a pre-token equal to it is it all the same
        head = piece[:HEAD]
        if (begun := self.heads.get(head)) is None:
            tokens: list[int] = []
            begun = self.heads[head] = (self.walk(0, head, tokens), tuple(tokens))
        tokens = list(begun[1])
        state = self.walk(begun[0], piece[HEAD:], tokens)
        if (end := self.ends.get(state)) is None:
            last, _, _, pending = self.states[state]
            end = self.ends[state] = self.path(last, len(pending))
        tokens += end
        return tokens


# The well-formed byte sequences of UTF-8, as (first byte, last byte, next state) of each
# state. State 0 lies between characters; 1, 2 and 3 want so many more bytes; 4 to 7 are those after
# E0, ED, F0 and F4, which narrow the second byte.
UTF8 = (
    ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
    ((0x80, 0xBF, 0),),
    ((0x80, 0xBF, 1),),
    ((0x80, 0xBF, 2),),
    ((0xA0, 0xBF, 1),),
    ((0x80, 0x9F, 1),),
    ((0x90, 0xBF, 2),),
    ((0x80, 0x8F, 2),),
)
REJECT = len(UTF8)


class Utf8Machine:
    """The incremental state machine of UTF-8 over bytes, and over tokens, whose steps are made when first taken."""

    def __init__(self, token: dict[int, bytes]) -> None:
        self.token = token
        self.next = [bytearray([REJECT] * 256) for _ in range(REJECT + 1)]
        for row, ranges in zip(self.next, UTF8, strict=False):
            for first, last, state in ranges:
                row[first : last + 1] = bytes([state]) * (last + 1 - first)
        #: By token: whether it does not take state 0 back to state 0.
        self.odd = np.zeros(max(token, default=-1) + 1, bool)
        for rank, raw in token.items():
            self.odd[rank] = not raw.isascii() and self.run(0, raw) != 0
        self.steps: dict[int, int] = {}

    def run(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.next[state][byte]
        return state

    def step(self, state: int, rank: int) -> int:
        at = rank << 4 | state
        if (found := self.steps.get(at)) is None:
            found = self.steps[at] = self.run(state, self.token[rank])
        return found


class Decoder:
    """Bytes and text of ids that arrive in blocks of any lengths, cut anywhere; bad UTF-8 is an error."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.machine, self.state, self.held = codec, codec.utf8, 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids. Between characters, tokens of whole characters need no step."""
        state, odd, i = self.state, np.flatnonzero(self.machine.odd[ids]).tolist(), 0
        while i < len(ids):
            if not state:
                if (k := bisect_left(odd, i)) == len(odd):
                    break
                i = odd[k]
            state = self.machine.step(state, int(ids[i]))
            if state == REJECT:
                raise ValueError("the ids are not of a text in UTF-8")
            i += 1
        self.state = state
        return self.codec.raw(ids)

    def text(self, ids: np.ndarray) -> str:
        """The characters that the ids complete."""
        data = self.held + self.feed(ids)
        cut = len(data)
        if self.state:
            cut -= next(k for k in (1, 2, 3) if data[-k] >= 0xC0)
        self.held = data[cut:]
        return str(data[:cut], "utf-8")

    def close(self) -> None:
        if self.state:
            raise ValueError("the ids end within a character")


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Store:
    """The last results by key: a generation is dropped when a newer one is full."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new


class Codec:
    """Whole texts: pre-tokens of ``pattern``, each encoded by the transducer.

    A pattern of WORDWISE starts a new pre-token at a single space between two other characters
    that are not white space, and lets no pre-token depend on what lies beyond such a space. So
    words between single spaces are encoded one by one, and their results are stored. With any
    other pattern, texts are split as a whole, and pre-tokens alone are stored.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: float = 1.0) -> None:
        import regex

        self.fst = Transducer(ranks, share)
        compiled = regex.compile(pattern)
        self.split = compiled.findall if not compiled.groups else lambda text: [m[0] for m in compiled.finditer(text)]
        self.wordwise = pattern in WORDWISE
        self.utf8 = Utf8Machine(self.fst.token)
        self.blank_edge = regex.compile(r"\A\s|\s\Z|\A\Z").search
        self.pieces, self.words = Store(int(PIECES * share)), Store(int(WORDS * share))
        most = max(ranks.values(), default=-1) + 1
        raw = [self.fst.token.get(r, b"") for r in range(most)]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.fromiter(map(len, raw), np.int64, most)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def clear(self) -> None:
        """Give back the memory of all stores."""
        self.pieces.clear()
        self.words.clear()
        self.fst.clear()

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.words.turn()
        self.pieces.turn()
        first, *words = text.split(" ") if self.wordwise else (text,)
        if not words or self.blank_edge(first):
            return self.all(text)
        out = list(map(self.words.new.get, words))
        if None in out:
            for i, got in enumerate(out):
                if got is None:
                    if (made := self.word(words[i])) is None:
                        return self.all(text)
                    out[i] = made
        return self.all(first) + b"".join(out)

    def all(self, text: str) -> bytes:
        return b"".join(map(self.piece, self.split(text)))

    def word(self, word: str) -> bytes | None:
        """The ids of a word and the space before it; None if white space is at its edge or it is empty."""
        got = self.words.new.get(word) or self.words.old.get(word)
        if got is None:
            if self.blank_edge(word):
                return None
            got = self.all(" " + word)
        if len(word) <= MEMO_CHARS:
            self.words.new[word] = got
        return got

    def piece(self, piece: str) -> bytes:
        got = self.pieces.new.get(piece) or self.pieces.old.get(piece)
        if got is None:
            got = _little(self.fst.encode(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            self.pieces.new[piece] = got
        return got

    def raw(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        # Each byte's place among the vocabulary's bytes: its token's start, and how far into it.
        places = np.repeat(self.starts[ids] - (ends - size), size)
        return self.flat[places + np.arange(len(places))].tobytes()

    def blocks(self, ids: bytes, block: int = 1 << 16) -> Iterator[np.ndarray]:
        numbers = np.frombuffer(ids, "<u4")
        return (numbers[i : i + block] for i in range(0, len(numbers), block))

    def text(self, ids: bytes, block: int = 1 << 16) -> str:
        decoder = Decoder(self)
        text = "".join(map(decoder.text, self.blocks(ids, block)))
        decoder.close()
        return text


@cache
def _codec(data: bytes, pattern: str, share: float) -> Codec:
    return Codec(read_ranks(data), pattern, share)


def encode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = False, keep: Iterable[str] = ("doc_id",), lean: bool = False) -> DataFrame:
    """Encode each row's whole text and decode it again.

    Returns the ``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the
    ids as binary (little-endian unsigned 32-bit integers). A kept column named like a result
    gives way to it. A null or empty text has no ids. Repeated rows are encoded each, null ids
    stay, an empty table gives no rows. The rank file is read on the driver. The decoder fails
    a task whose ids do not give the text back. Workers keep their stores for later tasks; with
    ``lean`` these are smaller, as where other work shares the workers.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    made = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + [("token_ids", "binary")] * ids
    names = [c for c in keep if c not in dict(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern, LEAN if lean else 1.0)
        gc.disable()  # the stores hold no cycles, and scanning them takes most of the time
        try:
            for b in sliced(batches):
                n, of_ids, of_bytes, all_ids = [], [], [], []
                for text in b.column(b.num_columns - 1).to_pylist():
                    got = codec.ids(text)
                    raw, digest, decoder, at = (text or "").encode(), hashlib.sha256(), Decoder(codec), 0
                    for block in map(decoder.feed, codec.blocks(got)):
                        digest.update(block)
                        if raw[at : at + len(block)] != block:
                            raise ValueError("the ids do not give the text back")
                        at += len(block)
                    decoder.close()
                    if at != len(raw):
                        raise ValueError("the ids do not give the text back")
                    n.append(len(got) // 4)
                    of_ids.append(hashlib.sha256(got).hexdigest())
                    of_bytes.append(digest.hexdigest())
                    all_ids.append(got)
                cols = [pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)] + [pa.array(all_ids, pa.binary())] * ids
                yield pa.RecordBatch.from_arrays(b.columns[:-1] + [c.cast(t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=False)], names + [c for c, _ in made])
        finally:
            gc.enable()

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {t}" for c, t in made])
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
