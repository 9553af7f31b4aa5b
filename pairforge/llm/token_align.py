"""Cross-tokenizer alignment: the tokens of two tokenizers, grouped where both end.

Both tokenizers end a token before a single space that has no white space beside it: the split
pattern of the byte-level one starts anew there, and no piece of the other has a space mark after
another character. So a text falls into stretches there that are encoded and aligned alone, equal
stretches alike. The relational plan runs once for each distinct stretch of the corpus:
posexplode the tokens, add up their lengths in windows, join both sides on stretch and end, count
these cuts as they come for the group ids, and link the ids of a group. Documents are then read
once more where they are stored, to count in how many of them an id pair is linked, to add up what
their stretches have and to note their stretches by number; counts of pairs are added up over these
numbers, without the text. For either pass a block of neighbouring rows has a table of its own
stretches and pairs, and one more holds those that more than half of all blocks have: at most
twice as many as a block has. So a worker holds no more than these, whatever the corpus has.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import Scratch, give_back, located, tidy
from pairforge.llm.token_counts import SPACE, refuse_unknown

#: Bytes of text, about, whose distinct stretches a worker holds at once.
BLOCK_BYTES = 16 << 20
#: Distinct stretches that a task of the relational plan gets, about.
TASK_STRETCHES = 150_000
#: Stretches that are encoded as one text.
TOGETHER = 256
#: Stretches of a block that a worker gathers before it passes them on.
GATHERED = 400_000
#: Bytes of text that a worker cuts into stretches at once; a longer text is cut alone.
CUT_BYTES = 4 << 20
#: A stretch with more pairs of tokens than this gets its links by a join of its groups' counts.
SMALL = 1024

_EDGE = re.compile(r"(?<=\S) (?=\S)")


class Splitter:
    """Cuts texts at single spaces between characters that are not white space."""

    def __init__(self) -> None:
        self.plain: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        parts = text.split(" ")
        if not self.plain.issuperset(parts):
            for p in set(parts) - self.plain:
                if not p or p[0].isspace() or p[-1].isspace():
                    return _EDGE.split(text)
            if len(self.plain) > GATHERED:
                self.plain.clear()
            self.plain.update(parts)
        return parts


def byte_alphabet() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes bytes as: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of each id. A text is given without the space that stands before it."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], raw: list[bytes]) -> None:
        self.encode, self.raw = encode, raw
        self.size = np.array([len(b) for b in raw], np.int32)

    @classmethod
    def byte_level(cls, data: str) -> Side:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        model = json.loads(data)
        if model["normalizer"] or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or not model["pre_tokenizer"]["use_regex"]:
            raise ValueError("only a byte-level model without a normaliser or a space of its own is aligned")
        tokenizer, alphabet = Tokenizer.from_str(data), byte_alphabet()
        tokenizer.encode_special_tokens = True  # their strings in a text are text
        raw = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in model["model"]["vocab"].items():
            raw[i] = bytes(alphabet[c] for c in token)
        return cls(lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], raw)

    @classmethod
    def piece_level(cls, proto: bytes) -> Side:
        import sentencepiece

        refuse_unknown(proto)
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        if any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("a piece holds a space mark after another character")
        raw = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        return cls(lambda texts: sp.encode(texts, num_threads=1), raw)

    def each(self, stretches: list[str], alone: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches one after another, and how many each has; none where their bytes are not those of a space and the stretch.

        Stretches without white space at an edge are encoded together, as neighbours in a text are;
        ``alone`` tells which have some, if that is known.
        """
        alone = list(map(edged, stretches)) if alone is None else alone
        groups, i = [], 0
        while i < len(stretches):
            n = 1
            if not alone[i]:
                while n < TOGETHER and i + n < len(stretches) and not alone[i + n]:
                    n += 1
            groups.append(stretches[i : i + n])
            i += n
        made = [part for group, ids in zip(groups, self.encode(list(map(" ".join, groups))), strict=True) for part in self.cut(group, ids)]
        return (np.concatenate([ids for ids, _ in made]), np.concatenate([n for _, n in made])) if made else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def cut(self, group: list[str], ids: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of a group, and how many each of its stretches has; where they don't give it back, those of its halves."""
        raw = [b" " + s.encode() for s in group]
        if b"".join(map(self.raw.__getitem__, ids)) == b"".join(raw):
            found = np.array(ids, np.int32)
            ends, want = np.cumsum(self.size[found]), np.cumsum(list(map(len, raw)))
            at = np.searchsorted(ends, want)
            if (ends[at] == want).all():
                return [(found, np.diff(at, prepend=-1))]
        if len(group) == 1:
            return [(np.zeros(0, np.int32), np.zeros(1, np.int64))]
        halves = [group[: len(group) // 2], group[len(group) // 2 :]]
        return [part for half, ids in zip(halves, self.encode(list(map(" ".join, halves))), strict=True) for part in self.cut(half, ids)]


def edged(stretch: str) -> bool:
    return stretch[0].isspace() or stretch[-1].isspace()


def edged_ones(parts: pa.Array) -> np.ndarray:
    """Which of these strings are empty or have white space at an edge."""
    n, offsets, held = len(parts), parts.buffers()[1], parts.buffers()[2]
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(parts.type) else np.int32)[parts.offset : parts.offset + n + 1] if n else np.zeros(1, np.int64)
    found = at[1:] == at[:-1]
    if found.all():
        return found
    data = np.frombuffer(held, np.uint8)
    plain = lambda x: (x > 0x20) & (x < 0x7F)
    rest = np.flatnonzero(~(found | plain(data[np.minimum(at[:-1], len(data) - 1)]) & plain(data[at[1:] - 1])))
    found[rest] = list(map(edged, parts.take(pa.array(rest)).to_pylist()))
    return found


def stretched(texts: pa.Array, split: Splitter) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Stretches, those of all texts one after another as places among them, and how many each text has; one that is null or empty has none."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    coded = parts.flatten().dictionary_encode()
    said, of = coded.dictionary, coded.indices.to_numpy()
    sizes = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = edged_ones(said)
    if bad.any():  # texts with such a part are cut one by one
        again = np.zeros(len(sizes), bool)
        again[np.repeat(np.arange(len(sizes)), sizes)[bad[of]]] = True
        lists = [split(t) if t else [] for t in texts.filter(pa.array(again)).to_pylist()]
        kept = of[~np.repeat(again, sizes)]
        sizes[again] = list(map(len, lists))
        more = pa.array([s for found in lists for s in found], pa.large_string())
        theirs = np.repeat(again, sizes)
        of = np.empty(len(theirs), np.int64)
        of[~theirs], of[theirs] = kept, np.arange(len(said), len(said) + len(more))
        said = pa.concat_arrays([said, more])
    return said, of, sizes


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Neighbouring rows of one block, with texts of CUT_BYTES in all, about; block and text are the first columns."""
    for b in batches:
        block, sizes = b.column(0).to_numpy(), pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64) // CUT_BYTES
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(upto) != 0)) + 1
        for at, to in pairwise([0, *edges.tolist(), b.num_rows]):
            if to > at:
                yield int(block[at]), b.slice(at, to - at)


@cache
def _sides(a: str, b: bytes) -> tuple[Side, Side]:
    return Side.byte_level(a), Side.piece_level(b)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    offsets[1:] = np.cumsum(counts)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encoded(stretches: DataFrame, a_model: str, b_model: bytes) -> DataFrame:
    """stretch, blocks, ids a and b, and their lengths a_size and b_size; all four empty where one side does not give the stretch back."""
    shared = stretches.sparkSession.sparkContext.broadcast((a_model, b_model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(*shared.value)
        for batch in batches:
            alone = edged_ones(batch.column(0))
            if alone.any():  # those with white space at an edge last, as each stands alone
                order = np.argsort(alone, kind="stable")
                batch, alone = batch.take(pa.array(order)), alone[order]
            texts = batch.column(0).to_pylist()
            made = [side.each(texts, alone.tolist()) for side in sides]
            both = (made[0][1] > 0) & (made[1][1] > 0)
            kept = [(ids[np.repeat(both, n)], n * both) for ids, n in made]
            columns = [_lists(*k) for k in kept] + [_lists(side.size[ids], n) for side, (ids, n) in zip(sides, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["stretch", "blocks", "a", "b", "a_size", "b_size"])

    return stretches.mapInArrow(run, "stretch string, blocks array<long>, a array<int>, b array<int>, a_size array<int>, b_size array<int>")


@contextmanager
def _kept_together(spark: SparkSession) -> Iterator[None]:
    """Within this block, rows that are dealt by a stretch meet for a join on stretch and end where they are."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _ends(entries: DataFrame, side: str) -> DataFrame:
    """(no, end, id): each token with the byte at which it ends."""
    rows = entries.select("no", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "t"))
    end = F.sum("t.size").over(Window.partitionBy("no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("no", end.alias("end"), F.col("t.id").alias(side))


def aligned(entries: DataFrame, width: int, kind: str) -> DataFrame:
    """(no, n_a, n_b, n_groups, groups, pairs, left, right): what a stretch adds to its document.

    A link is a pair a * width + b. Those of a small stretch are listed at once, each as often as
    it comes; of a large one there are its tokens by group instead, left and right, for links().
    Each group ends with a semicolon.
    """
    both = _ends(entries, "a").join(_ends(entries, "b"), ["no", "end"], "full")
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = F.sum(cut.cast("long")).over(Window.partitionBy("no").orderBy("end").rowsBetween(Window.unboundedPreceding, -1))
    numbered = both.select("no", "end", "a", "b", F.coalesce(before, F.lit(0)).alias("group"))
    met = numbered.groupBy("no").agg(F.collect_list(F.struct("group", "end", "a", "b")).alias("met"))
    of = lambda side, at: F.transform(F.filter("met", lambda x: x[side].isNotNull()), lambda x: F.struct(x["group"].alias("group"), F.lit(at).alias("side"), x["end"].alias("end"), x[side].alias("id")))
    sides = met.select("no", of("a", 0).alias("left"), of("b", 1).alias("right"))
    # In the order of what is said of them: by group, the tokens of a before those of b.
    ordered = sides.select("no", "left", "right", F.sort_array(F.concat("left", "right")).alias("all"))
    after = lambda i: F.get("all", i + 1)
    mark = lambda x, i: F.when(after(i)["side"] == x["side"], ",").when(x["side"] == 0, "|").otherwise(";")
    code = lambda x, y: (x["id"].cast("long") * width + y["id"]).cast(kind)
    small = F.size("left").cast("long") * F.size("right") <= SMALL
    pairs = F.flatten(F.transform("left", lambda x: F.transform(F.filter("right", lambda y: y["group"] == x["group"]), lambda y: code(x, y))))
    return ordered.select(
        "no", F.size("left").alias("n_a"), F.size("right").alias("n_b"), (F.element_at("all", -1)["group"] + 1).alias("n_groups"),
        F.array_join(F.transform("all", lambda x, i: F.concat(x["id"].cast("string"), mark(x, i))), "").alias("groups"),
        F.when(small, pairs).alias("pairs"), F.when(~small, F.col("left")).alias("left"), F.when(~small, F.col("right")).alias("right"),
    )


def links(held: DataFrame, width: int, kind: str) -> DataFrame:
    """(no, more, times): the different links of large stretches, and how often each comes.

    Equal ids of a group are counted before both sides are joined by group, so that there are as
    many rows as a group has different pairs.
    """
    counted = lambda side, name: held.filter("left is not null").select("no", F.explode(side).alias("t")).groupBy("no", "t.group", F.col("t.id").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    each = counted("left", "x").join(counted("right", "y"), ["no", "group"]).groupBy("no", (F.col("x").cast("long") * width + F.col("y")).cast(kind).alias("pair")).agg(F.sum(F.col("n_x") * F.col("n_y")).alias("n"))
    listed = each.groupBy("no").agg(F.collect_list(F.struct("pair", "n")).alias("l"))
    return listed.select("no", F.col("l.pair").alias("more"), F.col("l.n").alias("times"))


def _spoken(rows: DataFrame) -> DataFrame:
    """(block, stretch): the stretches of each block; one may come again where a block is read by several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = Splitter(), None
        seen: list[pa.Array] = []

        def full() -> bool:
            return sum(map(len, seen)) > GATHERED or sum(x.nbytes for x in seen) > 2 * BLOCK_BYTES

        def out() -> pa.RecordBatch:
            names = pa.chunked_array(seen).unique().cast(pa.string())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), at, np.int64)), names], ["block", "stretch"])

        for block, part in runs(batches):
            if block == at and full():
                seen[:] = [pa.chunked_array(seen).unique()]
            if block != at or full():
                if seen:
                    yield out()
                at = block
            said, of, _ = stretched(part.column(1), split)
            if len(of):
                seen.append(said.take(pa.array(np.flatnonzero(np.bincount(of, minlength=len(said))))))
        if seen:
            yield out()
        give_back()

    return rows.select("block", "text").mapInArrow(run, "block long, stretch string")


class Tables:
    """Reads the tables of blocks, rows in the same order each time; a block without a stretch of its own has none."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")

    def read(self, name: str, block: int | None, columns: list[str]) -> pa.Table | None:
        import pyarrow.parquet as pq
        from pyarrow import fs

        folder = f"{self.root}/{name}" + (f"/block={block}" if block is not None else "")
        files = sorted(f.path for f in self.store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        parts = [pq.read_table(f, filesystem=self.store, columns=columns, partitioning=None) for f in files if f.endswith(".parquet")]
        return pa.concat_tables(parts) if parts else None


def _write_blocks(df: DataFrame, path: str) -> None:
    with tidy(df.sparkSession):
        df.repartition("block").sortWithinPartitions("block").write.partitionBy("block").option("compression", "zstd").parquet(path)


#: What the first pass over documents reads of a stretch, and the second.
NAMED, COUNTED = ("stretch", "pairs", "times", "n_a", "n_b", "n_groups", "groups"), ("pairs", "times")


class Part:
    """Stretches of one table: where the links of each begin, and all links; with ``NAMED`` also what they are called and have."""

    def __init__(self, found: pa.Table | None, columns: tuple[str, ...]) -> None:
        n = found.num_rows if found is not None else 0
        self.bad = found["pairs"].is_null().to_numpy() if n else np.zeros(0, bool)
        self.starts, self.links = self.lists(found["pairs"]) if n else (np.zeros(1, np.int64), np.zeros(0, np.int32))
        # Where a link comes more than once, and how often.
        self.again = self.more = np.zeros(0, np.int64)
        if n and found["times"].null_count < n:
            self.again = places(self.starts, np.flatnonzero(found["times"].is_valid().to_numpy()))
            self.more = self.lists(found["times"])[1]
        if columns == NAMED:
            self.own = [found[c].fill_null(0).to_numpy().astype(np.int64) if n else np.zeros(0, np.int64) for c in NAMED[3:6]]
            self.names, self.said = [self.strings(found[c]) if n else pa.array([], pa.large_string()) for c in ("stretch", "groups")]

    @staticmethod
    def strings(column: pa.ChunkedArray) -> pa.Array:
        return pa.concat_arrays(column.cast(pa.large_string()).chunks)

    @staticmethod
    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each list begins, with the end of the last, and all their items; a null list has none."""
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        starts = np.zeros(len(column) + 1, np.int64)
        starts[1:] = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return starts, column.flatten().to_numpy(zero_copy_only=False)


def places(starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The places of the items of these lists."""
    size = starts[of + 1] - starts[of]
    return np.repeat(starts[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())


#: What this worker has read of the stretches of most blocks, of one run and one choice of columns.
_HELD: dict[tuple, Part] = {}


def _common(tables: Tables, columns: tuple[str, ...]) -> Part:
    """The stretches of most blocks, read once a worker; those of another pass go before."""
    key = (tables.root, columns)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Part(tables.read("common", None, list(columns)), columns)
    return _HELD[key]


class Block:
    """The stretches of most blocks, then those of one, by number, and their links one after another."""

    def __init__(self, tables: Tables, block: int, columns: tuple[str, ...]) -> None:
        common, part = _common(tables, columns), Part(tables.read("stretches", block, list(columns)), columns)
        joined = lambda x, y: np.concatenate([x, y])
        self.bad, self.links = joined(common.bad, part.bad), joined(common.links, part.links)
        self.again, self.more = joined(common.again, part.again + len(common.links)), joined(common.more, part.more)
        self.starts = joined(common.starts, part.starts[1:] + len(common.links))
        if columns == NAMED:
            self.own = [joined(x, y) for x, y in zip(common.own, part.own, strict=True)]
            self.names, self.said = pa.concat_arrays([common.names, part.names]), pa.concat_arrays([common.said, part.said])

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Of each stretch, the sum over its links, each as often as it comes. ``each`` is used up."""
        each[self.again] *= self.more
        return over(each, self.starts)


def over(each: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each list of these items."""
    upto = np.zeros((len(each) + 1, *each.shape[1:]), np.int64)
    np.cumsum(each, axis=0, out=upto[1:])
    return upto[starts[1:]] - upto[starts[:-1]]


def packed(items: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of int32 as bytes, which Spark passes on whole."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(items)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What packed() was given."""
    at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    return np.frombuffer(lists.buffers()[2] or b"", np.int32, (at[-1] - at[0]) // 4, at[0]), (at - at[0]) // 4


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _told(rows: DataFrame, root: str, kind: str) -> DataFrame:
    """Of each document, what does not depend on others, and its stretches' numbers as int32; and by block, in how many documents an id pair is linked.

    Rows of a pair have no document; a block that several tasks read has several rows for a pair.
    """
    schema = f"block long, pair long, n long, doc_id {kind}, {', '.join(f'{c} long' for c in SUMS[:4])}, groups_sha256 string, stretches binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, split, at, known, alike = Tables(root), Splitter(), None, None, None
        own = which = counts = stamp = np.zeros(0, np.int64)

        def made(doc_type: pa.DataType, size: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int64(), "pair": pa.int64(), "n": pa.int64(), "doc_id": doc_type} | dict.fromkeys(SUMS[:4], pa.int64()) | {"groups_sha256": pa.string(), "stretches": pa.binary()}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))

        def pairs(doc_type: pa.DataType) -> pa.RecordBatch:
            some = np.flatnonzero(counts)
            return made(doc_type, len(some), block=pa.array(np.full(len(some), at, np.int64)), pair=alike.take(pa.array(some)).cast(pa.int64()), n=pa.array(counts[some]))

        for block, part in runs(batches):
            doc_type = part.column(2).type
            if block != at:
                if at is not None:
                    yield pairs(doc_type)
                known = alike = own = which = counts = stamp = None  # before the next block is read
                at, known = block, Block(tables, block, NAMED)
                coded = pa.array(known.links).dictionary_encode()
                alike, which = coded.dictionary, coded.indices.to_numpy()
                own = np.stack([*known.own, known.sums(np.ones(len(known.links), np.int64)), known.bad], axis=1)
                counts, stamp = np.zeros(len(alike), np.int64), np.zeros(len(alike), np.int64)
                known.links = known.own = coded = None
            said, of, sizes = stretched(part.column(1), split)
            of = pc.index_in(said, value_set=known.names).fill_null(-1).to_numpy()[of]
            if (of < 0).any():
                raise KeyError(f"the tables of block {block} lack one of its stretches")
            bad = over(known.bad[of], begins(sizes)) > 0
            of, sizes = of[~np.repeat(bad, sizes)], np.where(bad, 0, sizes)
            starts = begins(sizes)
            sums = over(own[of], starts)
            # The groups of all stretches lie one after another, each with its semicolon.
            groups = known.said.take(pa.array(of))
            ends = np.frombuffer(groups.buffers()[1], np.int64)[groups.offset :][starts] if len(of) else np.zeros(len(starts), np.int64)
            text = memoryview(groups.buffers()[2] or b"")
            digests = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in pairwise(ends.tolist())]
            found = which[places(known.starts, of)]
            order = np.arange(len(found))
            for a, b in pairwise(begins(over((known.starts[1:] - known.starts[:-1])[of], starts)).tolist()):
                one = found[a:b]
                stamp[one] = order[a:b]  # of equal pairs the last remains, so each counts once
                counts[one[stamp[one] == order[a:b]]] += 1
            columns = {c: pa.array(np.ascontiguousarray(sums[:, i])) for i, c in enumerate(SUMS[:4])}
            yield made(doc_type, len(sizes), block=part.column(0), doc_id=part.column(2), groups_sha256=pa.array(digests, pa.string()), stretches=packed(of, starts), **columns)
        if at is not None:
            yield pairs(doc_type)
        del known, alike, own, which, counts, stamp
        give_back()

    return rows.select("block", "text", "doc_id").mapInArrow(run, schema)


def _summed(told: DataFrame, root: str, kind: str) -> DataFrame:
    """What was told of each document, and the sums over its links of their pairs' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, at = Tables(root), None
        sums = np.zeros((0, 2), np.int64)
        for b in batches:
            blocks = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(blocks)) + 1
            for begin, end in pairwise([0, *edges.tolist(), b.num_rows]):
                if begin == end:
                    continue
                part, block = b.slice(begin, end - begin), int(blocks[begin])
                if block != at:
                    sums = None  # before the next block is read
                    at, known = block, Block(tables, block, COUNTED)
                    more = tables.read("counts", block, ["pair", "documents", "best"])
                    if more is None:  # no document of the block has links
                        sums = np.zeros((len(known.bad), 2), np.int64)
                    else:
                        place = pc.index_in(pa.array(known.links, pa.int64()), value_set=more["pair"]).fill_null(0).to_numpy(zero_copy_only=False)
                        best, documents = more["best"].to_numpy().astype(np.int64), more["documents"].to_numpy()
                        sums = np.stack([known.sums(best[place]), known.sums(documents[place])], axis=1)
                    known = more = place = None
                of, starts = unpacked(part.column(1))
                total = over(sums[of], starts)
                columns = dict(zip(SUMS, [*part.columns[3:7], *(pa.array(np.ascontiguousarray(total[:, c])) for c in (0, 1))], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(2), *columns.values(), part.column(7)], ["doc_id", *SUMS, "groups_sha256"])
        del sums
        give_back()

    return told.select("block", "stretches", "doc_id", *SUMS[:4], "groups_sha256").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row's whole text.

    ``a_path`` is a byte-level model of the tokenizers library, which encodes a space and the
    text; ``b_path`` a sentencepiece BPE model, which adds the space by itself. Both are read on
    the driver. A text that is null or empty, or that either side's tokens do not give back, has
    no tokens: zeros and an empty string. Each row is a document, whatever its id: repeated rows
    count each, null ids stay. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    with open(a_path, encoding="utf-8") as f:
        a_model = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    width, most = len(Side.piece_level(b_model).raw), len(Side.byte_level(a_model).raw)
    stored = located(docs, scratch)
    text = F.col("row").getField("text").cast("string")
    n, size = stored.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    block = F.xxhash64("row_file", F.expr(f"row_at div {max(1, BLOCK_BYTES * n // max(size, 1))}L"))
    rows = stored.select(block.alias("block"), text.alias("text"), F.col("row").getField("doc_id").alias("doc_id"))

    # A stretch is in as many blocks as the input has at most: one for BLOCK_BYTES of text.
    made = encoded(_spoken(rows).groupBy("stretch").agg(F.collect_set("block").alias("blocks")), a_model, b_model)
    entries = scratch.write(made.withColumn("no", F.monotonically_increasing_id()), "entries", rows=F.count(F.lit(1)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scratch.seen("entries")["rows"] // TASK_STRETCHES))
    kind = "int" if width * most < 2**31 else "long"
    with _kept_together(spark):
        by_no = entries.repartition(tasks, "no")
        made = aligned(by_no.filter(F.size("a") > 0).select("no", "a", "b", "a_size", "b_size"), width, kind)
        held = scratch.write(by_no.select("no", "stretch", "blocks").join(made, "no", "left"), "held", packing="zstd", large=F.count("left"))
    scratch.drop("entries")
    listed = held.filter("left is null").select("stretch", "blocks", "n_a", "n_b", "n_groups", "groups", "pairs", F.lit(None).cast("array<long>").alias("times"))
    if scratch.seen("held")["large"]:  # few: only these are joined
        large = held.filter("left is not null").drop("pairs").join(links(held, width, kind).withColumnRenamed("more", "pairs"), "no")
        listed = listed.unionByName(large.select(*listed.columns))
    n_blocks = rows.select("block").distinct().count()
    most_have = F.size("blocks") * 2 > n_blocks
    with tidy(spark):
        listed.filter(most_have).drop("blocks").write.option("compression", "zstd").parquet(f"{scratch.path}/common")
    _write_blocks(listed.filter(~most_have).withColumn("block", F.explode("blocks")).drop("blocks"), f"{scratch.path}/stretches")
    scratch.drop("held")

    # In how many documents each pair is linked, and whether no pair of its first id is linked in more.
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    told = scratch.write(_told(rows, scratch.path, doc_kind), "told", packing="zstd")
    counted = told.filter("pair is not null").select("block", "pair", "n")
    totals = counted.groupBy("pair").agg(F.sum("n").alias("documents")).withColumn("first", F.expr(f"pair div {width}L"))
    top = totals.groupBy("first").agg(F.max("documents").alias("top"))
    totals = totals.join(top, "first").select("pair", "documents", (F.col("documents") == F.col("top")).alias("best"))
    _write_blocks(counted.select("block", "pair").distinct().join(totals, "pair"), f"{scratch.path}/counts")
    scratch.keep("told")
    return _summed(told.filter("pair is null"), scratch.path, doc_kind)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
