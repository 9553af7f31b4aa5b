"""Size-aware heavy-light similarity join on word n-grams: Jaccard of at least t (0.8 or more), exactly.

Sets are classes of equal sets first, so copies are never compared. Shingles are ordered:
those that many documents share last, else by hash. Two sets that link share at least c
shingles within the first n - ceil(t n) + c of each (n: the set's size).

* Small sets enumerate all subsets of SUBSET = 2 shingles of that prefix, with c = 2. Sets that
  link share a subset.
* Large sets scan inverted lists of their prefix's shingles, with a larger c, and keep the
  shingles that another set lists. These fall into c - 1 parts by hash, so sets that link share
  two shingles of one part: subsets are enumerated within parts only, of listed shingles only.

The boundary between small and large is the one with the least cost, counted from the sizes of
all sets. Sets just below a boundary take part above it, too, so no pair is lost.

Sets that share a subset are joined to the least of them, not to each other; components of
those edges are clusters. Sets that share a subset and no more could chain unrelated ones into
a wide cluster. So in clusters of more than WIDE blocks, the sets of each subset that at most
GROUP sets share are held against each other by bitmaps, whose differences bound those of the
sets, and only pairs that may link join their clusters. Clusters are cut into blocks of bounded
size, and each pair of blocks is compared in full, by a matrix product over the shingles that
two or more of its sets have. So the links are exact, and no row is made for a pair of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairforge.llm.common import PLACE, Scratch, fetch, give_back, located, lookup, small_batches
from pairforge.llm.components import components

SUBSET = 2
#: So many of the most frequent shingles are put last. Any other is on less than 1/FREQUENT of all
#: rows, so its list is never hot at any size; the links found do not depend on the order.
FREQUENT = 65_536
#: Shingles gathered before frequent ones are counted, and the count from which one is passed on:
#: what is not passed on is on less than LEAST/GATHER of all rows.
GATHER, LEAST = 1_500_000, 3
#: A block holds at most about so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17
#: Small clusters are put together up to about so many shingles.
BIN_SHINGLES = 1 << 16
#: Clusters of more blocks are looked at again, subset by subset, but for subsets of more sets.
WIDE, GROUP = 4, 256
#: Bits of a set's bitmap for each of its shingles, at least.
BITS = 4
MEMO = 150_000
#: Above the boundary: (least size, c) for 0.9. c grows with the size, and as prefixes do, to keep parts small.
LEVELS = ((640, 96), (5120, 768), (40_960, 6144), (327_680, 49_152))
FIRST_C = 16
BOUNDARIES = range(20, 321, 20)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z in lower case.

    The lowest bit is free: it tells frequent shingles from the rest later on.
    """

    def __init__(self, width: int = 3) -> None:
        self.width, self.words = width, _Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        at = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        w = min(self.width, n)
        h = np.full(n - w + 1, w, np.uint64)
        for i in range(w):
            h = (h ^ at[i : n - w + 1 + i]) * _A
            h ^= h >> np.uint64(31)
        h *= _B
        h ^= h >> np.uint64(29)
        h *= _C
        return np.unique(h & ~np.uint64(1))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(n: int, c: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + c)


def smallest(percent: int) -> int:
    """The size of the least set that another set can link with: n of n + 1 shingles are shared."""
    return -(-percent // max(1, 100 - percent))


def levels(boundary: int, percent: int) -> list[tuple[int, int]]:
    wider = max(1, (100 - percent) // 10)
    return [(0, SUBSET), *((least, wider * c) for least, c in ((boundary, FIRST_C), *LEVELS))]


def roles(n: int, table: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """(c, prefix length) at the level of a set of n shingles, and at the next if a partner can be there."""
    if n < smallest(percent):
        return []
    k = max(i for i, (least, _) in enumerate(table) if n >= least)
    found = [k] + [k + 1] * (k + 1 < len(table) and 100 * n >= percent * table[k + 1][0])
    return [(table[i][1], prefix(n, table[i][1], percent)) for i in found]


def boundary(sizes: dict[int, int], listed: float, percent: int) -> int:
    """The least costly boundary: rows made for small sets' subsets, large sets' lists and their subsets.

    ``sizes``: documents by set size; ``listed``: the share of shingles that other sets list.
    """

    def cost(x: int) -> float:
        total = 0.0
        table = levels(x, percent)
        for n, count in sizes.items():
            for c, p in roles(n, table, percent):
                if c == SUBSET:
                    total += count * comb(p, SUBSET)
                else:
                    total += count * (p + (listed * p) ** 2 / (2 * (c - 1)))
        return total

    # Sets that link at a level must share c shingles.
    return min((x for x in BOUNDARIES if least_overlap(x, percent) >= levels(x, percent)[1][1]), key=cost)


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Counts over all documents: (0, shingle, n) frequent ones, (1, size, n) sets by size, (2, 0 or 1, n) repeated and all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, total = Shingler(width), [], 0

        def flush() -> pa.RecordBatch:
            all_ = np.concatenate(held) if held else np.empty(0, np.uint64)
            value, count = np.unique(all_, return_counts=True)
            size, sets = np.unique(np.minimum([len(x) for x in held], 1 << 20), return_counts=True) if held else (np.empty(0), np.empty(0))
            often = count >= LEAST
            kinds = np.repeat([0, 1, 2], [often.sum(), len(size), 2])
            keys = np.concatenate([value[often].view(np.int64), size.astype(np.int64), [0, 1]])
            ns = np.concatenate([count[often], sets.astype(np.int64), [count[count > 1].sum(), len(all_)]]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(ns, pa.int64())], ["kind", "key", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingles(text)
                if len(s):
                    held.append(s)
                    total += len(s)
                if total >= GATHER:
                    yield flush()
                    held.clear()
                    total = 0
        yield flush()
        held.clear()
        give_back()

    return docs.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """s in the common order, frequent shingles marked by the lowest bit."""
    if not len(frequent):
        return s
    k = np.searchsorted(frequent, s)
    k[k == len(frequent)] = 0
    often = frequent[k] == s
    return np.concatenate([s[~often], s[often] | np.uint64(1)])


def _sets(docs: DataFrame, width: int, frequent: np.ndarray, table: list[tuple[int, int]], percent: int) -> DataFrame:
    """doc_id, row_file, row_at, n, digest, the prefix as tokens, and up to two roles (c1, p1), (c2, p2) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(width)
        for b in batches:
            size, digest, tokens, ends, role = [], [], [], [0], []
            for text in b.column(3).to_pylist():
                s = shingles(text)
                r = roles(len(s), table, percent)
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                role.append([*(x for pair in r for x in pair), 0, 0, 0, 0][:4])
                if r:
                    tokens.append(_order(s, shared.value)[: max(p for _, p in r)])
                ends.append(ends[-1] + (len(tokens[-1]) if r else 0))
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, np.int64)
            role_cols = list(zip(*role, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *(pa.array(c, pa.int32()) for c in role_cols)],
                ["doc_id", *PLACE, "n", "digest", "tokens", "c1", "p1", "c2", "p2"],
            )
        del shingles
        give_back()

    return docs.select("doc_id", *PLACE, F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, row_file long, row_at long, n long, digest binary, tokens array<long>, c1 int, p1 int, c2 int, p2 int")


def _pairs(lists: DataFrame) -> DataFrame:
    """(key, rid, hot) of all subsets of two tokens of each list; hot if both are frequent."""
    first = lists.select("rid", "c", F.posexplode("tokens").alias("i", "a"), "tokens")
    both = first.select("rid", "c", "a", F.explode(F.slice("tokens", F.col("i") + 2, F.size("tokens"))).alias("b"))
    return both.select(F.xxhash64("c", "a", "b").alias("key"), "rid", ((F.col("a").bitwiseAND(F.lit(1)) == 1) & (F.col("b").bitwiseAND(F.lit(1)) == 1)).alias("hot"))


def _edges(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): v is the least class that shares a subset of two shingles with u."""
    role = F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("p1").alias("p")), F.struct(F.col("c2").alias("c"), F.col("p2").alias("p"))))
    taking = classes.select("rid", "tokens", role.alias("role")).filter("role.c > 0").select("rid", F.col("role.c").alias("c"), F.slice("tokens", F.lit(1), F.col("role.p")).alias("tokens"))
    small = taking.filter(F.col("c") == SUBSET).select("rid", "c", F.array_sort("tokens").alias("tokens"))
    posted = taking.filter(F.col("c") > SUBSET).select("rid", "c", F.explode("tokens").alias("token"))
    # A frequent shingle is listed by others for certain; so only the short lists are gathered.
    often = F.col("token").bitwiseAND(F.lit(1)) == 1
    listed = posted.filter(~often).withColumn("others", F.count("*").over(Window.partitionBy("token", "c"))).filter("others > 1").drop("others")
    part = F.pmod(F.xxhash64("token"), F.col("c") - 1)
    large = listed.unionByName(posted.filter(often)).groupBy("rid", "c", part.alias("part")).agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    keys = scratch.write(_pairs(small.select("rid", "c", "tokens").unionByName(large.select("rid", "c", "tokens"))), "keys")
    cold = keys.filter("not hot").withColumn("v", F.min("rid").over(Window.partitionBy("key"))).filter("rid <> v").select(F.col("rid").alias("u"), "v")
    hot = keys.filter("hot").select("key", "rid").distinct()
    least = hot.groupBy("key").agg(F.min("rid").alias("v"))
    return cold.unionByName(hot.join(least, "key").filter("rid <> v").select(F.col("rid").alias("u"), "v")).distinct()


def bitmap(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles hash to i. Differing bits are at most differing shingles."""
    log2 = max(6, int(BITS * len(shingles) - 1).bit_length())
    at = (shingles * _B) >> np.uint64(64 - log2)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=1 << log2) & 1).astype(np.uint8)).tobytes()


#: Bits of each bitmap that are compared at once.
SLICE = 1 << 16


def may_link(maps: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """By pair of sets, whether their sizes and bitmaps allow a link. No pair that links is left out."""
    width = np.array([8 * len(m) for m in maps])
    out = np.zeros((len(maps), len(maps)), bool)
    for w in np.unique(width):
        # A partner has at most percent / 100 times as many shingles, so its bitmap is as wide or twice as wide.
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        ones, common = np.zeros(len(rows)), np.zeros((len(rows), len(rows)))
        for start in range(0, w, SLICE):  # so that memory does not grow with the sets
            end = min(w, start + SLICE)
            bits = np.empty((len(rows), end - start), np.float32)
            for k, i in enumerate(rows):
                fold = width[i] // w
                bits[k] = np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(maps[i], np.uint8, (end - start) * fold // 8, start * fold // 8)).reshape(-1, fold), axis=1)
            ones += bits.sum(axis=1)
            common += bits @ bits.T
        differ = np.rint(ones[:, None] + ones[None, :] - 2 * common).astype(np.int64)
        both = n[rows][:, None] + n[rows][None, :]
        most = np.minimum((both - differ) // 2, np.minimum(n[rows][:, None], n[rows][None, :]))
        out[np.ix_(rows, rows)] |= (100 * most >= percent * (both - most)) & ((width[rows] == w)[:, None] | (width[rows] == w)[None, :])
    np.fill_diagonal(out, False)
    return out


def _may(table: pa.Table, percent: int) -> pa.Table:
    """(u, v) that join the sets of each key that may link: each to the least that it reaches."""
    key, rid, n = (table.column(c).combine_chunks().to_numpy() for c in ("key", "rid", "n"))
    maps = table.column("map").to_pylist()
    order = np.lexsort((rid, key))
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at, end in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        rows = order[at:end]
        if len(rows) > 1:
            label = _labels(may_link([maps[i] for i in rows], n[rows], percent))
            moved = label != np.arange(len(rows))
            us.append(rid[rows][moved])
            vs.append(rid[rows][label[moved]])
    return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})


def _labels(linked: np.ndarray) -> np.ndarray:
    """By row, the least row that links reach."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def narrowed(keys: DataFrame, maps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): edges among the sets of maps (rid, n, map) that join all that may link.

    ``keys`` has key and rid. Sets of a key that more than GROUP have are joined to the least.
    """
    own = scratch.write(keys.select("key", "rid").distinct().join(maps.select("rid"), "rid"), "wide-keys")
    sizes = scratch.write(own.groupBy("key").agg(F.count("*").alias("sets"), F.min("rid").alias("v")).filter("sets > 1"), "wide-sizes")
    large = lookup(own, sizes.filter(F.col("sets") > GROUP), "key", "sets").filter("rid <> v").select(F.col("rid").alias("u"), "v")
    small = lookup(own, sizes.filter(F.col("sets") <= GROUP), "key", "sets").select("key", "rid")
    bins = max(1, -(-small.count() // 4096))
    full = small.join(maps, "rid").withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    met = full.groupBy("bin").applyInArrow(lambda t: _may(t, percent), "u long, v long")
    return large.unionByName(met).distinct()


def _links(table: pa.Table, percent: int) -> pa.Table:
    """The links within one tile: (rid, label, links). label joins the sets of a tile that link."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cols = {c: table.column(c).combine_chunks() for c in table.column_names}
    rid, copies, blk, lo, hi, cluster = (cols[c].to_numpy() for c in ("rid", "copies", "blk", "lo", "hi", "cluster"))
    lists = cols["shingles"]
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.lexsort((rid, hi, lo, cluster))
    new = np.r_[True, (np.diff(cluster[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)]
    starts = np.flatnonzero(new)
    for at, end in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        rows = order[at:end]
        if len(rows) < 2:
            continue
        sizes = ends[rows + 1] - ends[rows]
        tokens = np.concatenate([flat[ends[r] : ends[r + 1]] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        column, owner = column[shared], owner[shared]
        number = np.cumsum(count > 1) - 1
        column = number[column]
        both = np.zeros((len(rows), len(rows)), np.int64)
        for first in range(0, int((count > 1).sum()), 8192):
            here = (column >= first) & (column < first + 8192)
            m = np.zeros((len(rows), 8192), np.float32)
            m[owner[here], column[here] - first] = 1
            both += (m @ m.T).astype(np.int64)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(linked, False)
        if lo[rows[0]] != hi[rows[0]]:  # pairs within a block belong to its own tile
            linked &= blk[rows][:, None] != blk[rows][None, :]
        if not linked.any():
            continue
        label = _labels(linked)
        some = linked.any(axis=1)
        out.append((rid[rows][some], rid[rows][label][some], (linked * copies[rows][None, :]).sum(axis=1)[some]))
    got = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return pa.table({"rid": pa.array(got[0], pa.int64()), "label": pa.array(got[1], pa.int64()), "links": pa.array(got[2], pa.int64())})


def _members(classes: DataFrame, clusters: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The classes of clusters (rid, cluster) of two or more, each with how many blocks its cluster has."""
    rows = classes.select("rid", "first", "copies", "n").join(clusters, "rid")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    sizes = scratch.sized(rows.groupBy("cluster").agg(blocks.alias("blocks"), F.count("*").alias("sets")), f"{name}-sizes", "sets")
    return scratch.write(lookup(rows, sizes, "cluster", "sets").drop("sets"), name)


def _bitmaps(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(rid, n, map) of members."""
    rows = fetch(docs.select(*PLACE, F.encode("text", "UTF-8").alias("text")), members.select("first.row_file", "first.row_at", "rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            sets = [shingles(text) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(bitmap, sets), pa.binary())], ["rid", "n", "map"])
        del shingles
        give_back()

    return rows.select("rid", "text").mapInArrow(run, "rid long, n long, map binary")


def _compare(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Compare the sets of each cluster, block by block: (rid, label, links)."""
    spark = docs.sparkSession
    total = members.agg(F.count("*"), F.sum("n")).first()
    bins = max(1, -(-(total[1] or 0) // BIN_SHINGLES))
    wanted = members.select("first.row_file", "first.row_at", "rid", "copies", "cluster", "blocks", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("long").alias("blk"))
    texts = docs.select(*PLACE, F.encode("text", "UTF-8").alias("text"))
    rows = fetch(texts, wanted)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            sets = [shingles(text) for text in b.column(0).to_pylist()]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["rid", "copies", "cluster", "blocks", "blk", "shingles"])
        del shingles
        give_back()

    sets = rows.select("text", "rid", "copies", "cluster", "blocks", "blk").mapInArrow(shingled, "rid long, copies long, cluster long, blocks long, blk long, shingles array<long>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiled = sets.withColumn("other", other).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.xxhash64("cluster", "lo", "hi"))
    tiled = tiled.select(tile.cast("long").alias("tile"), "rid", "copies", "blk", "lo", "hi", "cluster", "shingles")
    return tiled.groupBy("tile").applyInArrow(lambda t: _links(t, percent), "rid long, label long, links long")


def jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and n_links of each row.

    Two documents link if 100 * intersection >= percent * union of their shingle sets; percent
    is at least 80. A text of fewer words than ``width`` is one shingle; a null text, or one
    without words, has none and links with nothing. component_id is the least doc_id that links
    reach, class_id the least with an equal set, n_links the number of documents linked. Rows
    that repeat an id count as documents each; a null id is above all others and is returned
    only where no other is reached. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows = located(docs.select("doc_id", "text"), scratch)
    return join_rows(rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), *PLACE), scratch, width, percent).drop(*PLACE, "stays")


def join_rows(docs: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """The same for rows of doc_id, text, row_file and row_at, which come back, with stays.

    stays is true of one row of each component: of that with the least doc_id (null ids last),
    the one stored first.
    """
    if percent < 80:
        raise ValueError("prefixes are laid out for 80 percent or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *PLACE)
    with small_batches(docs.sparkSession):
        sets, per_class = _joined(docs, scratch, width, percent)
    scratch.keep("sets", "per-class", *[n for n in scratch.names if n.startswith("rows-")])
    full = lookup(sets.filter("n > 0"), per_class, "digest", "copies")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
    full = full.select("doc_id", *PLACE, F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), F.col("first.doc_id").alias("class_id"), "n_links", (F.col("least") == own).alias("stays"))
    bare = sets.filter("n = 0").select("doc_id", *PLACE, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return full.unionByName(bare)


def _joined(docs: DataFrame, scratch: Scratch, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The set of each row, and of each class of equal sets its first row, its component's first row and its links."""
    survey = scratch.write(_survey(docs, width), "survey")
    top = survey.filter((F.col("kind") == 0) & (F.col("n") >= 2 * LEAST)).orderBy(F.col("n").desc(), "key").limit(FREQUENT).select("key").toPandas()
    frequent = np.sort(top["key"].to_numpy(np.int64).view(np.uint64))
    sizes = {r.key: r.n for r in survey.filter((F.col("kind") == 1) & (F.col("key") < 2 * max(BOUNDARIES))).collect()}
    seen = {r.key: r.n for r in survey.filter("kind = 2").collect()}
    table = levels(boundary(sizes, seen.get(0, 0) / max(1, seen.get(1, 0)), percent), percent)

    sets = scratch.write(_sets(docs, width, frequent, table, percent), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *PLACE)
    grouped = sets.filter("n > 0").groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("tokens", "c1", "p1", "c2", "p2")])
    classes = scratch.write(grouped.withColumn("rid", F.monotonically_increasing_id()), "classes")
    clusters = components(scratch.write(_edges(classes, scratch), "edges"), scratch, "clusters").withColumnsRenamed({"node": "rid", "label": "cluster"})
    members = _members(classes, scratch.write(clusters, "cluster-of"), scratch, "members")
    wide = members.filter(F.col("blocks") > WIDE)
    if wide.limit(1).count():
        maps = scratch.write(_bitmaps(docs, wide, width), "maps")
        again = components(scratch.write(narrowed(scratch.table("keys"), maps, percent, scratch), "wide-edges"), scratch, "narrow").withColumnsRenamed({"node": "rid", "label": "cluster"})
        rest = members.filter(F.col("blocks") <= WIDE).select("rid", "cluster")
        # The least set of a cluster names it, so names stay apart.
        members = _members(classes, scratch.write(rest.unionByName(again), "clusters-again"), scratch, "members-again")
    scratch.drop("keys", "wide-keys")

    links = scratch.write(_compare(docs, members, width, percent), "links")
    joined = components(links.select(F.col("rid").alias("u"), F.col("label").alias("v")), scratch, "joined").withColumnsRenamed({"node": "rid", "label": "component"})
    degree = links.groupBy("rid").agg(F.sum("links").alias("links"))
    small = scratch.write(classes.select("rid", "first").join(joined, "rid"), "joined-classes")
    least = scratch.sized(small.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("n_classes")), "least", "n_classes")
    found = lookup(small, least, "component", "n_classes").join(degree, "rid").select("rid", "least", "links")
    per_class = classes.select("rid", "digest", "first", "copies").join(found, "rid", "left")
    per_class = per_class.select("digest", "first", "copies", F.coalesce("least", "first").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sets, scratch.sized(per_class, "per-class", "copies")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
classes AS (
  SELECT min(doc_id) AS class_id, count(*) AS copies, len(k) AS n, k FROM (SELECT doc_id, list_sort(s) AS k FROM sets WHERE len(s) > 0) GROUP BY k),
shingles AS (SELECT class_id, n, unnest(k) AS shingle FROM classes),
rare AS (SELECT * FROM shingles WHERE shingle IN (SELECT shingle FROM shingles GROUP BY 1 HAVING count(*) > 1)),
links AS (
  SELECT a.class_id AS u, b.class_id AS v
  FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.class_id <> b.class_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT class_id AS u, class_id AS v FROM classes WHERE class_id IN (SELECT u FROM links)
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
component AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
degree AS (SELECT u, sum(c.copies) AS links FROM links JOIN classes c ON c.class_id = v GROUP BY u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, c.class_id, s.doc_id) AS component_id,
       coalesce(c.class_id, s.doc_id) AS class_id, (coalesce(d.links, 0) + coalesce(c.copies - 1, 0))::BIGINT AS n_links
FROM sets s LEFT JOIN classes c ON len(s.s) > 0 AND list_sort(s.s) = c.k
LEFT JOIN component m ON m.u = c.class_id LEFT JOIN degree d ON d.u = c.class_id
"""
