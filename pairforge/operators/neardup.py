"""Exact and near duplicates between two collections."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import hamming

HASH_BITS = 64
#: Values enumerated for a hash, over all bands, at most.
MOST_KEYS = 2500
#: Hashes whose near values one task makes.
HASHES_A_TASK = 4000


def members(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right has."""
    return left.join(right.select(key).distinct(), key, "left_semi")


def bands_of(most: int) -> tuple[list[tuple[int, int]], int]:
    """(shift, width) of the bands that hashes are met by, and the bits that may differ in one.

    Of hashes at most ``most`` bits apart, one of m bands differs in at most most // m bits. All
    values so near to a band's are enumerated on one side. m is that with the fewest chance
    meetings of which at most MOST_KEYS values are enumerated for a hash.
    """
    best = None
    for m in range(1, most + 2):
        edges = [i * HASH_BITS // m for i in range(m + 1)]
        widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
        keys = [sum(comb(w, i) for i in range(min(most // m, w) + 1)) for w in widths]
        chance = sum(k / 2**w for k, w in zip(keys, widths, strict=True))
        if sum(keys) <= MOST_KEYS and (best is None or chance < best[0]):
            best = (chance, list(zip(edges, widths, strict=False)), most // m)
    return best[1], best[2]


def _masks(width: int, bits: int) -> list[int]:
    return [sum(1 << i for i in chosen) for n in range(min(bits, width) + 1) for chosen in combinations(range(width), n)]


def _keyed(df: DataFrame, name: str, most: int, near: bool) -> DataFrame:
    """(name, band, bits): the value of each band of a hash or, with ``near``, all values so near to it."""
    bands, bits = bands_of(most)

    def values(i: int) -> Column:
        own = _band(F.col(name), *bands[i])
        if not near:
            return F.array(F.struct(F.lit(i).alias("band"), own.alias("bits")))
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(bands[i][1], bits)])
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("band"), own.bitwiseXOR(m).alias("bits")))

    each = F.explode(F.flatten(F.array(*map(values, range(len(bands))))))
    return df.withColumn("_k", each).select("*", "_k.band", "_k.bits").drop("_k")


def _band(column: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(column, at).bitwiseAND(F.lit((1 << width) - 1 if width < HASH_BITS else -1))


def met_first(most: int) -> Column:
    """Whether ha and hb, which meet in ``band``, meet in none before it."""
    bands, bits = bands_of(most)
    first = F.lit(len(bands))
    for i, (at, width) in reversed(list(enumerate(bands))):
        first = F.when(F.bit_count(_band(F.col("ha").bitwiseXOR(F.col("hb")), at, width)) <= bits, i).otherwise(first)
    return F.col("band") == first


def hamming_candidates(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(ha, hb) of distinct hashes that meet in a band, each pair once; the left ones are enumerated.

    Both sides are shuffled, whatever their size: Spark takes a table of near values to be as large
    as that of the hashes, and would send it to the driver to be broadcast.
    """
    met = _keyed(left, "ha", most, True).hint("merge").join(_keyed(right, "hb", most, False), ["band", "bits"])
    return met.filter(met_first(most)).select("ha", "hb")


def near_hashes(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(ha, hb, distance) of distinct hashes (ha) and (hb) at most ``most`` bits apart.

    The side with fewer hashes is the one whose near values are enumerated, by as many tasks as its
    hashes want. A band's value that very many hashes share is split by the adaptive handling of
    skewed joins, as both sides are plain shuffled tables.
    """
    n_left, n_right = left.count(), right.count()
    dealt = lambda hashes, n: hashes.repartition(max(1, -(-n // HASHES_A_TASK)), hashes.columns[0])
    if n_left <= n_right:
        met = hamming_candidates(dealt(left, n_left), right, most)
    else:
        met = hamming_candidates(dealt(right, n_right).withColumnRenamed("hb", "ha"), left.withColumnRenamed("ha", "hb"), most).select(F.col("hb").alias("ha"), F.col("ha").alias("hb"))
    return met.withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= most)


def _class_rows(rows: DataFrame, value: str, side: str) -> DataFrame:
    """(h<side>, <side>_id, n_<side>): the class of each hash, its least id and how many rows it has."""
    return rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias(f"h{side}")).agg(F.min("id").alias(f"{side}_id"), F.count("*").alias(f"n_{side}"))


def hamming_classes(left: DataFrame, right: DataFrame, most: int = 10, value: str = "hash") -> DataFrame:
    """(ha, hb, distance, a_id, b_id, n_a, n_b): near pairs of classes, a class being the rows of one hash.

    a_id and b_id stand for their classes; n_a * n_b pairs of rows are what a pair of classes
    tells of. A row's class is its own hash, so class_members() needs no join, and copies make no rows here.
    """
    a, b = _class_rows(left, value, "a"), _class_rows(right, value, "b")
    near = near_hashes(a.select("ha"), b.select("hb"), most)
    return near.join(a, "ha").join(b, "hb").select("ha", "hb", "distance", "a_id", "b_id", "n_a", "n_b")


def class_members(left: DataFrame, right: DataFrame, value: str = "hash") -> DataFrame:
    """(side, id, hash) of all rows with a hash: which class each is in."""
    own = lambda rows, side: rows.filter(F.col(value).isNotNull()).select(F.lit(side).alias("side"), "id", F.col(value).alias("hash"))
    return own(left, "a").unionByName(own(right, "b"))


def hamming_join(left: DataFrame, right: DataFrame, most: int = 10, value: str = "hash") -> DataFrame:
    """(a_id, b_id, distance) of all pairs of rows whose hashes are at most ``most`` bits apart.

    Copies meet once, as classes; here these are unfolded, g copies beside h into g * h rows. Use
    hamming_classes() where the pairs of rows are not wanted.
    """
    near = hamming_classes(left, right, most, value).select("ha", "hb", "distance")
    rows = lambda df, side: df.filter(F.col(value).isNotNull()).select(F.col("id").alias(f"{side}_id"), F.col(value).alias(f"h{side}"))
    return near.join(rows(left, "a"), "ha").join(rows(right, "b"), "hb").select("a_id", "b_id", "distance")


def write_index(left: DataFrame, table: str, path: str, most: int = 10, value: str = "hash", buckets: int = 16) -> None:
    """Write the classes of one side by every band value that is near to theirs, bucketed by it: the side that a stream is held against."""
    keyed = _keyed(_class_rows(left, value, "a"), "ha", most, True)
    keyed.repartition(buckets, "band", "bits").write.bucketBy(buckets, "band", "bits").sortBy("band", "bits").option("path", path).saveAsTable(table)


def near_in_index(rows: DataFrame, index: DataFrame, most: int = 10, value: str = "hash") -> DataFrame:
    """(id, hb, ha, distance, a_id, n_a): rows, which may be a stream, beside each near class of an index.

    A row is looked up by its own bands alone. The index is bucketed by what it is joined on, so
    no batch of a stream deals it out again.
    """
    known = rows.filter(F.col(value).isNotNull()).select("id", F.col(value).alias("hb"))
    met = _keyed(known, "hb", most, False).join(index, ["band", "bits"]).filter(met_first(most))
    return met.withColumn("distance", hamming(F.col("ha"), F.col("hb"))).filter(F.col("distance") <= most).select("id", "hb", "ha", "distance", "a_id", "n_a")


def agreeing_classes(left: DataFrame, right: DataFrame, hashes: list[str], within: int = 6, least: int = 3) -> DataFrame:
    """(a_id, b_id, votes, n_a, n_b) of rows that at least ``least`` of several hashes put within ``within`` bits.

    Rows alike in all hashes are one class. Of n hashes with ``least`` votes, any n - least + 1 have
    one: so the classes are met by near values of that many hashes, and then held against all.
    """
    def classes(rows: DataFrame, side: str) -> DataFrame:
        known = rows.dropna(subset=hashes).groupBy(*hashes).agg(F.min("id").alias(f"{side}_id"), F.count("*").alias(f"n_{side}"))
        return known.select(f"{side}_id", f"n_{side}", *[F.col(h).alias(f"{side}_{h}") for h in hashes])

    a, b = classes(left, "a"), classes(right, "b")
    met = None
    for h in hashes[: len(hashes) - least + 1]:
        near = near_hashes(a.select(F.col(f"a_{h}").alias("ha")).distinct(), b.select(F.col(f"b_{h}").alias("hb")).distinct(), within).select("ha", "hb")
        own = near.join(a.select("a_id", F.col(f"a_{h}").alias("ha")), "ha").join(b.select("b_id", F.col(f"b_{h}").alias("hb")), "hb").select("a_id", "b_id")
        met = own if met is None else met.unionByName(own).distinct()
    both = met.join(a, "a_id").join(b, "b_id").withColumns({f"_{h}": hamming(F.col(f"a_{h}"), F.col(f"b_{h}")) for h in hashes})
    return agreeing(both, [f"_{h}" for h in hashes], within, least).select("a_id", "b_id", "votes", "n_a", "n_b")


def distance_bands(pairs: DataFrame, bands: tuple[int, ...] = (0, 2, 4, 6, 8, 10)) -> DataFrame:
    """How many pairs lie within each distance; of pairs of classes, those of their rows."""
    each = F.col("n_a") * F.col("n_b") if {"n_a", "n_b"} <= set(pairs.columns) else F.lit(1)
    counts = pairs.agg(*[F.coalesce(F.sum(F.when(F.col("distance") <= b, each)), F.lit(0)).cast("long").alias(f"b{b}") for b in bands])
    stacked = ", ".join(f"{b}, b{b}" for b in bands)
    return counts.selectExpr(f"stack({len(bands)}, {stacked}) as (distance, n)")


def agreeing(pairs: DataFrame, distances: list[str], within: int = 6, least: int = 3) -> DataFrame:
    """Pairs that at least ``least`` hashes put within ``within`` bits."""
    votes = reduce(lambda a, b: a + b, [F.when(F.col(d) <= within, 1).otherwise(0) for d in distances])
    return pairs.withColumn("votes", votes).filter(F.col("votes") >= least)


def exclusion(distance: Column, exact: Column, licensed: Column) -> Column:
    """Whether an image may be used beside an evaluation set: by equal bytes, near hashes and licence."""
    return F.when(exact, "reject_exact").when(distance <= 4, "reject_near").when(distance <= 10, "review").when(~licensed, "reject_license").otherwise("keep")
