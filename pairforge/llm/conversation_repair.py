"""Conversation structure repair: the cheapest edits that give a well-formed order of roles.

Rows of a conversation, in order, are one letter each: role and fault. Strings of letters are cut
into segments, and equal segments are solved once: sorted, they are read into a prefix trie of
which the path to the latest segment is at hand, so the layers of the dynamic program that two
neighbours share are those of their common prefix. A layer holds, for each state before the
segment and each after it, the least cost and the least string of edits of that cost. A
conversation of several segments is solved by chaining these, so a long one is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import BATCH_ROWS, Scratch, lookup, sliced

#: Letters of a segment at most.
SEGMENT = 256

# The faults of a row, what edits cost, and their initials.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
KEEP, REROLE, DELETE, INSERT, KEPT_TRUNCATED = 0, 3, 4, 3, 3
KEPT, RENAMED, DELETED, INSERTED = "K", "R", "D", "I"
#: The letters of a row: lower case without a fault, upper case if truncated, and for rows that must go by role. The last of each is any other role.
SOUND, CUT, GONE = "suao", "SUAO", "1234"

# The states of `(s?(ua)+)?`: nothing yet, after s, after u, after a. By state, what a role's initial leads to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
#: The role that an inserted or renamed row has by state, and where it leads to.
NEXT = (("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U))
ENDS = (START, AFTER_A)

#: What a state after a prefix has: the least cost and, of that cost, the least edits; None if it cannot be reached.
Layer = tuple[tuple[int, str] | None, ...]


def _better(found: list[tuple[int, str] | None], state: int, way: tuple[int, str]) -> None:
    if found[state] is None or way < found[state]:
        found[state] = way


def inserted(layer: Layer) -> list[tuple[int, str] | None]:
    """The layer with any rows inserted at its end."""
    found = list(layer)
    for _ in range(len(NEXT) - 1):
        for state, way in enumerate(tuple(found)):
            if way is not None:
                _better(found, NEXT[state][1], (way[0] + INSERT, way[1] + INSERTED))
    return found


def after(layer: Layer, letter: str) -> Layer:
    """The layer after one more row: rows may be inserted before it; it is deleted, kept or renamed."""
    found: list[tuple[int, str] | None] = [None] * len(NEXT)
    more = KEPT_TRUNCATED if letter in CUT else 0
    for state, way in enumerate(inserted(layer)):
        if way is None:
            continue
        cost, edits = way
        _better(found, state, (cost + DELETE, edits + DELETED))
        if letter in GONE:
            continue
        if (to := STEP[state].get(letter.lower())) is not None:
            _better(found, to, (cost + KEEP + more, edits + KEPT))
        _better(found, NEXT[state][1], (cost + REROLE + more, edits + RENAMED))
    return tuple(found)


class Trie:
    """The path from the root of a prefix trie to the segment read last, with the layers of each node, from each state."""

    def __init__(self) -> None:
        empty = (0, "")
        self.text = ""
        self.layers: list[tuple[Layer, ...]] = [tuple(tuple(empty if s == t else None for t in range(len(NEXT))) for s in range(len(NEXT)))]
        self.made = 0

    def solve(self, segment: str) -> tuple[Layer, ...]:
        """The layers at the segment's node. In sorted order each node's are made once."""
        common = next((i for i, (a, b) in enumerate(zip(self.text, segment, strict=False)) if a != b), min(len(self.text), len(segment)))
        del self.layers[common + 1 :]
        for letter in segment[common:]:
            self.layers.append(tuple(after(layer, letter) for layer in self.layers[-1]))
            self.made += 1
        self.text = segment
        return self.layers[-1]


def finished(layer: Layer) -> tuple[int, str]:
    """The cheapest edits, of a layer after the last row, that end well."""
    whole = inserted(layer)
    return min(whole[s] for s in ENDS if whole[s] is not None)


def solved(segments: DataFrame) -> DataFrame:
    """sig, cost and edits of a whole conversation, and costs, ranks and ways of a part of one: by state before * 4 + state after.

    ``segments`` has each sig once. They are dealt out in their order, so that each task reads its
    own into one trie. A way that is not there costs -1. Ranks order the ways of a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for b in batches:
            rows = []
            for sig in b.column(0).to_pylist():
                layers = trie.solve(sig)
                flat = [way for layer in layers for way in layer]
                names = [way[1] if way else "" for way in flat]
                order = {n: i for i, n in enumerate(sorted(set(names)))}
                rows.append((*finished(layers[START]), [way[0] if way else -1 for way in flat], [order[n] for n in names], names))
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
            found = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(found, kinds, strict=True))], ["sig", "cost", "edits", "costs", "ranks", "ways"])

    ordered = segments.select("sig").repartitionByRange("sig").sortWithinPartitions("sig")
    return ordered.mapInArrow(run, "sig string, cost long, edits string, costs array<long>, ranks array<int>, ways array<string>")


def chained(parts: DataFrame) -> DataFrame:
    """key, part, seg, sig, pick (state before * 4 + state after), cost and close of the segments of conversations with several.

    Costs to the end are summed from the last segment on; then, from the first on, of the cheapest
    ways that with the least edits is taken. No way of a segment begins another, so that is the
    least string of all. A conversation brings 16 costs and ranks for SEGMENT of its rows.
    """
    size = len(NEXT)
    close = {s: finished(tuple((0, "") if s == t else None for t in range(size))) for s in range(size)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "seg"], kind="stable").reset_index(drop=True)
        rest = [close[s][0] for s in range(size)]
        best = [rest]
        for costs in reversed(rows["costs"].tolist()):
            rest = [min((costs[size * s + t] + rest[t] for t in range(size) if costs[size * s + t] >= 0 and rest[t] is not None), default=None) for s in range(size)]
            best.append(rest)
        best.reverse()
        state, picks = START, []
        for i, (costs, ranks) in enumerate(zip(rows["costs"], rows["ranks"], strict=True)):
            ways = [t for t in range(size) if costs[size * state + t] >= 0 and best[i + 1][t] is not None and costs[size * state + t] + best[i + 1][t] == best[i][state]]
            to = min(ways, key=lambda t: ranks[size * state + t])
            picks.append(size * state + to)
            state = to
        return rows[["key", "part", "seg", "sig"]].assign(pick=picks, cost=best[0][START], close=close[state][1])

    return parts.select("key", "part", "seg", "sig", "costs", "ranks").groupBy("key").applyInPandas(run, "key string, part int, seg int, sig string, pick int, cost long, close string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) after damage by crc32 of conv_id:turn; ``times`` is 2 for one that comes twice.

    A null counts as one space: in the hashed string, as a role and as a text. The turn stays null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    return rows.filter(kind != 0).select("key", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"), F.unhex(F.sha2(text, 256)).alias("digest"))


#: The order of a conversation's rows; rows alike in all of these are alike.
ORDER = ("key", "turn", "role", "digest")


def lettered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """ORDER columns, times, letters and the counts of faults of each kind of row of a conversation; texts are left behind.

    Equal rows of a turn are counted before they meet. Of those with equal role and text in
    several turns the first by turn is no duplicate; which that is, rows of a message that comes
    often look up without a shuffle.
    """
    seen = F.trim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    cut = ~F.right(seen, F.lit(1)).isin(".", "!", "?")
    slim = rows.select(*ORDER, "times", (seen == "").alias("is_blank"), cut.alias("is_cut"))
    slim = scratch.write(slim.groupBy(*ORDER, "is_blank", "is_cut").agg(F.sum("times").alias("times")), "counted")
    message = ["key", "role", "digest"]
    again = slim.groupBy(*message).agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("unknown")).filter("turns > 1")
    known = lookup(slim, scratch.sized(again, "again", "turns"), message, "turns", "left")
    first = F.col("turns").isNull() | F.when(F.col("unknown"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first"))
    initial = F.substring("role", 1, 1)
    at = F.when(initial.isin("s", "u", "a"), F.instr(F.lit(SOUND), initial)).otherwise(len(SOUND)).cast("int")
    letter = lambda listed: F.substring(F.lit(listed), at, F.lit(1))
    n, blank, sound = F.col("times"), F.col("is_blank"), ~F.col("is_blank") & first
    own = F.when(~sound, "").when(F.col("is_cut"), letter(CUT)).otherwise(letter(SOUND))
    return known.select(
        *ORDER, F.concat(own, F.repeat(letter(GONE), (n - sound.cast("long")).cast("int"))).alias("letters"),
        F.when(blank, n).otherwise(0).alias("blank"), F.when(blank, 0).otherwise(n - sound.cast("long")).alias("duplicate"), (sound & F.col("is_cut")).cast("long").alias("truncated"),
    )


def segmented(rows: DataFrame) -> DataFrame:
    """key, part, seg and sig, the letters of segments in order; illegal, neighbours within a part that break the order of roles; head and tail, its outer roles.

    Rows are dealt out by their order, so a long conversation is in several parts.
    """
    legal = ("su", "ua", "au")
    role = str.maketrans(CUT + GONE, SOUND * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, seg, held, tail = TaskContext.get().partitionId(), None, 0, "", ""
        out: list[tuple] = []

        def cut(sig: str) -> None:
            nonlocal seg, tail
            roles = sig.translate(role)
            line = tail + roles
            out.append((key, part, seg, sig, sum(line[i : i + 2] not in legal for i in range(len(line) - 1)), roles[0], roles[-1]))
            seg, tail = seg + 1, roles[-1]

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "part", "seg", "sig", "illegal", "head", "tail"])
            out.clear()
            return batch

        for b in batches:
            for name, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != key:
                    if held:
                        cut(held)
                    key, seg, held, tail = name, 0, "", ""
                held += letters
                while len(held) > SEGMENT:
                    cut(held[:SEGMENT])
                    held = held[SEGMENT:]
                    if len(out) >= BATCH_ROWS:
                        yield flush()
            if len(out) >= BATCH_ROWS:
                yield flush()
        if held:
            cut(held)
        if out:
            yield flush()

    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("key", "letters")
    return ordered.mapInArrow(run, "key string, part int, seg int, sig string, illegal long, head string, tail string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def hashed(convs: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """convs with repaired_sha256: its audit carried out on its rows, which follow it in order; one row is held at a time."""
    listed = convs.select("key", F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("times"), F.lit(None).cast("binary").alias("digest"), F.struct("conv_id", *COUNTS).alias("found"))
    texts = rows.select("key", F.lit(1).alias("side"), F.col("turn").cast("long").alias("turn"), "role", "text", "times", "digest", F.lit(None).cast(listed.schema["found"].dataType).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, audit, at, state, digest, first = None, "", 0, START, None, True
        out: list[tuple] = []

        def put(line: str) -> None:
            nonlocal first
            digest.update(line.encode() if first else b"\n" + line.encode())
            first = False

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == INSERTED:
                put(NEXT[state][0] + ":")
                at, state = at + 1, NEXT[state][1]

        def close() -> None:
            if found is not None:
                insert()
                if at != len(audit) or state not in ENDS:
                    raise ValueError("the edits are not those of the conversation")
                out.append((*found.values(), audit, digest.hexdigest()))

        def flush(schema: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [schema.field(i).type for i in range(schema.num_fields)] + [pa.string()] * 2
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
            out.clear()
            return batch

        for b in sliced(batches):
            shape = b.schema.field(5).type
            for side, role, text, times, more in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4, 5)), strict=True):
                if side == 0:
                    close()
                    found, audit, at, state, digest, first = more, text, 0, START, hashlib.sha256(), True
                    continue
                for _ in range(times):
                    insert()
                    edit = audit[at]
                    at += 1
                    if edit == KEPT:
                        put(f"{role}:{text}")
                        state = STEP[state][role[0]]
                    elif edit == RENAMED:
                        put(f"{NEXT[state][0]}:{text}")
                        state = NEXT[state][1]
            if out:
                yield flush(shape)
        close()
        if out:
            yield flush(shape)

    both = listed.unionByName(texts).repartition("key").sortWithinPartitions("key", "side", "turn", "role", "digest")
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return both.select("key", "side", "role", "text", "times", "found").mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation, after damage.

    A row's place is by turn (nulls first), then role and digest of its text; rows alike in all of these are
    alike. A null turn counts in no gap, a null role or text is one space, rows of a null conv_id are one
    conversation, and an empty role has no initial, so its row is renamed or deleted. Other columns are
    ignored; an empty table gives no rows. A conversation that damage leaves without rows has
    zeros, an empty audit and the hash of an empty string. Only the last step, the hash of a
    whole conversation in order, reads one in one task, row by row.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "repair")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = conversations.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    after_damage = damaged(rows)
    letters = scratch.write(lettered(after_damage, scratch), "letters")

    segments = scratch.write(segmented(letters), "segments")
    of_conversation = Window.partitionBy("key")
    before = F.lag("tail").over(of_conversation.orderBy("part", "seg"))
    broken = ((F.col("seg") == 0) & before.isNotNull() & ~F.concat(before, "head").isin("su", "ua", "au")).cast("long")
    segments = segments.select("key", "part", "seg", "sig", (F.col("illegal") + F.coalesce(broken, F.lit(0))).alias("illegal"), F.count("*").over(of_conversation).alias("parts"))
    segments = scratch.write(segments, "placed")
    different = segments.groupBy("sig").agg(F.count("*").alias("uses"))
    answers = scratch.write(solved(scratch.write(different, "different")).join(scratch.table("different"), "sig"), "answers")
    whole = lookup(segments.filter("parts = 1").select("key", "sig"), answers.select("sig", "cost", F.col("edits").alias("audit"), "uses"), "sig", "uses").select("key", "cost", "audit")
    parts = lookup(segments.filter("parts > 1").select("key", "part", "seg", "sig"), answers.select("sig", "costs", "ranks", "uses"), "sig", "uses")
    picked = lookup(chained(parts), answers.select("sig", "ways", "uses"), "sig", "uses")
    joined = picked.groupBy("key", "cost").agg(F.array_sort(F.collect_list(F.struct("part", "seg", F.get("ways", F.col("pick")).alias("way"), "close"))).alias("all"))
    joined = joined.select("key", "cost", F.concat(F.array_join(F.col("all.way"), ""), F.element_at("all", -1)["close"]).alias("audit"))

    turns = letters.groupBy("key", "turn").agg(*[F.sum(c).alias(c) for c in COUNTS[1:4]])
    stats = turns.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in COUNTS[1:4]])
    stats = stats.join(segments.groupBy("key").agg(F.sum("illegal").alias("illegal")), "key").join(whole.unionByName(joined.select("key", "cost", "audit")), "key")
    convs = rows.groupBy("key").agg(F.first("conv_id").alias("conv_id")).join(stats, "key", "left")
    convs = scratch.write(convs.select("key", "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit")), "convs")
    scratch.keep("convs")
    return hashed(convs, after_damage, kind)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
