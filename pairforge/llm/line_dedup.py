"""Line deduplication by a suffix array over line ids, in DataFrame operations only.

Lines without a word are left out; the others form one sequence per document, cut at lines that
occur once. Distributed prefix doubling ranks the suffixes of these pieces by their first 1, 2,
4, ... lines, to their ends: a suffix's next rank is its place among the pairs (own rank, rank
of the suffix 2^k lines on). Equal suffixes end up with one rank, a class; classes in the order
of their ranks are the suffix array. A rank that first appears in the round of 2^k lines begins
a class whose common prefix with the class before is of 2^k to 2^(k+1) - 1 lines; the exact
length is found by comparing lines there, once for each stretch of neighbours that run side by
side through the same two documents.

Classes next to each other whose common prefixes have at least m lines form an interval of the
array: its suffixes share a run of m lines. Runs of at least ``min_words`` words count. All but
the earliest suffix of an interval begin later copies. For each suffix, the intervals looked at
are that of its least run of min_words words and those of the longer runs that no later suffix
has whole; together these cover exactly the lines of all maximal repeated runs that qualify, less
the earliest copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.llm.common import BROADCAST_ROWS, Scratch, located, lookup, own_columns

#: A repeated run of lines is removed if it has at least so many words.
MIN_WORDS = 50
#: The suffixes of one rank are dealt into CELLS cells by the rank they are compared by next.
CELLS = 64
#: The suffix array is cut into PARTS parts for windows over all of it.
PARTS = 1024

#: The key of a document, and of a line.
DOC = ("row_file", "row_at")


def plain_lines(text: Column) -> Column:
    """The lines of a text, their white space made single and trimmed; one pass over the text."""
    odd = r"[\x09\x0B-\x0D]|\x20\x20"
    single = F.when(F.rlike(text, F.lit(odd)), F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    return F.transform(F.split(single, "\n", -1), lambda x: F.trim(x))


def _line(plain: Column, number: Column) -> Column:
    """A line's number, words and 128-bit id: two hashes, of which neither follows from the other."""
    words = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)
    return F.struct(number.alias("line"), words.cast("long").alias("words"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"))


def line_sequence(rows: DataFrame) -> DataFrame:
    """One row for each line with a word: its document, place among them, number, words and id."""
    split = F.transform(plain_lines(F.col("text")), _line)
    return rows.filter("text is not null").select("row_file", "row_at", "doc_id", F.posexplode(F.filter(split, lambda x: x["words"] > 0)).alias("at", "x")).select("row_file", "row_at", "doc_id", F.col("at").cast("long").alias("at"), "x.*")


def _line_ranks(sequence: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(h1, h2, n, rank) of the ids on two lines or more, by id; and how many such lines there are. n counts an id's lines."""
    shared = scratch.write(sequence.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    # Bands of ids are summed up and ordered, at most 2^16 rows; ids are sorted within their band.
    banded = shared.withColumn("band", F.shiftright("h1", 48))
    sums = banded.groupBy("band").agg(F.sum("n").alias("s"))
    upto = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sums.select("band", F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before")))
    within = Window.partitionBy("band").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    ids = scratch.sized(banded.join(starts, "band").select("h1", "h2", "n", rank.alias("rank")), "ids", "n")
    return ids, scratch.seen("ids")["total"] or 0


def _refine(pairs: DataFrame, span: int) -> DataFrame:
    """(a, b, n, rank) of each pair of ranks; n counts the suffixes that have it.

    a is the number of suffixes before those of rank a; so the next rank is a plus the number
    of suffixes of rank a whose b is smaller. These are summed up by cells of b first, so that
    a rank that very many suffixes share is sorted in CELLS places.
    """
    width = max(1, -(-span // CELLS))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("cell", F.expr(f"b div {width}L"))
    cells = counted.groupBy("a", "cell").agg(F.sum("n").alias("s"))
    # Truncation puts b = -1 into the cell of 0, and within it first.
    before = Window.partitionBy("a").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("a", "cell", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("a", "cell").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("a") + F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return counted.join(cells, ["a", "cell"]).select("a", "b", "n", rank.alias("rank"))


def suffix_array(lines: DataFrame, span: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """lines with their final ranks, and (rank, step) of the ranks that begin a class within a first line's.

    ``lines`` has row_file, row_at, at, left (the lines from here to the end of the piece) and
    rank, by the first line alone and below ``span``. A final rank is the number of smaller
    suffixes. A class and the one before it share at least ``step`` lines and fewer than twice as
    many. A document whose suffixes are all ranked leaves the rounds, so their number follows the
    longest run that two places share, and what they cost follows how many share so much.
    """
    by_doc = Window.partitionBy(*DOC)
    now, found, begun, step = lines.withColumn("open", F.lit(True)), None, None, 1
    while True:
        ahead = F.first("rank").over(by_doc.orderBy("at").rangeBetween(step, step))
        # A suffix that ends here is less than all that go on.
        paired = now.withColumn("b", F.when(F.col("left") <= step, F.lit(-1).cast("long")).otherwise(ahead)).withColumn("going", F.max("open").over(by_doc))
        paired = scratch.write(paired, f"pairs-{step}", going=F.count_if("going"))
        done = paired.filter("not going").drop("b", "going", "open")
        found = done if found is None else found.unionByName(done)
        going = paired.filter("going").drop("going")
        if not scratch.seen(f"pairs-{step}")["going"]:
            return found, begun
        moving = going.filter("open").withColumnRenamed("rank", "a")
        names = scratch.sized(_refine(moving.select("a", "b"), span), f"names-{step}", "n")
        made = names.filter("rank <> a").select("rank", F.lit(step).cast("long").alias("step"))
        begun = made if begun is None else begun.unionByName(made)
        ranked = lookup(moving, names, ["a", "b"], "n").withColumn("open", (F.col("b") >= 0) & (F.col("n") > 1)).drop("a", "b", "n")
        now = ranked.unionByName(going.filter("not open").drop("b"))
        step *= 2


def classes_of(suffixes: DataFrame) -> DataFrame:
    """One row for each rank: n suffixes, the earliest of them, and what all have alike: left, lo and hi."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_at", "at")
    return suffixes.groupBy("rank").agg(F.count("*").alias("n"), F.min(place).alias("place"), *[F.min(c).alias(c) for c in ("left", "lo", "hi")])


def common_prefixes(classes: DataFrame, begun: DataFrame, lines: DataFrame, span: int, scratch: Scratch, all_of_them: bool = False) -> DataFrame:
    """classes with lcp, the lines that each shares with the class before it in the suffix array.

    Unless ``all_of_them``, lcp is the lower bound ``step`` where that is enough to tell it from
    every length between lo and hi.
    """
    width = max(1, -(-span // PARTS))
    parted = classes.withColumn("part", F.expr(f"rank div {width}L"))
    own = F.struct("rank", "left", "place")
    ends = parted.groupBy("part").agg(F.max(own).alias("end"))  # at most PARTS + 1 rows
    ends = ends.select("part", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("carried"))
    linked = parted.join(F.broadcast(ends), "part").withColumn("prev", F.coalesce(F.lag(own).over(Window.partitionBy("part").orderBy("rank")), "carried"))
    linked = scratch.write(linked.join(begun, "rank", "left").drop("carried", "part"), "linked")
    near = linked.filter("step is not null").select("rank", "step", "left", "lo", "hi", *[F.col(f"place.{c}").alias(c) for c in (*DOC, "at")], F.col("prev.left").alias("left2"), *[F.col(f"prev.place.{c}").alias(f"{c}2") for c in (*DOC, "at")])
    if not all_of_them:
        near = near.filter("2 * step > lo and step < hi")
    # Neighbours that run side by side: only the first of each stretch is compared.
    both = ["row_file", "row_at", "row_file2", "row_at2"]
    side = near.withColumn("diagonal", F.col("at") - F.col("at2"))
    stretch = F.col("at") - F.row_number().over(Window.partitionBy(*both, "diagonal").orderBy("at"))
    side = side.withColumn("stretch", stretch)
    head = Window.partitionBy(*both, "diagonal", "stretch").orderBy("at")
    side = scratch.write(side.withColumn("head", F.first("at").over(head)).withColumn("head_rank", F.first("rank").over(head)), "side")
    heads = side.filter("at = head").withColumn("most", F.least("left", "left2"))
    steps = heads.filter("most > step").select("rank", *both, "at", "at2", F.explode(F.sequence("step", F.least(F.col("most"), 2 * F.col("step")) - 1)).alias("t"))
    ids = lines.select(*DOC, "at", F.col("line_rank").alias("id"))
    steps = steps.withColumn("at", F.col("at") + F.col("t")).withColumn("at2", F.col("at2") + F.col("t")).join(ids, [*DOC, "at"])
    steps = steps.join(ids.withColumnsRenamed({"row_file": "row_file2", "row_at": "row_at2", "at": "at2", "id": "id2"}), ["row_file2", "row_at2", "at2"])
    parting = steps.filter("id <> id2").groupBy("rank").agg(F.min("t").alias("t"))
    lengths = heads.select("rank", "most").join(parting, "rank", "left").select(F.col("rank").alias("head_rank"), F.coalesce("t", "most").alias("of_head"))
    exact = side.join(lengths, "head_rank").select("rank", (F.col("of_head") - (F.col("at") - F.col("head"))).alias("exact"))
    return linked.join(exact, "rank", "left").select("rank", "n", "place", "left", "lo", "hi", F.coalesce("exact", "step", F.lit(0).cast("long")).alias("lcp"))


def repeated_runs(classes: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """(rank, n, runs) of the classes in intervals of two suffixes or more: runs has m lines and the earliest place of each."""
    width = max(1, -(-span // PARTS))
    wanted = classes.filter("lo is not null").withColumn("part", F.expr(f"rank div {width}L"))
    rows = wanted.select("rank", "n", "place", "part", "lcp", F.explode(F.sequence("lo", "hi")).alias("m"))
    # An interval is named by m and the rank of its first class.
    begins = F.when(F.col("lcp") < F.col("m"), F.col("rank"))
    ends = rows.groupBy("m", "part").agg(F.max(begins).alias("end"))
    ends = ends.select("m", "part", F.max("end").over(Window.partitionBy("m").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    begun = F.max(begins).over(Window.partitionBy("m", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    named = scratch.write(rows.join(ends, ["m", "part"]).select("rank", "n", "place", "m", F.coalesce(begun, "carried").alias("first")), "named")
    intervals = named.groupBy("m", "first").agg(F.min("place").alias("earliest"), F.sum("n").alias("suffixes"), F.count("*").alias("classes"))
    intervals = scratch.sized(intervals.filter("suffixes > 1"), "intervals", "classes")
    runs = lookup(named, intervals, ["m", "first"], "classes")
    return runs.groupBy("rank").agg(F.min("n").alias("n"), F.collect_list(F.struct("m", "earliest")).alias("runs"))


def placed_lines(rows: DataFrame, scratch: Scratch, min_words: int) -> tuple[DataFrame, int]:
    """The lines with a word, by document, and the number of those that occur twice or more.

    line_rank is null for a line that occurs once. left counts the lines up to the next such
    line; lo to hi are the lengths of the runs that are looked at from here, null if there is none.
    """
    sequence = scratch.write(line_sequence(rows), "sequence")
    ids, span = _line_ranks(sequence, scratch)
    by_doc, doc = Window.partitionBy(*DOC).orderBy("at"), Window.partitionBy(*DOC)
    placed = lookup(sequence, ids, ["h1", "h2"], "n", "left").select(
        *DOC, "doc_id", "at", "line", "words", F.col("rank").alias("line_rank"), F.lead("line").over(by_doc).alias("next_line"),
        (F.sum("words").over(by_doc) - F.col("words")).alias("before"),
        F.sum(F.when(F.col("rank").isNull(), 1).otherwise(0)).over(by_doc).alias("piece"),
        F.max("at").over(doc).alias("last"), F.sum("words").over(doc).alias("total"),
    )
    # before rises with each line, so a range of it finds where a run of min_words ends; the
    # frame starts at its order's end and is summed up as it grows.
    far = F.min("at").over(doc.orderBy(-F.col("before")).rangeBetween(Window.unboundedPreceding, -min_words))
    placed = placed.withColumn("reach", F.coalesce(far - 1, F.when(F.col("total") - F.col("before") >= min_words, F.col("last"))))
    placed = placed.withColumn("farthest", F.coalesce(F.lead("reach").over(by_doc) - 1, "last")).withColumn("end", F.max("at").over(Window.partitionBy(*DOC, "piece")))
    lo = F.when((F.col("reach") <= F.col("end")) & F.col("line_rank").isNotNull(), F.col("reach") - F.col("at") + 1)
    hi = F.greatest(lo, F.least("farthest", "end") - F.col("at") + 1)
    lines = placed.select(*DOC, "doc_id", "at", "line", "next_line", "words", "line_rank", (F.col("end") - F.col("at") + 1).alias("left"), lo.alias("lo"), F.when(lo.isNotNull(), hi).alias("hi"))
    return scratch.write(lines, "lines"), span


def later_copies(rows: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(row_file, row_at, gone, gone_lines, gone_words): what is removed of documents that lose lines.

    ``gone`` lists stretches (lo, hi) of line numbers, hi not included.
    """
    lines, span = placed_lines(rows, scratch, min_words)
    shared = lines.filter("line_rank is not null").select(*DOC, "doc_id", "at", "left", "lo", "hi", F.col("line_rank").alias("rank"))
    suffixes, begun = suffix_array(shared, span, scratch)
    if begun is None:
        begun = rows.sparkSession.createDataFrame([], "rank long, step long")
    suffixes = scratch.write(suffixes, "suffixes")
    classes = scratch.write(classes_of(suffixes), "classes")
    runs = scratch.sized(repeated_runs(common_prefixes(classes, begun, lines, span, scratch), span, scratch), "runs", "n")

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_file", "row_at", "at")
    begins = lookup(suffixes.filter("lo is not null").select("rank", place.alias("place")), runs, "rank", "n")
    longest = F.array_max(F.transform(F.filter("runs", lambda r: r["earliest"] < F.col("place")), lambda r: r["m"]))
    copies = begins.select("place.*", longest.alias("m")).filter("m is not null")

    by_doc = Window.partitionBy(*DOC).orderBy("at")
    covered = copies.select(*DOC, F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")).distinct()
    covered = covered.join(lines.select(*DOC, "at", "line", "next_line", "words"), [*DOC, "at"])
    stretch = covered.withColumn("stretch", F.col("at") - F.row_number().over(by_doc))
    # A line without a word goes with the line above it that has one.
    hi = F.max(F.coalesce("next_line", F.lit(2**31 - 1)))
    stretch = stretch.groupBy(*DOC, "stretch").agg(F.min("line").alias("lo"), hi.alias("hi"), F.count("*").alias("n"), F.sum("words").alias("w"))
    return stretch.groupBy(*DOC).agg(F.collect_list(F.struct("lo", "hi")).alias("gone"), F.sum("n").alias("gone_lines"), F.sum("w").alias("gone_words"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with their columns, plus clean_text, gone_lines and gone_words.

    A line is removed if it lies in a run of whole lines of at least ``min_words`` words that
    occurs earlier: in a row of smaller doc_id (null ids last, then by storage), or higher up in
    the same text. Lines are equal if their words and the order of these are. A line without a
    word goes with the line above it that has one. So each line survives where it comes first.
    A null text stays null; repeated rows are copies like others. Columns named like a result
    give way to it. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("clean_text", "gone_lines", "gone_words")])
    rows = located(docs, scratch)
    slim = rows.select(*DOC, F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    gone = scratch.write(later_copies(slim, scratch, min_words), "gone", rows=F.count(F.lit(1)), stretches=F.sum(F.size("gone")))
    scratch.keep("gone", *[n for n in scratch.names if n.startswith("rows-")])
    sums = scratch.seen("gone")
    few = sums["rows"] <= BROADCAST_ROWS and (sums["stretches"] or 0) <= 4 * BROADCAST_ROWS
    joined = rows.join(F.broadcast(gone) if few else gone, list(DOC), "left")
    own = F.col("row.text").cast("string")
    kept = F.filter(F.split(own, "\n", -1), lambda x, i: ~F.exists("gone", lambda g: (i >= g["lo"]) & (i < g["hi"])))
    text = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(kept, "\n"))
    zero = F.lit(0).cast("long")
    made = F.struct(text.alias("clean_text"), F.coalesce("gone_lines", zero).alias("gone_lines"), F.coalesce("gone_words", zero).alias("gone_words"))
    return joined.select("row", made.alias("made")).select(*own_columns(docs), "made.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.coalesce("clean_text", F.lit(""))
    return out.select("doc_id", "gone_lines", "gone_words", F.length(kept).cast("long").alias("clean_chars"), F.sha2(F.encode(kept, "UTF-8"), 256).alias("clean_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line
  FROM documents),
plain AS (
  SELECT *, trim(regexp_replace(body, '[ 	-
]+', ' ', 'g'), ' ') AS id, len(regexp_extract_all(body, '[^ 	-
]+')) AS words FROM split),
placed AS (
  SELECT *, count(*) FILTER (words > 0) OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM plain),
seq AS (SELECT * FROM placed WHERE words > 0),
matches AS (
  SELECT p.doc_id AS d, q.doc_id AS e, p.pos AS pos, p.pos - q.pos AS diagonal, p.words
  FROM seq p JOIN seq q ON p.id = q.id AND (p.doc_id > q.doc_id OR p.doc_id = q.doc_id AND p.pos > q.pos)),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY d, e, diagonal ORDER BY pos) AS island FROM matches),
runs AS (SELECT d, min(pos) AS lo, max(pos) AS hi FROM islands GROUP BY d, e, diagonal, island HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT d, unnest(range(lo, hi + 1)) AS pos FROM runs),
marked AS (SELECT p.*, g.pos IS NOT NULL AS off FROM placed p LEFT JOIN gone g ON p.doc_id = g.d AND p.pos = g.pos)
SELECT doc_id, (count(*) FILTER (off AND words > 0))::BIGINT AS gone_lines, coalesce(sum(words) FILTER (off), 0)::BIGINT AS gone_words,
       length(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT off), ''))::BIGINT AS clean_chars,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT off), '')) AS clean_sha256
FROM marked GROUP BY doc_id
"""
