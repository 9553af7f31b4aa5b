"""URL filters: host and path rules, and a character language-model ratio for the rest.

DataFrame operations only. Two smoothed variable-order Markov models, of accepted and of
rejected URLs, give each URL a log-likelihood difference per character, held against a
calibrated threshold.

Contexts are of up to ORDER symbols: those that precede at least 1/SHARE of all symbols. Each
prefix and each suffix of such a context is one, too, so the longest context of a place follows
from that of the place before and its symbol: contexts are the states of an automaton, and a URL
is scored in one pass over its symbols, whatever its length.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import Scratch

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Symbols of the models: letters in lower case, one for all digits, and these; 0 is anything else.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_:?=&#%~"
#: The last symbol stands before the first character.
PAD = len(ALPHABET) + 1
SIZE = PAD + 1
#: The longest context, and the share of all symbols that a context must precede. So there are at
#: most 1 + ORDER * SHARE contexts, however many URLs they are counted over.
ORDER, SHARE = 5, 512
#: Of labelled URLs, one fold in FOLDS is held out to calibrate the threshold.
FOLDS = 5
#: Bins of the score that the threshold is chosen from.
BINS, SPAN = 2000, 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as a struct (verdict, rule); null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if cases is None else cases


def symbols(host: Column, path: Column) -> Column:
    """The host and path as an array of symbol numbers."""
    plain = F.translate(F.lower(F.concat(host, path)), "123456789", "000000000")
    return F.when(plain == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def grams(codes: Column) -> Column:
    """The number of each symbol with the ORDER symbols before it, the last symbol lowest. ``codes`` is a stored column."""

    def at(i: Column) -> Column:
        terms = [F.coalesce(F.get(codes, i - j), F.lit(PAD)).cast("long") * SIZE**j for j in range(ORDER + 1)]
        return sum(terms[1:], terms[0])

    return F.when(F.size(codes) > 0, F.transform(F.sequence(F.lit(0), F.size(codes) - 1), at)).otherwise(F.array().cast("array<bigint>"))


def contexts(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, context, accepted, symbol, n): how often symbols follow each context of k symbols, of all labelled URLs."""
    counted = labelled.select("accepted", F.explode(grams(F.col("codes"))).alias("g")).groupBy("accepted", "g").agg(F.count("*").alias("n"))
    counted = scratch.write(counted, "grams")
    total = counted.agg(F.sum("n")).first()[0]
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(SIZE**k).alias("most")) for k in range(ORDER + 1)])).alias("x")
    cut = counted.select("accepted", "n", "g", sizes).select("accepted", "n", "x.k", F.expr(f"(g div {SIZE}) % x.most").alias("context"), (F.col("g") % SIZE).cast("int").alias("symbol"))
    follow = scratch.write(cut.groupBy("k", "context", "accepted", "symbol").agg(F.sum("n").alias("n")), "follow")
    kept = follow.groupBy("k", "context").agg(F.sum("n").alias("seen")).filter(F.col("seen") * SHARE >= total).select("k", "context")
    return follow.join(F.broadcast(kept), ["k", "context"])  # at most 1 + ORDER * SHARE contexts


def automaton(counts: list[tuple[int, int, bool, int, int]]) -> tuple[int, list[int], list[float]]:
    """The state before a URL, and for each state and symbol the next state and log P(accepted) / P(rejected).

    ``counts`` has (k, context, accepted, symbol, n). Witten-Bell smoothing: a context's share for
    its own counts is n / (n + distinct symbols), and what is left goes to the context shorter by
    one symbol, down to a uniform distribution. So the order used varies with what was seen.
    """
    seen: dict[tuple[int, int], dict[bool, dict[int, int]]] = {(0, 0): {True: {}, False: {}}}
    for k, context, accepted, symbol, n in counts:
        seen.setdefault((k, context), {True: {}, False: {}})[accepted][symbol] = n
    states = sorted(seen)
    number = {s: i for i, s in enumerate(states)}
    chance: dict[tuple[int, int], dict[bool, list[float]]] = {}
    follows, ratios = [], []
    for k, context in states:  # shorter ones first
        shorter = chance[k - 1, context % SIZE ** (k - 1)] if k else None
        own = chance[k, context] = {}
        for side, found in seen[k, context].items():
            below = shorter[side] if shorter else [1.0 / PAD] * PAD
            whole, kinds = sum(found.values()), len(found)
            own[side] = [(found.get(c, 0) + kinds * p) / (whole + kinds) for c, p in enumerate(below)] if whole else below
        for c in range(PAD):
            longest = context * SIZE + c
            follows.append(next(number[j, longest % SIZE**j] for j in range(min(k + 1, ORDER), -1, -1) if (j, longest % SIZE**j) in number))
            ratios.append(log(own[True][c]) - log(own[False][c]))
    before = [(k, sum(PAD * SIZE**j for j in range(k))) for k in range(ORDER, -1, -1)]
    return next(number[s] for s in before if s in number), follows, ratios


def threshold(scored: DataFrame) -> float:
    """The score above which accepted and below which rejected URLs are told best (balanced accuracy)."""
    bin_ = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    counts = {(r.accepted, r.bin): r.n for r in scored.groupBy("accepted", bin_.alias("bin")).agg(F.count("*").alias("n")).collect()}  # at most 2 * BINS rows
    total = {side: sum(n for (a, _), n in counts.items() if a == side) for side in (True, False)}
    if not all(total.values()):
        return 0.0
    best, below = (-1.0, 0), {True: 0, False: 0}
    for i in range(BINS + 1):
        right = (total[True] - below[True]) / total[True] + below[False] / total[False]
        # Among equals, the one nearest to 0.
        best = max(best, (round(right, 9), -abs(i - BINS // 2), i))
        for side in below:
            below[side] += counts.get((side, i), 0)
    return best[-1] * (2 * SPAN / BINS) - SPAN


def score(codes: Column, start: int, follows: list[int], ratios: list[float]) -> Column:
    """The mean log-likelihood difference of the symbols. The tables go into the plan as two constants."""
    go = F.split(F.lit(" ".join(map(str, follows))), " ").cast("array<int>")
    gain = F.split(F.lit(" ".join(f"{x:.5f}" for x in ratios)), " ").cast("array<double>")
    begin = F.struct(F.lit(start).alias("state"), F.lit(0.0).alias("total"))

    def step(x: Column, c: Column) -> Column:
        at = x["state"] * PAD + c
        return F.struct(F.get(go, at).alias("state"), (x["total"] + F.get(gain, at)).alias("total"))

    total = F.aggregate(codes, begin, step, lambda x: x["total"])
    return F.when(F.size(codes) > 0, total / F.size(codes)).otherwise(0.0)


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row.

    The longest rule that fits decides. For the rest, the models do: they are trained on all
    URLs that rules decide, less a fold by hash that the threshold is calibrated on; a URL is
    blocked if its score lies below the threshold. A null url, or one without ``://``, has an
    empty host and path and a score of 0. If no rule accepts or none rejects anything there is
    nothing to compare, and every URL without a rule is allowed. Repeated rows are judged each;
    null ids stay; other columns are ignored; an empty table gives no rows.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("fits", matched_rule(F.col("host"), F.col("path"), rules))
    # Symbols are stored before they are used place by place, or each use would make them anew.
    coded = scratch.write(parts.select("page_id", "host", "path", "fits", symbols(F.col("host"), F.col("path")).alias("codes")), "coded")

    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS))
    labelled = coded.filter("fits is not null").select("codes", (F.col("fits.verdict") == "allow").alias("accepted"), fold.alias("fold"))
    sides = {r.accepted for r in labelled.filter("fold > 0 and size(codes) > 0").select("accepted").distinct().collect()}
    if len(sides) < 2:
        found, least = F.lit(0.0), 0.0
    else:
        counts = [(r.k, r.context, r.accepted, r.symbol, r.n) for r in contexts(labelled.filter("fold > 0"), scratch).collect()]
        found = score(F.col("codes"), *automaton(counts))
        least = threshold(labelled.filter("fold = 0").select("accepted", found.alias("score")))
    scratch.keep("coded")
    judged = coded.withColumn("score", found)
    verdict = F.coalesce(F.col("fits.verdict"), F.when(F.col("score") < least, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
