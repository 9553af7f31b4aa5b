"""Language identification by fusing text, declared language, address suffix and host priors.

Each row gets log-likelihoods of its whole text under byte-trigram models, tempered, as
neighbouring trigrams are not independent. These give a posterior from the text alone. Summed
up by declared language, by address suffix and by host, such posteriors become the tables of
the other evidence: P(declared | language), P(suffix | language) and the host's prior, which is
smoothed towards its domain's, that towards its suffix's, and that towards all rows' prior. A
row's own share is taken out of its host's counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.common import Scratch, lookup, small_batches

#: Labelled texts per language that the models are trained on, about; chosen by a hash of the id.
SAMPLE = 2000
BUCKETS = 1 << 15
#: n trigrams speak with TEMPER * n ** POWER of their mean log-likelihood: the more text, the more it
#: says, but less than in proportion, as trigrams of one text are alike.
TEMPER, POWER = 0.8, 0.75
#: Cells of counts that a training task gathers before it passes them on.
GATHER = 1 << 22
#: Rows that a parent's prior counts for in a child's.
STRENGTH = 10.0

_NAME = re.compile(rb"/?\s*([A-Za-z!?][A-Za-z0-9]*)")
#: name = value of a tag; a name is tried only from its first character, so a tag is read in one pass.
_ATTRIBUTE = re.compile(rb"""(?<![\w:.-])([A-Za-z][\w:.-]*+)\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s"'>]++))""")
_CODE = re.compile(rb"\s*([A-Za-z]{2,3})(?![A-Za-z])")
#: What a meta tag's name, property or http-equiv is called if its content is a language.
_METAS = (b"language", b"content-language", b"dc.language", b"og:locale", b"inlanguage")


def _said(tag: bytes, name: bytes) -> str | None:
    """The language that an html or meta tag declares."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or b"" for m in reversed(list(_ATTRIBUTE.finditer(tag)))}
    if name == b"meta":
        named = {found.get(k, b"").lower().strip() for k in (b"name", b"property", b"http-equiv", b"itemprop")}
        values = [found.get(b"content", b"")] if named.intersection(_METAS) else []
    else:
        values = [found.get(b"lang", b""), found.get(b"xml:lang", b"")]
    return next((m[1].decode().lower() for v in values if (m := _CODE.match(v))), None)


def scan(html: bytes) -> tuple[bytes, str | None]:
    """The text between the tags, and the declared language: that of the html tag, else of a meta tag.

    One pass: each byte is looked at a fixed number of times. Comments, scripts and styles are
    left out, up to the end of the page where they do not end; a last < that no > follows is text.
    """
    low, parts, at, said = html.lower(), [], 0, {}
    while (start := html.find(b"<", at)) >= 0:
        parts.append(html[at:start])
        if html.startswith(b"<!--", start):
            end = html.find(b"-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        end = html.find(b">", start)
        if end < 0:
            at = start
            break
        at = end + 1
        head = _NAME.match(html, start + 1, end)
        name = head[1].lower() if head else b""
        if name in (b"html", b"meta") and name not in said and html[start + 1 : start + 2] != b"/" and (code := _said(html[start:end], name)):
            said[name] = code
        elif name in (b"script", b"style") and html[start + 1 : start + 2] != b"/":
            end = low.find(b"</" + name, at)
            at = len(html) if end < 0 else end
    parts.append(html[at:])
    return b" ".join(parts), said.get(b"html") or said.get(b"meta")


def visible(html: bytes) -> bytes:
    return scan(html)[0]


def declared(html: bytes) -> str | None:
    return scan(html)[1]


def buckets(text: bytes) -> np.ndarray:
    """The buckets of the text's byte trigrams; A-Z in lower case, digits and line ends as spaces."""
    b = np.frombuffer(text.lower().translate(_PLAIN), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(17)


_PLAIN = bytes(32 if c in b"0123456789\t\n\r\x0b\x0c" else c for c in range(256))


def train(labelled: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """All languages labelled, and (BUCKETS, languages) log-probabilities, from rows of doc_id, text and lang."""
    known = labelled.filter("lang is not null and text is not null")
    counts = known.groupBy("lang").count().collect()  # a row a language
    names = sorted(r["lang"] for r in counts)
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    rate = reduce(lambda c, r: c.when(F.col("lang") == r["lang"], min(1.0, per_language / r["count"])), counts, F.when(F.lit(False), 0.0)).otherwise(0.0)
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < rate
    number = {name: k for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            cells = [(k, np.flatnonzero(row)) for k, row in held.items()]
            k = np.concatenate([np.full(len(g), k, np.int32) for k, g in cells]) if cells else np.empty(0, np.int32)
            g = np.concatenate([g for _, g in cells]) if cells else np.empty(0, np.int64)
            n = np.concatenate([held[k][g] for k, g in cells]) if cells else np.empty(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(n, pa.int64())], ["k", "g", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = number[lang]
                if k not in held:
                    if len(held) * BUCKETS >= GATHER:
                        yield flush()
                    held[k] = np.zeros(BUCKETS, np.int64)
                held[k] += np.bincount(buckets(text), minlength=BUCKETS)
        yield flush()

    sample = known.filter(drawn).select(F.encode("text", "UTF-8").alias("text"), "lang")
    rows = sample.mapInArrow(count, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    table = np.full((BUCKETS, len(names)), 0.5)
    table[rows["g"].to_numpy(), rows["k"].to_numpy()] += rows["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def tempered(text: bytes, model: np.ndarray) -> np.ndarray:
    """The log-likelihood of a whole text by language, tempered. Buckets are counted first, so a long text takes no table."""
    at, n = np.unique(buckets(text), return_counts=True)
    if not len(at):
        return np.zeros(model.shape[1])
    return (n @ model[at].astype(np.float64)) / n.sum() * (TEMPER * n.sum() ** POWER)


def evidence(rows: DataFrame, table: np.ndarray, html: bool) -> DataFrame:
    """rows (id, host, body) with the declared language and the tempered log-likelihoods."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            said, found = [], []
            for body in b.column(2).to_pylist():
                text, code = scan(body or b"") if html else (body or b"", None)
                said.append(code)
                found.append(tempered(text, model).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(found, pa.list_(pa.float64()))], ["id", "host", "declared", "ll"])

    return rows.select("id", "host", F.col("body").cast("binary")).mapInArrow(run, "id long, host string, declared string, ll array<double>")


def host_of(url: Column) -> Column:
    """The host in lower case without port and user; null without one."""
    host = F.lower(F.regexp_extract(url, r"(?s)://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host == "", None).otherwise(host)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _sums(rows: DataFrame, key: list[str], n: int, size: str) -> DataFrame:
    """By key: how many rows, and the sum of their posteriors, as an array."""
    parts = [F.sum(F.col("q")[i]).alias(f"_{i}") for i in range(n)]
    found = rows.groupBy(*key).agg(F.sum("rows").alias(size), *parts)
    return found.select(*key, size, F.array(*[F.col(f"_{i}") for i in range(n)]).alias("q"))


def _smoothed(counts: Column, size: Column, parent: Column) -> Column:
    return F.zip_with(counts, parent, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))


def fuse(scored: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """scored with lang, confidence and text_lang. ``scored`` has id, host, declared and ll."""
    n = len(names)
    suffix = F.when(F.col("host").contains("."), F.element_at(F.split("host", r"\."), -1))
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(F.col("host"))
    rows = scored.withColumn("q", _softmax(F.col("ll"))).withColumn("rows", F.lit(1).cast("long"))
    rows = rows.withColumn("suffix", suffix).withColumn("domain", F.coalesce(domain, F.lit(""))).withColumn("host", F.coalesce("host", F.lit(""))).withColumn("_declared", F.col("declared"))
    rows = scratch.write(rows, "posteriors")

    whole = _sums(rows.withColumn("one", F.lit(1)), ["one"], n, "size").first()
    total = [(x + 1.0) / (whole["size"] + n) for x in whole["q"]]
    prior = F.array(*[F.lit(float(x)) for x in total])
    mass = F.array(*[F.lit(float(x)) for x in whole["q"]])

    # The host's prior, from the top down. Each table has a row for each host, domain or suffix.
    hosts = scratch.write(_sums(rows, ["host", "domain", "suffix"], n, "host_rows"), f"hosts-{n}")
    up = hosts.withColumnRenamed("host_rows", "rows")
    suffixes = _sums(up, ["suffix"], n, "size").select("suffix", _smoothed(F.col("q"), F.col("size"), prior).alias("suffix_prior"))
    domains = _sums(up, ["domain", "suffix"], n, "size").alias("d").join(suffixes.alias("s"), F.col("d.suffix").eqNullSafe(F.col("s.suffix")))
    domains = domains.select("domain", _smoothed(F.col("q"), F.col("size"), F.col("suffix_prior")).alias("domain_prior"))
    of_host = scratch.write(hosts.join(domains, "domain").select("host", "host_rows", F.col("q").alias("host_q"), "domain_prior"), f"host-priors-{n}")

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) by value."""
        table = _sums(rows.filter(F.col(column).isNotNull()), [column], n, f"{column}_rows")
        logs = F.zip_with("q", mass, lambda c, m: F.log((c + 0.1) / (m + 1.0)))
        return scratch.write(table.select(column, f"{column}_rows", logs.alias(f"{column}_log")), f"{column}-{n}")

    found = lookup(rows, of_host, "host", "host_rows")
    for column in ("declared", "suffix"):
        found = lookup(found, likelihood(column), column, f"{column}_rows", "left")
    others = F.zip_with("host_q", "q", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    host_log = F.transform(_smoothed(others, F.col("host_rows") - 1, F.col("domain_prior")), lambda p: F.log(p))
    none = F.array_repeat(F.lit(0.0), n)
    logs = [F.col("ll"), host_log, F.coalesce("declared_log", none), F.coalesce("suffix_log", none)]
    fused = _softmax(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), logs))
    best = F.array_max(F.transform(fused, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    text_best = F.array_max(F.transform("q", lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    spoken = F.array(*map(F.lit, names))
    out = found.withColumn("best", best).withColumn("text_best", text_best)
    return out.select("id", F.element_at(spoken, 1 - F.col("best.i")).alias("lang"), F.round("best.p", 6).alias("confidence"), F.element_at(spoken, 1 - F.col("text_best.i")).alias("text_lang"), F.col("_declared").alias("declared"))


def identify(rows: DataFrame, labelled: DataFrame, html: bool, per_language: int = SAMPLE) -> DataFrame:
    """id, lang, confidence, text_lang and declared of rows (id, host, body).

    ``labelled`` (doc_id, text, lang) trains the text models, on a sample of about
    ``per_language`` texts a language; all else is counted over all rows. A row without text,
    host or declaration lacks that evidence only: a null or empty body leaves the priors to
    decide; what a row says itself is taken out of its host's counts, not out of those of its
    domain, suffix and declaration. Labels are any strings. Ties go to the language first in the alphabet. Repeated rows are judged each and
    null ids stay. Without labels lang is null; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "languages")
    with small_batches(rows.sparkSession):
        names, table = train(labelled, per_language)
        scored = scratch.write(evidence(rows, table, html), "scored")
    if not names or not scored.limit(1).count():
        nothing = F.lit(None).cast("string")
        return scored.select("id", nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"), "declared")
    return fuse(scored, names, scratch)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by all evidence, and every document by its text and its source's prior."""
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    labelled = docs.select("doc_id", "text", "lang")
    of_pages = identify(pages.select(F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"), F.encode("html", "UTF-8").alias("body")), labelled, html=True)
    of_docs = identify(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.encode("text", "UTF-8").alias("body")), labelled, html=False)
    none = F.lit(None).cast("long")
    rest = ["lang", "confidence", "text_lang", "declared"]
    return of_pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), *rest).unionByName(of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), *rest))
