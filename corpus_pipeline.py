"""The corpus pipeline: documents in, token ids out, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm.byte_bpe import encode
from pairforge.llm.common import Scratch, located, own_columns, quoted, sized
from pairforge.llm.line_dedup import line_dedup
from pairforge.llm.mixing import mixed
from pairforge.llm.ngram_join import join_rows
from pairforge.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so does a document that had words and has none left.

    n_chars, where there is such a column, is the length of the text that stays.
    """
    out = line_dedup(docs.select(F.struct(*map(quoted, docs.columns)).alias("own"), "doc_id", "text"))
    emptied = (F.col("gone_lines") > 0) & ~F.coalesce(F.col("clean_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    changed = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("gone_lines") > 0, F.length("clean_text").cast(kind)).otherwise(F.col("own.n_chars"))
    own = [changed[c].alias(c) if c in changed else F.col("own").getField(c).alias(c) for c in docs.columns]
    return out.filter(~emptied).select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links connect, that with the least doc_id stays; the others go, each by where it is stored.

    Rows link from a Jaccard similarity of 0.8 of their sets of five-word shingles. Null ids come
    last, and of rows that repeat an id the one stored first comes first; so a copy without an id
    goes like any other. Rows without a word link with nothing and stay.
    """
    scratch = Scratch(spark, "near")
    rows = located(docs, scratch)
    slim = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "row_file", "row_at")
    found = join_rows(slim, scratch, width=5, percent=80)
    dropped = scratch.write(found.filter("not stays").select("row_file", "row_at"), "dropped")
    scratch.keep("dropped", *[n for n in scratch.names if n.startswith("rows-")])
    return rows.join(sized(dropped), ["row_file", "row_at"], "left_anti").select(*own_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the digests, and the token ids (little-endian unsigned 32-bit integers)."""
    import public_tokenizers as tokenizers

    keep = [c for c in ("doc_id", "source") if c in docs.columns]
    return encode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, ids=True, keep=keep, lean=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL can express neither zstandard ratios nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
