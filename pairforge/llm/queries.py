"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm.byte_bpe import op9_byte_bpe
from pairforge.llm.conversation_repair import op11_conversation_repair
from pairforge.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from pairforge.llm.language_id import op5_language_id
from pairforge.llm.line_dedup import OP2_SQL, op2_line_dedup
from pairforge.llm.mixing import OP10_SQL, op10_mix_sources
from pairforge.llm.ngram_join import OP1_SQL, op1_ngram_join
from pairforge.llm.quality_rules import op8_quality_rules
from pairforge.llm.secret_scan import op12_secret_scan
from pairforge.llm.token_align import op13_token_align
from pairforge.llm.token_counts import op6_token_counts
from pairforge.llm.url_filter import op7_url_filter
from pairforge.llm.warc_zip import OP3_SQL, op3_warc_zip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc_zip": op3_warc_zip,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_counts": op6_token_counts,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mix_sources": op10_mix_sources,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_token_align": op13_token_align,
}

SQL: dict[str, str] = {
    "op1_ngram_join": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_warc_zip": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op10_mix_sources": OP10_SQL,
}
