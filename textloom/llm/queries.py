"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from textloom.llm.bpe import op3_byte_bpe
from textloom.llm.decontaminate import op8_decontaminate
from textloom.llm.fingerprint import op4_fingerprints
from textloom.llm.html_extract import op9_html_extract
from textloom.llm.jaccard_join import op7_jaccard_join
from textloom.llm.language_id import op6_language_id
from textloom.llm.quality import op10_quality
from textloom.llm.substring_dedup import op1_substring_dedup
from textloom.llm.token_output import op5_token_output
from textloom.llm.url_filter import op2_url_filter
from textloom.llm.url_filter import oracle as url_filter_sql

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_url_filter,
        op3_byte_bpe,
        op4_fingerprints,
        op5_token_output,
        op6_language_id,
        op7_jaccard_join,
        op8_decontaminate,
        op9_html_extract,
        op10_quality,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_url_filter": url_filter_sql()}
