"""Queries of the training-data operators over the given tables, by name."""

from __future__ import annotations

from mercato.llm.byte_bpe import op9_byte_bpe
from mercato.llm.class_lm import op13_class_lm
from mercato.llm.embed_dedup import op6_embedding_dedup
from mercato.llm.hard_negatives import op12_hard_negatives
from mercato.llm.html_extract import op10_html_extract
from mercato.llm.language_id import op4_language_id
from mercato.llm.license_scan import op8_license_scan
from mercato.llm.ngram_join import op2_ngram_join
from mercato.llm.oracle import ORACLE
from mercato.llm.packing import op7_packing
from mercato.llm.ranked_search import op11_ranked_search
from mercato.llm.secret_scan import op1_secret_scan
from mercato.llm.token_counts import op3_token_counts
from mercato.llm.topk_search import op5_topk_search

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {f.__name__: f for f in (
    op1_secret_scan,
    op2_ngram_join,
    op3_token_counts,
    op4_language_id,
    op5_topk_search,
    op6_embedding_dedup,
    op7_packing,
    op8_license_scan,
    op9_byte_bpe,
    op10_html_extract,
    op11_ranked_search,
    op12_hard_negatives,
    op13_class_lm,
)}
