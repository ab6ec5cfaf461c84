"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op3_bpe_encoding
from .fingerprint import op5_document_fingerprints
from .flac import op4_media_columns
from .htmltext import op8_html_extraction
from .linededup import OP1_SQL, op1_line_dedup
from .lmscore import op2_lm_scoring
from .ngramjoin import op9_ngram_jaccard_join
from .packing import op6_best_fit_packing
from .quality import op10_quality_classifier
from .search import OP12_SQL, op12_ranked_search
from .simhash import op11_simhash
from .spelling import op13_spelling_variants
from .suffixdedup import op7_suffix_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op4_media_columns": op4_media_columns,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_simhash_near_dedup": op11_simhash,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op12_ranked_search": OP12_SQL}
