"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_phrase_collocations
from .decontamination import op1_benchmark_decontamination
from .fingerprints import op6_document_fingerprints
from .html_text import op9_html_extraction
from .link_graph import OP12_SQL, op12_url_filters
from .minhash_dedup import OP2_SQL, op2_minhash_near_dedup
from .packing import op5_best_fit_packing
from .paragraph_dedup import op7_substring_dedup
from .pitman_yor import op4_lm_scoring
from .prefix_trie import OP13_SQL, op13_conversation_prefix_trie
from .quality import op3_quality_classifier
from .secret_scan import op8_secret_scans
from .toxicity import op10_toxicity

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_url_filters": op12_url_filters,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}
ORACLES = {"op2_minhash_near_dedup": OP2_SQL, "op11_phrase_collocations": OP11_SQL, "op12_url_filters": OP12_SQL, "op13_conversation_prefix_trie": OP13_SQL}
