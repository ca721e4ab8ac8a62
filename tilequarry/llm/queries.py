"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .html import op1_html_extraction
from .jaccard import op8_ngram_jaccard_join
from .leaks import op9_benchmark_decontamination
from .licenses import op3_license_scans
from .lines import op5_line_dedup
from .oracles import OP3, OP5, OP7, OP8
from .packing import op2_packing
from .quality import OP6_SQL, op6_quality_rules
from .secrets import op10_secret_scans
from .substrings import op7_substring_dedup
from .wavelet import op4_wavelet_shards

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_license_scans": op3_license_scans,
    "op4_wavelet_shards": op4_wavelet_shards,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scans": op10_secret_scans,
}
ORACLE_SQL: dict[str, str] = {
    "op3_license_scans": OP3,
    "op5_line_dedup": OP5,
    "op6_quality_rules": OP6_SQL,
    "op7_substring_dedup": OP7,
    "op8_ngram_jaccard_join": OP8,
}
