"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .jaccard import OP6_SQL, op6_jaccard_join
from .licenses import OP2_SQL, op2_license_scan
from .media import op8_media_columns
from .mixing import OP9_SQL, op9_mix_sources
from .packing import op10_best_fit_packing
from .quality import op4_quality_classifier
from .repeats import op1_suffix_dedup
from .secrets import op3_secret_scan
from .topk import OP7_SQL, op7_exact_topk
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_exact_topk": op7_exact_topk,
    "op8_media_columns": op8_media_columns,
    "op9_mix_sources": op9_mix_sources,
    "op10_best_fit_packing": op10_best_fit_packing,
}
SQL = {"op2_license_scan": OP2_SQL, "op5_url_filter": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_exact_topk": OP7_SQL, "op9_mix_sources": OP9_SQL}
