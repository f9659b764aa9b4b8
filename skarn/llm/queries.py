"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP6_SQL, op6_benchmark_decontamination
from .langid import op9_language_id
from .licenses import OP8_SQL, op8_license_scans
from .linededup import OP10_SQL, op10_line_dedup
from .neardup import OP3_SQL, op3_minhash_near_dedup
from .packing import op1_best_fit_packing
from .sharding import op4_sharding
from .topk import OP7_SQL, op7_exact_top_k
from .toxicity import op2_toxicity
from .urlfilter import OP5_SQL, op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_minhash_near_dedup,
        op4_sharding,
        op5_url_filters,
        op6_benchmark_decontamination,
        op7_exact_top_k,
        op8_license_scans,
        op9_language_id,
        op10_line_dedup,
    )
}

#: What SQL cannot express is tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": OP3_SQL,
    "op5_url_filters": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op7_exact_top_k": OP7_SQL,
    "op8_license_scans": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
}
