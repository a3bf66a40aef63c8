"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op4_benchmark_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .importance import op12_importance_resampling
from .lm_scoring import op11_lm_scoring
from .ngram_join import op7_ngram_jaccard_join
from .packing import op1_packing
from .pii import op8_pii
from .quality import op9_quality_classifier
from .secrets import op3_secret_scan
from .sharding import op2_sharding
from .suffix_dedup import op6_suffix_array_dedup
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_secret_scan": op3_secret_scan,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
