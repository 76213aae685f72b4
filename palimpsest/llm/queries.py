"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import op2_bottom_k_fingerprints
from .lm import op10_log_bilinear
from .mil import op8_attention_quality
from .mixing import op6_temperature_mixing
from .packing import op4_ffd_packing
from .quality_rules import op5_weak_supervision_rules
from .sharding import op9_hash_tree_sharding
from .simhash import op3_golay_simhash
from .suffixes import op1_suffix_levels
from .warc import OP7_SQL, op7_indexed_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_levels": op1_suffix_levels,
    "op2_bottom_k_fingerprints": op2_bottom_k_fingerprints,
    "op3_golay_simhash": op3_golay_simhash,
    "op4_ffd_packing": op4_ffd_packing,
    "op5_weak_supervision_rules": op5_weak_supervision_rules,
    "op6_temperature_mixing": op6_temperature_mixing,
    "op7_indexed_archive": op7_indexed_archive,
    "op8_attention_quality": op8_attention_quality,
    "op9_hash_tree_sharding": op9_hash_tree_sharding,
    "op10_log_bilinear": op10_log_bilinear,
}

ORACLE_SQL: dict[str, str] = {
    "op7_indexed_archive": OP7_SQL,
}
