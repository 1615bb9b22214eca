"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import digests
from .decontaminate import op4_decontamination
from .fingerprints import op5_order_minhash
from .neardup import OP10_SQL, op10_near_duplicates
from .packing import op6_packing
from .pii import op8_pii
from .planes import op3_binary_ids
from .quality import op7_quality
from .secrets import op9_secrets
from .tokens import op2_token_counts
from .urls import OP1_SQL, op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_binary_ids": op3_binary_ids,
    "op4_decontamination": op4_decontamination,
    "op5_order_minhash": op5_order_minhash,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_secrets": op9_secrets,
    "op10_near_duplicates": op10_near_duplicates,
    "pipeline": corpus_pipeline.run,
    **digests.QUERIES,
}
#: Without the operators that SQL cannot express; those are tested against brute-force versions.
ORACLE_SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op10_near_duplicates": OP10_SQL, **digests.ORACLE_SQL}
