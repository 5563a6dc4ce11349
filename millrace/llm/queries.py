"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import jaccard_join, source_audit
from millrace.llm.decontamination import decontaminate_query
from millrace.llm.katz import lm_query
from millrace.llm.language_id import language_query
from millrace.llm.license_scan import license_query
from millrace.llm.periodic_runs import runs_query
from millrace.llm.pii import pii_query
from millrace.llm.quality_classifier import classifier_query
from millrace.llm.quality_rules import quality_query
from millrace.llm.sentencepieces import encode_query
from millrace.llm.sharding import shard_query
from millrace.llm.url_filter import url_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_boosted_trees": url_query,
        "op2_candidate_boosting": pii_query,
        "op3_attention_mil": classifier_query,
        "op4_external_shuffle": shard_query,
        "op5_batched_viterbi": encode_query,
        "op6_nearest_centroid": language_query,
        "op7_cgk_lsh": decontaminate_query,
        "op8_heavy_light_jaccard": jaccard_join.jaccard_query,
        "op9_robust_outliers": quality_query,
        "op10_katz_backoff": lm_query,
        "op11_partition_refinement": runs_query,
        "op12_rare_word_index": license_query,
        "op13_source_divergence": source_audit.audit_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_heavy_light_jaccard": jaccard_join.SQL, "op13_source_divergence": source_audit.SQL}
