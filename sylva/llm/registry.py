"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, license_scan, mixing, near_dedup, packing, periodic_runs, pii, prefix_trie, quality, simhash, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_attribution": token_counts.op1_token_attribution,
        "op2_poisson_mixing": mixing.op2_poisson_mixing,
        "op3_toxicity_boosted_trees": toxicity.op3_toxicity_boosted_trees,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_weak_supervision_pii": pii.op5_weak_supervision_pii,
        "op6_license_rules": license_scan.op6_license_rules,
        "op7_ftrl_quality": quality.op7_ftrl_quality,
        "op8_bagminhash_near_dedup": near_dedup.op8_bagminhash_near_dedup,
        "op9_nn_descent": ann.op9_nn_descent,
        "op10_three_phase_topk": topk.op10_three_phase_topk,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_simhash_near_dedup": simhash.op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_poisson_mixing": mixing.ORACLE,
        "op6_license_rules": license_scan.oracle(),
        "op10_three_phase_topk": topk.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
    }
