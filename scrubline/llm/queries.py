"""Registry of the llm queries and their SQL."""

from __future__ import annotations

import functools

from scrubline.llm import bwt_dedup, chat_format, classifier, common, decontam, packing, pii, quality_rules, simhash, substring_tree, token_output


def _in_small_batches(query):
    @functools.wraps(query)
    def run(spark, sf_dir: str):
        common.small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {
        "op1_simhash_grid": simhash.op1_simhash_grid,
        "op2_prefix_suffix_trees": substring_tree.op2_prefix_suffix_trees,
        "op3_bwt_merge": bwt_dedup.op3_bwt_merge,
        "op4_fertility_rules": quality_rules.op4_fertility_rules,
        "op5_token_frames": token_output.op5_token_frames,
        "op6_exact_complement": packing.op6_exact_complement,
        "op7_feistel_pseudonyms": pii.op7_feistel_pseudonyms,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_chat_prefix_target": chat_format.op9_chat_prefix_target,
        "op10_quality_gbt": classifier.op10_quality_gbt,
    }
    return {name: _in_small_batches(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_prefix_suffix_trees": substring_tree.OP2_SQL,
        "op3_bwt_merge": bwt_dedup.OP3_SQL,
        "op8_decontaminate": decontam.OP8_SQL,
        "op9_chat_prefix_target": chat_format.OP9_SQL,
    }
