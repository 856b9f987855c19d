"""The driver's queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import alignment, ann, decontaminate, langid, lm, minhash, mixing, negatives, packing, sharding, suffixes, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_reputation": urls.op1_host_reputation,
    "op2_golden_mix": mixing.op2_golden_mix,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_prefix_free_repeats": suffixes.op4_prefix_free_repeats,
    "op5_adaptive_scan": ann.op5_adaptive_scan,
    "op6_kneser_ney": lm.op6_kneser_ney,
    "op7_hyperminhash": minhash.op7_hyperminhash,
    "op8_prefix_leaks": decontaminate.op8_prefix_leaks,
    "op9_minimax_shards": sharding.op9_minimax_shards,
    "op10_byte_cnn_lang": langid.op10_byte_cnn_lang,
    "op11_hilbert_negatives": negatives.op11_hilbert_negatives,
    "op12_diagonal_alignment": alignment.op12_diagonal_alignment,
    "op13_online_packing": packing.op13_online_packing,
}

#: Beside the one query of each operator: the same over more.
BESIDE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_kneser_ney_three": lm.op6_kneser_ney_three}

ORACLES: dict[str, str] = {
    "op1_host_reputation": urls.SQL,
    "op2_golden_mix": mixing.SQL,
    "op4_prefix_free_repeats": suffixes.SQL,
    "op6_kneser_ney": lm.SQL,
    "op7_hyperminhash": minhash.SQL,
    "op8_prefix_leaks": decontaminate.SQL,
    "op9_minimax_shards": sharding.SQL,
    "op11_hilbert_negatives": negatives.SQL,
}
