"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, chat, decontaminate, language, linededup, media, negatives, neardup, packing, search, sharding, suffixes, toxicity

QUERIES = {
    "op1_histogram_sharding": sharding.query,
    "op2_prefix_decontamination": decontaminate.query,
    "op3_iso_media": media.query,
    "op4_multi_index_hamming": neardup.query,
    "op5_bounded_packing": packing.query,
    "op6_language_id": language.query,
    "op7_chat_round_trip": chat.query,
    "op8_ordinal_toxicity": toxicity.query,
    "op9_sparse_suffixes": suffixes.query,
    "op10_line_spread": linededup.query,
    "op11_dangling_suffix": alignment.query,
    "op12_pivot_negatives": negatives.query,
    "op13_adaptive_scan": search.query,
}

ORACLES: dict[str, str] = {
    "op2_prefix_decontamination": decontaminate.ORACLE,
    "op4_multi_index_hamming": neardup.ORACLE,
    "op7_chat_round_trip": chat.ORACLE,
    "op9_sparse_suffixes": suffixes.ORACLE,
    "op10_line_spread": linededup.ORACLE,
    "op12_pivot_negatives": negatives.ORACLE,
}
