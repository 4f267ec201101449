"""Queries and SQL of this package, for __spark_entry__.py."""

from __future__ import annotations

from . import alignment, bpe, chat, exact_dedup, jaccard_join, merge_replay, packing, pii, source_audit, suffix_dedup, syncmers, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_syncmers": syncmers.op3_syncmers,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_warc": warc.op5_warc,
    "op6_packing": packing.op6_packing,
    "op7_pii": pii.op7_pii,
    "op8_chat": chat.op8_chat,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_bpe": bpe.op10_bpe,
    "op11_alignment": alignment.op11_alignment,
    "op12_merge_replay": merge_replay.op12_merge_replay,
    "op13_divergence": source_audit.op13_divergence,
}

ORACLES = {
    "op5_warc": warc.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op13_divergence": source_audit.OP13_SQL,
}
