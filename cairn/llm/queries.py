"""The registered queries of this package, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from cairn.llm import chat, decontam, licenses, mixing, neardup, quality
from cairn.llm.chat import op4_chat_round_trip
from cairn.llm.ctw import op7_context_tree_weighting
from cairn.llm.decontam import op3_minhash_containment
from cairn.llm.langid import op1_ecoc_language
from cairn.llm.licenses import op10_license_diagonals
from cairn.llm.mixing import op9_pareto_mix
from cairn.llm.neardup import op5_bottomk_near_dup
from cairn.llm.quality import op2_quality_llr
from cairn.llm.sharding import op6_size_tiered_shards
from cairn.llm.tokens import op8_viterbi_counts

QUERIES = {
    "op1_ecoc_language": op1_ecoc_language,
    "op2_quality_llr": op2_quality_llr,
    "op3_minhash_containment": op3_minhash_containment,
    "op4_chat_round_trip": op4_chat_round_trip,
    "op5_bottomk_near_dup": op5_bottomk_near_dup,
    "op6_size_tiered_shards": op6_size_tiered_shards,
    "op7_context_tree_weighting": op7_context_tree_weighting,
    "op8_viterbi_counts": op8_viterbi_counts,
    "op9_pareto_mix": op9_pareto_mix,
    "op10_license_diagonals": op10_license_diagonals,
}

ORACLES: dict[str, str] = {
    "op2_quality_llr": quality.ORACLE,
    "op3_minhash_containment": decontam.ORACLE,
    "op4_chat_round_trip": chat.ORACLE,
    "op5_bottomk_near_dup": neardup.ORACLE,
    "op9_pareto_mix": mixing.ORACLE,
    "op10_license_diagonals": licenses.ORACLE,
}
