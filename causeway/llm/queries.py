"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from causeway.llm.binary import op4_token_ids
from causeway.llm.divergence import ORACLE_OP13, op13_source_divergence
from causeway.llm.exact import ORACLE_DELIVERIES, ORACLE_OP9, exact_dedup_deliveries, op9_exact_dedup
from causeway.llm.language import op8_language
from causeway.llm.minhash import op1_minhash
from causeway.llm.mixing import op2_mix_sources
from causeway.llm.negatives import ORACLE_OP12, op12_hard_negatives
from causeway.llm.packing import op5_pack
from causeway.llm.pii import op6_pii
from causeway.llm.quality import op11_quality_rules
from causeway.llm.secrets import op7_secrets
from causeway.llm.simhash import op3_simhash, simhash_search
from causeway.llm.urls import ORACLE_OP10, op10_url_filter

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash": op3_simhash,
    "op4_token_ids": op4_token_ids,
    "op5_pack": op5_pack,
    "op6_pii": op6_pii,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
    "simhash_search": simhash_search,
    "exact_dedup_deliveries": exact_dedup_deliveries,
}
ORACLES = {"exact_dedup_deliveries": ORACLE_DELIVERIES, "op9_exact_dedup": ORACLE_OP9, "op10_url_filter": ORACLE_OP10, "op12_hard_negatives": ORACLE_OP12, "op13_source_divergence": ORACLE_OP13}
