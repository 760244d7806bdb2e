"""Queries of the corpus operators and their SQL, added to the catalogue by the entry module."""

from martlib.llm import oracle
from martlib.llm.conversations import op12_conversation_repair
from martlib.llm.counts import op7_token_counts
from martlib.llm.decontaminate import op6_decontamination
from martlib.llm.language import op8_language_id
from martlib.llm.lines import op2_line_dedup
from martlib.llm.manifest import op11_merkle_manifest
from martlib.llm.neardup import op5_near_dedup
from martlib.llm.packing import op10_packing
from martlib.llm.pii import op3_pii_surrogates
from martlib.llm.quality import op4_quality_rules
from martlib.llm.substrings import op9_substring_dedup
from martlib.llm.urls import op1_url_filter
from martlib.llm.winnowing import op13_document_fingerprints

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLE = {
    "op2_line_dedup": oracle.OP2,
    "op4_quality_rules": oracle.OP4,
    "op5_near_dedup": oracle.OP5,
    "op6_decontamination": oracle.OP6,
    "op11_merkle_manifest": oracle.OP11,
    "op12_conversation_repair": oracle.OP12,
}
