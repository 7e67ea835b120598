"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from siltstone.llm.chat import OP2_SQL, op2_perspectives
from siltstone.llm.collocations import OP12_SQL, op12_collocations
from siltstone.llm.contamination import OP11_SQL, op11_decontamination
from siltstone.llm.fingerprints import op10_fingerprints
from siltstone.llm.line_dedup import OP3_SQL, op3_line_dedup
from siltstone.llm.manifest import OP13_SQL, op13_manifest
from siltstone.llm.near_dedup import op8_minhash
from siltstone.llm.packing import op7_packing
from siltstone.llm.pieces import op9_sentencepiece
from siltstone.llm.quality_rules import op6_quality_rules
from siltstone.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from siltstone.llm.token_counts import op5_token_counts
from siltstone.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_perspectives": op2_perspectives,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_fingerprints": op10_fingerprints,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_manifest": op13_manifest,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_perspectives": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_manifest": OP13_SQL,
}
