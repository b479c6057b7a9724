"""The queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import ann, conversation_repair, decontaminate, exact_dedup, filter_audit, packing, pii, quality, secret_scan, simhash, tool_calls, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_ann": ann.op2_ann,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_tool_calls": tool_calls.op4_tool_calls,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_simhash": simhash.op9_simhash,
    "op10_pii": pii.op10_pii,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op6_url_filter": url_filter.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op8_secret_scan": secret_scan.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
