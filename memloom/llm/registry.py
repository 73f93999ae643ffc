"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import op1_suffix, op2_order_minhash, op3_lines, op4_secrets, op5_wrapper, op6_toxicity, op7_url_lists, op8_topk, op9_packing, op10_fm_index, op11_divergence, op12_elkan, op13_piecewise

_MODULES = {
    "op1_suffix": op1_suffix,
    "op2_order_minhash": op2_order_minhash,
    "op3_lines": op3_lines,
    "op4_secrets": op4_secrets,
    "op5_wrapper": op5_wrapper,
    "op6_toxicity": op6_toxicity,
    "op7_url_lists": op7_url_lists,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_fm_index": op10_fm_index,
    "op11_divergence": op11_divergence,
    "op12_elkan": op12_elkan,
    "op13_piecewise": op13_piecewise,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLES = {name: m.SQL for name, m in _MODULES.items() if m.SQL}
