"""Queries of the operators and the SQL they are compared with."""

from __future__ import annotations

from . import binary, chunks, decontaminate, licences, merkle, mixing, near, packing, pii, quality, rules, suffix, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_binary": binary.op2_binary,
    "op3_chunks": chunks.op3_chunks,
    "op4_licences": licences.op4_licences,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_near": near.op7_near,
    "op8_rules": rules.op8_rules,
    "op9_packing": packing.op9_packing,
    "op10_suffix": suffix.op10_suffix,
    "op11_merkle": merkle.op11_merkle,
    "op12_mixing": mixing.op12_mixing,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op5_decontamination": decontaminate.OP5_SQL,
    "op8_rules": rules.OP8_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
}
