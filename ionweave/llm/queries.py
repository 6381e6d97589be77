"""Queries and SQL of the text operators, for the driver's entry module."""

from __future__ import annotations

from . import op1_line_dedup as o1, op2_secrets as o2, op3_toxicity as o3, op4_near_dedup as o4, op5_substring_dedup as o5, op6_decontam as o6, op7_license as o7, op8_mixing as o8, op9_exact_dedup as o9, op10_warc as o10, op11_fim as o11, op12_bpe as o12


def queries() -> dict:
    return {
        "op1_line_dedup": o1.op1_line_dedup,
        "op2_secrets": o2.op2_secrets,
        "op3_toxicity": o3.op3_toxicity,
        "op4_near_dedup": o4.op4_near_dedup,
        "op5_substring_dedup": o5.op5_substring_dedup,
        "op6_decontamination": o6.op6_decontamination,
        "op7_license": o7.op7_license,
        "op8_mixing": o8.op8_mixing,
        "op9_exact_dedup": o9.op9_exact_dedup,
        "op10_warc": o10.op10_warc,
        "op11_fill_in_middle": o11.op11_fill_in_middle,
        "op12_bpe": o12.op12_bpe,
    }


def oracle_sql() -> dict:
    return {"op4_near_dedup": o4.SQL, "op5_substring_dedup": o5.SQL, "op6_decontamination": o6.SQL, "op9_exact_dedup": o9.SQL, "op10_warc": o10.SQL, "op11_fill_in_middle": o11.SQL}
