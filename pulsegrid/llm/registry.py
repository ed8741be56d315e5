"""The text operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import collocations, decontaminate, divergence, exact_dedup, line_dedup, lm_score, mixing, near_dedup, packing, pii, quality, url_filter, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_url_filters": url_filter.op1_url_filters,
        "op2_packing": packing.op2_packing,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_quality": quality.op4_quality,
        "op5_lm_scoring": lm_score.op5_lm_scoring,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_warc": warc.op8_warc,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_pii": pii.op10_pii,
        "op11_mixing": mixing.op11_mixing,
        "op12_collocations": collocations.op12_collocations,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.OP1_SQL,
        "op3_decontamination": decontaminate.OP3_SQL,
        "op6_near_dedup": near_dedup.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
