"""Registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import classlm, decontaminate, html, jaccard, mixing, quality, secrets, sharding, substrings, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_classlm": classlm.op5_classlm,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_substrings": substrings.op10_substrings,
    "sharding_splits": sharding.sharding_splits,
    "quality_base": quality.quality_base,
}

ORACLE_SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_secrets": secrets.OP3_SQL,
    "quality_base": quality.BASE_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "sharding_splits": sharding.SPLITS_SQL,
    "op10_substrings": substrings.OP10_SQL,
}
