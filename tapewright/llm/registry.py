"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tapewright.llm import bpe, importance, jaccard_join, media, mixing, neighbours, passages, pii, secret_scan, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": secret_scan.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_personal_data": pii.query,
        "op4_mixing": mixing.query,
        "op5_importance": importance.query,
        "op6_telephony": media.query,
        "op7_warc": warc.query,
        "op8_bpe": bpe.query,
        "op9_neighbours": neighbours.query,
        "op10_passages": passages.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE}
