"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from citespark.llm import bpe, embed, packing, pfp, pii, quality, simhash, spans, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality, "op2_toxicity": toxicity.op2_toxicity, "op3_simhash": simhash.op3_simhash, "op4_packing": packing.op4_packing,
        "op5_pii": pii.op5_pii, "op6_substrings": pfp.op6_substrings,
        "op7_bpe": bpe.op7_bpe, "op8_vectors": embed.op8_vectors, "op9_warc": warc.op9_warc, "op10_spans": spans.op10_spans,
    }


def oracle_sql() -> dict:
    return {"op8_vectors": embed.ORACLE, "op9_warc": warc.ORACLE, "op10_spans": spans.ORACLE}
