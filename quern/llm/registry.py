"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, langid, lm, sentencepiece, simhash, tokens, topk, toxicity, urls


def pipeline(spark, sf_dir: str):
    """The pipeline at the repository's top, which imports this subpackage."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_tokens": tokens.op1_tokens,
    "op2_lm": lm.op2_lm,
    "op3_topk": topk.op3_topk,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_langid": langid.op5_langid,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_sentencepiece": sentencepiece.op9_sentencepiece,
    "op10_urls": urls.op10_urls,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op3_topk": topk.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op10_urls": urls.ORACLE_SQL,
}
