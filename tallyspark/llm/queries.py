"""The queries of the llm operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from tallyspark.llm import bpe, chat, embedding_dedup, language_id, line_dedup, ngram_join, packing, pii, topk, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_language_id": language_id.op2_language_id,
    "op3_pii": pii.op3_pii,
    "op4_topk": topk.op4_topk,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat": chat.op8_chat,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_bpe": bpe.op10_bpe,
    "pipeline": _pipeline,
}

SQL = {
    "op4_topk": topk.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_chat": chat.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
}
