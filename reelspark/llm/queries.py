"""The queries of this subpackage over whole tables, with their parameters and SQL."""

from __future__ import annotations

import public_tokenizers
from reelspark.llm import chat, embedding_dedup, exact_dedup, lexical_search, license_scan, lm_scoring, near_dedup, packing, quality, sentencepiece_codec, source_audit, sql, token_files, topk_search
from reelspark.llm.common import table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_bytes", "locator")


def op3_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_rotation(spark, sf_dir):
    return chat.rotated_chats(table(spark, sf_dir, "conversations"))


def op6_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), good)


def op7_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0).drop("ids")


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1, size=4096)


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op11_lexical_search(spark, sf_dir):
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_source_audit(spark, sf_dir):
    return source_audit.source_audit(table(spark, sf_dir, "documents"), least=30, top=50)


def op13_topk_search(spark, sf_dir):
    return topk_search.top_products(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_exact_dedup, op3_embedding_near_dedup, op4_sentencepiece, op5_chat_rotation,
        op6_lm_scoring, op7_token_files, op8_minhash_near_dedup, op9_best_fit_packing, op10_quality_classifier,
        op11_lexical_search, op12_source_audit, op13_topk_search,
    )
}

#: The others have tests against brute force: tokenizers and learned models can't be stated in SQL.
ORACLE = {
    "op1_license_scan": sql.LICENSES,
    "op2_exact_dedup": sql.EXACT,
    "op3_embedding_near_dedup": sql.EMBEDDINGS,
    "op5_chat_rotation": sql.CHATS,
    "op8_minhash_near_dedup": sql.NEAR,
    "op11_lexical_search": sql.RANKED,
    "op12_source_audit": sql.AUDIT,
    "op13_topk_search": sql.TOP_PRODUCTS,
}
