"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from . import oracles
from .chat import chat_digests, format_chats
from .common import documents
from .decontaminate import decontaminate
from .jaccard import jaccard_components
from .language import predict_languages
from .manifest import document_manifest
from .outliers import judge_quality
from .media import media_digests, write_features, write_media
from .packing import pack_documents
from .quality import classify
from .substrings import find_repeats
from .token_output import token_digests
from .urls import judge
from .whitening import whiten


def op1_decontamination(spark, sf_dir):
    return decontaminate(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_chat_format(spark, sf_dir):
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(spark, chats.unionByName(own)))


def op3_substring_dedup(spark, sf_dir):
    return find_repeats(spark, documents(spark, sf_dir)).digests()


def op4_token_output(spark, sf_dir):
    return token_digests(spark, documents(spark, sf_dir))


def op5_quality(spark, sf_dir):
    return classify(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_media(spark, sf_dir):
    return media_digests(write_features(spark, write_media(spark, documents(spark, sf_dir))))


def op7_packing(spark, sf_dir):
    return pack_documents(spark, documents(spark, sf_dir))


def op8_language(spark, sf_dir):
    return predict_languages(spark, documents(spark, sf_dir))


def op9_url_filters(spark, sf_dir):
    return judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_jaccard(spark, sf_dir):
    return jaccard_components(spark, documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_manifest(spark, sf_dir):
    return document_manifest(spark, documents(spark, sf_dir)).proved()


def op12_whitening(spark, sf_dir):
    return whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality_rules(spark, sf_dir):
    return judge_quality(spark, documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_output": op4_token_output,
    "op5_quality": op5_quality,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_url_filters": op9_url_filters,
    "op10_jaccard": op10_jaccard,
    "op11_manifest": op11_manifest,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES = {"op1_decontamination": oracles.DECONTAMINATION, "op3_substring_dedup": oracles.REPEATS, "op10_jaccard": oracles.JACCARD, "op11_manifest": oracles.MANIFEST}
