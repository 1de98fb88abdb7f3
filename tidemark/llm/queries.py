"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import digest_index, extendible, host_rules, language, mixing, parity_join, periodic_runs, piece_bpe, prefix_trie, secret_tests, subword_quality, token_coder, unigram_count
from .common import conversations, documents, labels


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark, sf_dir):
    return token_coder.token_file_query(spark, documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_host_rules(spark, sf_dir):
    return host_rules.host_query(documents(spark, sf_dir))


def op3_secrets(spark, sf_dir):
    return secret_tests.secret_query(documents(spark, sf_dir))


def op4_exact_dedup(spark, sf_dir):
    return digest_index.dedup_query(spark, documents(spark, sf_dir))


def op5_sharding(spark, sf_dir):
    return extendible.sharding_query(documents(spark, sf_dir))


def op6_language(spark, sf_dir):
    return language.language_query(documents(spark, sf_dir))


def op7_mixing(spark, sf_dir):
    return mixing.mixing_query(documents(spark, sf_dir))


def op8_token_counts(spark, sf_dir):
    return unigram_count.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op9_parity_join(spark, sf_dir):
    return parity_join.near_query(documents(spark, sf_dir))


def op10_pieces(spark, sf_dir):
    return piece_bpe.piece_query(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op11_subword_quality(spark, sf_dir):
    return subword_quality.quality_query(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie_query(conversations(spark, sf_dir))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.runs_query(documents(spark, sf_dir))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_host_rules": op2_host_rules,
    "op3_secrets": op3_secrets,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sharding": op5_sharding,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_token_counts": op8_token_counts,
    "op9_parity_join": op9_parity_join,
    "op10_pieces": op10_pieces,
    "op11_subword_quality": op11_subword_quality,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op2_host_rules": host_rules.ORACLE,
    "op4_exact_dedup": digest_index.ORACLE,
    "op5_sharding": extendible.oracle(),
    "op9_parity_join": parity_join.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
