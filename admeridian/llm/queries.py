"""The registered queries of the training-data operators."""

from __future__ import annotations

from admeridian.llm import chat, exact_dedup, mixing, packing, pii, quality, search, sharding, simhash, token_counts, token_files, toxicity, trie
from admeridian.llm.common import documents, staged


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


def op2_quality_rules(spark, sf_dir):
    """The whole ledger row beside the verdict: any later policy can be judged from it; ``sole_rule`` feeds ablations."""
    table = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), "web-v1")
    base = table["failed_bits"].bitwiseAND(quality.policy_mask("base-v1")) != 0
    others = [m for m in quality.MEASURES if m not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_bits", quality.sole_rule("web-v1").alias("sole_rule"), *others)


def op3_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(found["fp"]).alias("fingerprint"), "component_id")


def op4_personal_data(spark, sf_dir):
    return pii.personal_data_digest(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_feistel_sharding(spark, sf_dir):
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_source_mixing(spark, sf_dir):
    mixed = mixing.mix_decisions(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (mixed["size"] * mixed["copies"]).alias("taken"))


def op8_token_files(spark, sf_dir):
    return token_files.stored_documents(documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_decisions(documents(spark, sf_dir))


def op11_lexical_search(spark, sf_dir):
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_chat_formatting(spark, sf_dir):
    outputs = chat.format_conversations(chat.with_hostile(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return chat.digests(staged(outputs, "formatted"))


def op13_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_personal_data": op4_personal_data,
        "op5_toxicity": op5_toxicity,
        "op6_feistel_sharding": op6_feistel_sharding,
        "op7_source_mixing": op7_source_mixing,
        "op8_token_files": op8_token_files,
        "op9_token_counts": op9_token_counts,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_chat_formatting": op12_chat_formatting,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }
