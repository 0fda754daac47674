"""The queries of the operators, by name, and their DuckDB SQL where SQL can express them.

Without SQL: substring deduplication (the cuts inside long sentences follow a hash that SQL doesn't have),
the classifier, personal data (its parsers drop failing matches without retries and give code points),
token counts, SimHash (XXH64), packing, byte-exact repeats and the cheapest repairs.  Tests hold these against brute force or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscan.llm import chat, decontamination, packing, pii, prefix_trie, quality_gam, quality_rules, simhash, substring_dedup, suffix_dedup, token_count, turn_repair, url_filter
from textscan.llm.batches import read, written
from textscan.llm.url_filter import HostRule, PatternRule

Query = Callable[[SparkSession, str], DataFrame]

HOST_RULES = (
    HostRule("allow", "com"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Pages without text of their own: sessions, referrers, shops, forms.
PATTERN_RULES = tuple(PatternRule("block", p) for p in ("^ref=", "^sid=", "^phpsessid=", "/login^", "/cart^", "/wp-admin/")) + (
    PatternRule("allow", "^ref=canonical^"),
)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.url_verdicts(pages, "url", HOST_RULES + PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return substring_dedup.remove_repeats(rows, "doc_id", "text", ("file", "place"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").filter(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality_gam.train(*quality_gam.training_rows(docs, labels))
    return quality_gam.scored(docs, "text", model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, "text", tokenizer_path("byte_bpe_50k.json"), 1024).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(read(spark, sf_dir, "documents"), "doc_id", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = quality_rules.judged(docs, "text", "lang", "source", carry_text=False)[0]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contamination(docs, "text", read(spark, sf_dir, "benchmark"), "item_id", "text")
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), decontamination.items_digest("item_ids").alias("items_sha256"), "contaminated")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.conversation_events(read(spark, sf_dir, "conversations"))
    probe = spark.createDataFrame([(-7, i, r, chat.PROBE) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_log(log.unionByName(chat.conversation_events(probe))))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digests(suffix_dedup.without_repeats(docs, "text"), "doc_id")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_repair.damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    report = written(turn_repair.reports(turns))
    return turn_repair.digested(report, turn_repair.repaired(turns, report))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.trie(*prefix_trie.rebuilt(turns))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textscan.llm import stages

    return stages.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_substring_dedup, op3_quality_gam, op4_pii, op5_token_count, op6_simhash, op7_quality_rules, op8_decontamination,
        op9_packing, op10_chat, op11_suffix_dedup, op12_turn_repair, op13_prefix_trie, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_decontamination": decontamination.SQL,
    "op10_chat": chat.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
