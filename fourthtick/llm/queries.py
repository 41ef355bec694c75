"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourthtick.llm.common import read_table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.secrets import scan_secrets, spans_text

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(spans_text("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"),
        spans_text("assign", "access", "hex", "random").alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.language import identify_languages

    return identify_languages(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.quality import classify_quality

    return classify_quality(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.decontamination import find_contamination, items_digest

    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = find_contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("unnamed_items").cast("int")).cast("long").alias("n_items"),
        items_digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_decontamination with the proximity matches; the SQL oracle fixes the columns of that one."""
    from fourthtick.llm.decontamination import SLOP, find_contamination, items_digest

    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = find_contamination(docs, items, slop=SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("unnamed_items").cast("int")).cast("long").alias("n_items"),
        items_digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        items_digest("near_items").alias("near_items_sha256"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fourthtick.llm.packing import pack_documents

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_limited_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences that every capacity limits: tokens, documents, attention."""
    import public_tokenizers

    from fourthtick.llm.packing import pack_pieces, tokenize_pieces

    docs = read_table(spark, sf_dir, "documents")
    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
    return pack_pieces(pieces, 4096, max_documents=8, max_attention=5_000_000)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.substrings import remove_repeats

    rows = remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)
    return rows.withColumnRenamed("kept", "kept_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.sharding import shard_uniformly

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shard_uniformly(rows, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.extraction import extract_main_text

    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.jaccard import jaccard_components

    found = jaccard_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.neural import score_corpus

    return score_corpus(read_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.lexical import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fourthtick.llm.conversations import damage, repair_conversations

    rows = read_table(spark, sf_dir, "conversations")
    return repair_conversations(damage(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secret_scans": op2_secret_scans,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_decontamination": op5_decontamination,
    "op5_proximity_matches": op5_proximity_matches,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op6_limited_packing": op6_limited_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_sharding": op8_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}
