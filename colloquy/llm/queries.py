"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    from .lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_sstable(spark, sf_dir):
    import public_tokenizers

    from .sstable import read_shards, write_shards

    rows = read_shards(spark, write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_warc_fixity(spark, sf_dir):
    """All pages as archives, a replica with a flipped byte in every record whose page_id is divisible by 50, and the audit of both."""
    from .fixity import audit, replicate, write_archives

    def damage(number, raw):
        at = len(raw) - 5
        return raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :] if number is not None and number % 50 == 0 else raw

    folder = write_archives(table(spark, sf_dir, "pages"))
    found = audit(spark, folder, replicate(spark, folder, damage))
    return found.select(F.col("left_record_id").alias("page_id"), "path", "status", "left_first_offset", "left_end_offset", "left_digest", "right_digest")


def op5_quality_classifier(spark, sf_dir):
    from .quality_model import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    rows = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_suffix_array_dedup(spark, sf_dir):
    from .suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    from .quality_rules import judge

    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .bpe_sql import encode_and_decode

    rows = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_substring_dedup(spark, sf_dir):
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    from .codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark, sf_dir):
    from .wrappers import extract

    return extract(table(spark, sf_dir, "pages"))


def op13_embedding_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import codes

    return {"op11_vector_codes": codes.SQL}
