"""A corpus pipeline: quality classifier, quality rules, SimHash near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that the classifier accepts.

    Each row is judged by its own text, null and empty ones too; rows without or with repeated doc_id are judged like any other, equal
    rows alike; columns stay as they are, whatever their names; without labels all scores are 0.5, so all stay; an empty table gives no rows.
    """
    from colloquy.llm.quality_model import keep_good

    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the documents that the learned decision list keeps.

    Null and empty texts fail the base rule and go; rows without or with repeated doc_id are judged each by its own text; columns stay
    as they are; without labels the base rule alone decides; an empty table gives no rows.
    """
    from colloquy.llm.quality_rules import keep_accepted

    return keep_accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies, that with the smallest doc_id.

    Null and wordless texts are one group; of rows that share the smallest doc_id one stays; a row without doc_id stays only where its group
    has no other; columns stay as they are; an empty table gives no rows.
    """
    from colloquy.llm.simhash import keep_first

    return keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the documents without the passages that repeat, nearly or exactly, a document before them.

    All rows stay. Null texts stay null, a text that is all repeated becomes empty; rows that share a doc_id or have none are cut each by its own passages, in
    the order of doc_id, those without last; columns stay as they are, n_chars follows the text; an empty table gives no rows.
    """
    from colloquy.llm.passages import without_repeats

    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents' tokens in sequences of 2048.

    Null and empty texts give their end token; repeated rows are packed each; a null doc_id is carried; texts of any length are cut at
    windows; other columns are left out; an empty table gives no rows.
    """
    import public_tokenizers

    from colloquy.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written as Parquet and read again."""
    from colloquy.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
