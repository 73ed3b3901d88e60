"""Conversations as texts for a model: JSON with all fields, compact lines, what the lines save, fingerprints of settings, sizes.

Rows are messages with the keys of their document, seq, message_id, alias (null: no section), evidence_id, sender, source_type,
source_name, source_record_id, language, ordinal and text. A text is gathered per key, so the keys should be those of a chunk, whose size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, framing_tokens, is_media_placeholder
from .chunks import SECTION_TOKENS

#: What stands around the evidence.
JSON_START, LINES_START = "=== BEGIN FORENSIC EVIDENCE DATA (UNTRUSTED RAW JSON) ===", "=== BEGIN FORENSIC EVIDENCE DATA (UNTRUSTED COMPACT JSONL) ==="
END = "=== END FORENSIC EVIDENCE DATA ==="
FIELDS = ("evidence_id", "source_type", "message_id", "source_name", "source_record_id", "language", "ordinal", "text")


def as_json(value: Column) -> Column:
    """One value as JSON, null too."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def json_object(fields: dict[str, Column], optional: tuple[str, ...] = (), separator: str = ", ") -> Column:
    """A JSON object with the fields in order; the optional ones only where they aren't null."""
    pairs = []
    for name, value in fields.items():
        pair = F.concat(F.lit(f'"{name}": '), as_json(value))
        pairs.append(F.when(value.isNotNull(), pair) if name in optional else pair)
    return F.concat(F.lit("{"), F.concat_ws(separator, *pairs), F.lit("}"))


def config_fingerprint(settings: dict[str, Column]) -> Column:
    """The SHA-256 of the settings as JSON in the order of their names; settings of one session only don't belong in it."""
    return F.sha2(json_object(dict(sorted(settings.items()))), 256)


def compact_line(text: Column, alias: Column, message_id: Column, sender: Column, source_type: Column) -> Column:
    """A section as one line: its type only where it is derived, a mark on texts that stand for media."""
    original = source_type == "ORIGINAL_TEXT"
    some = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    fields = {
        "id": alias, "msg_id": some(message_id), "sender": some(sender), "source_type": F.when(~original, source_type),
        "media_placeholder": F.when(original & is_media_placeholder(text), F.lit(True)), "text": F.coalesce(text, F.lit("")),
    }
    return json_object(fields, ("msg_id", "sender", "source_type", "media_placeholder"))


def _lined(rows: DataFrame) -> DataFrame:
    """rows with the section as a compact line and as an item of the full JSON; null where there is no section."""
    c = F.col
    line = compact_line(c("text"), c("alias"), c("message_id"), c("sender"), c("source_type"))
    item = F.concat_ws(",\n", *[F.concat(F.lit(f'      "{f}": '), as_json(c(f))) for f in FIELDS])
    return rows.withColumns({"_line": F.when(c("alias").isNotNull(), line), "_item": F.when(c("alias").isNotNull(), F.concat(F.lit("    {\n"), item, F.lit("\n    }")))})


def _head(document: Column, messages: Column, sections: Column, strategy: str) -> Column:
    counts = F.concat(F.lit(',\n  "total_bundles": '), messages.cast("string"), F.lit(',\n  "total_evidence_sections": '), sections.cast("string"), F.lit(',\n  "evidence_sections": ['))
    return F.concat(F.lit('{\n  "document_id": '), as_json(document), F.lit(f',\n  "strategy": "{strategy}"'), counts)


def serialized(rows: DataFrame, keys: list[str], document: Column, strategy: str = "DIRECT_MULTILINGUAL") -> DataFrame:
    """(keys, full, compact): both texts of each key's sections in the order of seq; a document without sections has none between its delimiters."""
    of = lambda c, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), by)
    got = _lined(rows).groupBy(*keys).agg(
        of("_line", "\n").alias("l"), of("_item", ",\n").alias("i"), F.count_distinct("message_id").alias("m"), F.count("_line").alias("n")
    )
    body = F.when(F.col("n") > 0, F.concat(F.lit("\n"), "i", F.lit("\n  ]"))).otherwise("]")
    full = F.concat(F.lit(JSON_START + "\n"), _head(document, F.col("m"), F.col("n"), strategy), body, F.lit("\n}\n" + END))
    return got.select(*keys, full.alias("full"), F.concat(F.lit(LINES_START + " (document_id: "), document, F.lit(")\n"), "l", F.lit("\n" + END)).alias("compact"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 2)).otherwise(F.lit(0.0))


def savings(rows: DataFrame, keys: list[str], document: Column, strategy: str = "DIRECT_MULTILINGUAL") -> DataFrame:
    """Characters and estimated tokens of both texts and what the lines save, from sums of lengths: no text is gathered."""
    c = F.col
    got = _lined(rows).groupBy(*keys).agg(
        F.count_distinct("message_id").alias("total_messages"), F.count("_line").alias("total_sections"), F.coalesce(F.sum(F.length("_line")), F.lit(0)).alias("l"),
        F.coalesce(F.sum(F.length("_item")), F.lit(0)).alias("i"),
    )
    n = c("total_sections")
    full = len(JSON_START) + 1 + F.length(_head(document, c("total_messages"), n, strategy)) + F.when(n > 0, c("i") + 2 * (n - 1) + 5).otherwise(1) + 3 + len(END)
    compact = len(LINES_START) + len(" (document_id: )\n") + F.length(document) + c("l") + F.greatest(n - 1, F.lit(0)) + 1 + len(END)
    got = got.withColumns({"full_chars": full.cast("long"), "compact_chars": compact.cast("long")})
    got = got.withColumns({"full_tokens": F.ceil(c("full_chars") / CHARS_PER_TOKEN), "compact_tokens": F.ceil(c("compact_chars") / CHARS_PER_TOKEN)})
    return got.select(
        *keys, "total_messages", "total_sections", "full_chars", "compact_chars", "full_tokens", "compact_tokens",
        _percent(c("full_chars") - c("compact_chars"), c("full_chars")).alias("chars_saved_percent"), _percent(c("full_tokens") - c("compact_tokens"), c("full_tokens")).alias("tokens_saved_percent"),
    )


def document_sizes(rows: DataFrame, chunked: DataFrame, keys: list[str]) -> DataFrame:
    """Messages, sections, characters, estimated tokens, chunks, and whether any section is derived, per document. chunked: (keys, seq, chunk) of its messages."""
    there = F.col("alias").isNotNull()
    got = rows.groupBy(*keys).agg(
        F.count_distinct("message_id").alias("n_messages"), F.count_if(there).alias("n_sections"), F.coalesce(F.sum(F.when(there, F.length("text"))), F.lit(0)).alias("chars"),
        F.bool_or(there & (F.col("source_type") != "ORIGINAL_TEXT")).alias("multimodal"),
    )
    parts = chunked.groupBy(*keys).agg((F.max("chunk") + 1).alias("n_chunks"))
    sized = got.withColumn("tokens", F.ceil(F.col("chars") / CHARS_PER_TOKEN))
    return sized.join(parts, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def bundle_tokens(sections: DataFrame, keys: list[str], names: list[Column]) -> DataFrame:
    """(keys, chunk_tokens, micro_tokens): the estimated tokens of a message by its sections' texts, with the framing of each by its names in a chunk, and 20 a section in a microchunk."""
    text = F.ceil(F.sum(F.length(F.coalesce("text", F.lit("")))) / CHARS_PER_TOKEN)
    return sections.groupBy(*keys).agg((text + F.sum(framing_tokens(*names))).cast("long").alias("chunk_tokens"), (text + SECTION_TOKENS * F.count("*")).cast("long").alias("micro_tokens"))
