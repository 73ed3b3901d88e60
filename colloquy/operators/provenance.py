"""Where results come from: snapshots of documents, origins of runs, preconditions and records of verifications, invariants of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most characters of a translated section, and of all sections of a message.
MAX_TRANSLATED = 8_000


def stated(text: Column) -> Column:
    """text without blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def fingerprint(text: Column) -> Column:
    """A recorded SHA-256 in lower case; null if it is none."""
    return F.when(F.trim(text).rlike(r"^[0-9a-fA-F]{64}$"), F.lower(F.trim(text)))


def snapshot_status(recorded: Column, active: Column) -> Column:
    """MATCH or MISMATCH of the fingerprint recorded by a run with the document's; UNVERIFIABLE where none is recorded."""
    return F.when(fingerprint(recorded).isNull(), "UNVERIFIABLE").when(fingerprint(recorded) == active, "MATCH").otherwise("MISMATCH")


def execution_origin(chunks: Column, recovered: Column, micro_recovered: Column, micro_computed: Column) -> Column:
    """Whether a run's chunks were computed, restored or both, by its counters; null counters count as zero, without chunks it is UNDETERMINED."""
    known = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(known(chunks) <= 0, "UNDETERMINED").when(known(recovered) >= chunks, "RESTORED_FROM_CHECKPOINT").when(known(recovered) > 0, "MIXED")
        .when((known(micro_recovered) > 0) & (known(micro_computed) > 0), "MIXED").when(known(micro_recovered) > 0, "RESTORED_FROM_CHECKPOINT").otherwise("COMPUTED_THIS_RUN")
    )


def completeness(status: Column, coverage: Column, flagged: Column) -> Column:
    """PARTIAL where the status or the coverage says so or the flag is set, else COMPLETE; nulls say nothing."""
    return F.when((F.coalesce(status, F.lit("")) == "PARTIAL") | (F.coalesce(coverage, F.lit("")) == "PARTIAL") | F.coalesce(flagged, F.lit(False)), "PARTIAL").otherwise("COMPLETE")


def topic_uid(run_id: Column, label: Column, description: Column, evidence_ids: Column) -> Column:
    """An identifier that follows a topic's run and content, not its place."""
    parts = F.concat(F.array(F.trim(run_id), F.trim(label), F.trim(description)), evidence_ids)
    return F.concat(F.lit("dtp_"), F.substring(F.sha2(F.array_join(parts, "\x1f"), 256), 1, 16))


def verification_block(document: Column, n_sections: Column, topic: dict[str, Column], run: dict[str, Column], snapshot: Column) -> Column:
    """The first reason why a topic can't be verified; null if it can.

    topic: document_id, run_id, label, n_evidence; run (all null where there is no such run): found, document_id, run_id, origin.
    """
    topic_run, topic_document, run_document, run_id, origin = (stated(c) for c in (topic["run_id"], topic["document_id"], run["document_id"], run["run_id"], run["origin"]))
    guards = (
        ("NO_DOCUMENT", document.isNull()), ("NO_EVIDENCE", F.coalesce(n_sections, F.lit(0)) == 0), ("PROVENANCE_MISSING", topic_document.isNull()),
        ("DOCUMENT_MISMATCH", topic_document != document), ("RUN_ID_MISSING", topic_run.isNull()),
        ("TOPIC_METADATA_INVALID", stated(topic["label"]).isNull() | (F.coalesce(topic["n_evidence"], F.lit(0)) == 0)), ("DISCOVERY_RUN_UNAVAILABLE", ~F.coalesce(run["found"], F.lit(False))),
        ("PROVENANCE_MISSING", run_document.isNull()), ("DOCUMENT_MISMATCH", run_document != document), ("RUN_ID_MISSING", run_id.isNull()), ("DISCOVERY_RUN_UNAVAILABLE", run_id != topic_run),
        ("ORIGIN_MISSING", origin.isNull()), ("SYNTHETIC_REFERENCE_ORIGIN", origin == "SYNTHETIC_REFERENCE"), ("SNAPSHOT_MISMATCH", snapshot == "MISMATCH"),
    )
    return F.coalesce(*[F.when(broken, code) for code, broken in guards])


def verification_records(results: DataFrame, topics: DataFrame, detections: DataFrame) -> DataFrame:
    """results (document_id, discovery_run_id, detection_run_id, topic_uid, more) of known topics (document_id, discovery_run_id, topic_uid)
    whose detection (run_id, document_id, origin_flow, verified_run_id) is a verification of that run; null and blank identifiers match nothing."""
    rows = results.withColumns({c: stated(F.col(c)) for c in ("discovery_run_id", "detection_run_id")})
    known = rows.join(topics.select("document_id", "discovery_run_id", "topic_uid"), ["document_id", "discovery_run_id", "topic_uid"], "left_semi")
    runs = detections.where("origin_flow = 'DISCOVERY_VERIFICATION'").select(
        F.col("run_id").alias("detection_run_id"), F.col("document_id").alias("_document"), stated(F.col("verified_run_id")).alias("_verified")
    )
    k, r = known.alias("k"), runs.alias("r")
    same = (F.col("k.detection_run_id") == F.col("r.detection_run_id")) & (F.col("k.document_id") == F.col("r._document"))
    return k.join(r, same & (F.col("r._verified").isNull() | (F.col("r._verified") == F.col("k.discovery_run_id"))), "left_semi")


def provenance_errors(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """Topics of no document; must be empty."""
    return topics.join(documents.select("document_id").distinct(), "document_id", "left_anti")


# -- translations -----------------------------------------------------------------------------------


def translation_errors(sections: DataFrame, translations: DataFrame) -> DataFrame:
    """(document_id, evidence_id, error) of answers to a translation of sections; must be empty.

    MISSING: a section without translation (a null text is none); DUPLICATE: translated more than once; UNKNOWN: a translation of no section; EMPTY: a blank
    translation of a text that isn't. The first that holds is told. Texts are never taken from the original.
    """
    keys = ["document_id", "evidence_id"]
    given = translations.where(F.col("translated_text").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(F.trim("translated_text") != "").alias("filled"))
    rows = sections.select(*keys, (F.trim("text") != "").alias("said"), F.lit(True).alias("asked")).join(given, keys, "full_outer")
    error = (
        F.when(F.col("asked").isNull(), "UNKNOWN").when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "DUPLICATE")
        .when(F.coalesce("said", F.lit(False)) & ~F.col("filled"), "EMPTY")
    )
    return rows.select(*keys, error.alias("error")).where(F.col("error").isNotNull())


def translated(sections: DataFrame, translations: DataFrame) -> DataFrame:
    """sections with their translation as text; a section without one fails the query."""
    keys = ["document_id", "evidence_id"]
    rows = sections.join(translations.select(*keys, "translated_text"), keys, "left")
    missing = F.raise_error(F.concat(F.lit("no translation of "), F.col("evidence_id")))
    return rows.withColumn("text", F.when(F.col("translated_text").isNull(), missing).otherwise(F.col("translated_text"))).drop("translated_text")


def translated_size_errors(sections: DataFrame, translations: DataFrame, most: int = MAX_TRANSLATED) -> DataFrame:
    """(document_id, message_id, error, chars) of messages whose translated sections are missing or longer than `most`, one of them or all; must be empty."""
    keys = ["document_id", "evidence_id"]
    rows = sections.select(*keys, "message_id").join(translations.select(*keys, F.length("translated_text").alias("c")), keys, "left")
    sums = rows.groupBy("document_id", "message_id").agg(F.bool_or(F.col("c").isNull()).alias("missing"), F.max("c").alias("longest"), F.sum("c").alias("chars"))
    error = F.when(F.col("missing"), "MISSING").when(F.col("longest") > most, "SECTION_TOO_LONG").when(F.col("chars") > most, "MESSAGE_TOO_LONG")
    return sums.select("document_id", "message_id", error.alias("error"), "chars").where(F.col("error").isNotNull())


# -- invariants -------------------------------------------------------------------------------------


def derived_errors(derived: DataFrame, messages: DataFrame) -> DataFrame:
    """(message_id, error) of results (message_id, source_name, source_record_id, status, asset_message_id) that don't fit their message; must be empty.

    MESSAGE: there is no such message; SOURCE and RECORD: other identifiers; PROVENANCE: a success without the message's own asset.
    """
    m = messages.select("message_id", F.col("source_name").alias("_source"), F.col("source_record_id").alias("_record"), F.lit(True).alias("_found"))
    error = (
        F.when(F.col("_found").isNull(), "MESSAGE").when(~F.equal_null("source_name", "_source"), "SOURCE").when(~F.equal_null("source_record_id", "_record"), "RECORD")
        .when((F.col("status") == "SUCCESS") & ~F.equal_null("asset_message_id", "message_id"), "PROVENANCE")
    )
    return derived.join(m, "message_id", "left").select("message_id", error.alias("error")).where(F.col("error").isNotNull())


def document_errors(sections: DataFrame) -> DataFrame:
    """(document_id, error, n) of documents with several sources, or with identifiers of evidence that repeat; must be empty."""
    ids = sections.groupBy("document_id", "evidence_id").agg(F.count("*").alias("k"), F.min("source_name").alias("low"), F.max("source_name").alias("high"))
    found = ids.groupBy("document_id").agg(F.count_if(F.col("k") > 1).alias("repeated"), (F.min("low") != F.max("high")).alias("mixed"))
    kinds = F.array(F.struct(F.lit("SOURCES").alias("error"), F.col("mixed").cast("long").alias("n")), F.struct(F.lit("REPEATED_IDS").alias("error"), F.col("repeated").alias("n")))
    return found.select("document_id", F.inline(kinds)).where("n > 0")


def with_truth(predictions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions (keys, actual) beside what is expected (keys, expected); those of no expectation are left out."""
    return predictions.select(*keys, "actual").join(truth.select(*keys, "expected"), keys)
