"""What went wrong with a model call, as kinds: the category, the phase, and whether smaller requests may help."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories by the kind of a refused request, in order; by the first rule that an answer breaks; and phases by category.
BY_REQUEST = (
    ("HTTP_CONTEXT_OVERFLOW", ("CONTEXT_OVERFLOW",)), ("HTTP_SCHEMA_REJECTED", ("UNSUPPORTED_STRUCTURED_OUTPUT",)), ("GBNF_GRAMMAR_ERROR", ("INFERENCE_BACKEND_ERROR", "SERVER_ERROR")),
)
BY_ANSWER = {
    "INVALID_JSON": "JSON_DECODE_ERROR", "NOT_AN_OBJECT": "JSON_DECODE_ERROR", "REPEATED_IDS": "DUPLICATE_EVIDENCE_ID", "EVIDENCE_IDS_DUPLICATED": "DUPLICATE_EVIDENCE_ID",
    "EVIDENCE_IDS_EMPTY": "EMPTY_EVIDENCE", "PRESENT_WITHOUT_EVIDENCE": "EMPTY_EVIDENCE", "TOPIC_COUNT_EXCEEDS_LIMIT": "EXCESS_TOPICS",
}
PHASES = {
    "HTTP_CONTEXT_OVERFLOW": "inference", "HTTP_INVALID_PARAMETERS": "inference", "HTTP_SCHEMA_REJECTED": "inference", "TIMEOUT": "inference", "JSON_DECODE_ERROR": "json_parsing",
    "OUTPUT_TRUNCATED": "inference", "SCHEMA_VALIDATION_ERROR": "schema_validation", "INVALID_EVIDENCE_ID": "evidence_validation", "DUPLICATE_EVIDENCE_ID": "evidence_validation",
    "EMPTY_EVIDENCE": "evidence_validation", "EXCESS_TOPICS": "schema_validation", "PROVENANCE_MISMATCH": "evidence_validation", "CHECKPOINT_SAVE_ERROR": "checkpoint_save", "MODEL_MISMATCH": "inference",
    "INTERNAL_VALIDATION_ERROR": "schema_validation", "DEGENERATE_OUTPUT": "inference", "GBNF_GRAMMAR_ERROR": "inference", "RETRY_EXHAUSTED": "inference", "UNKNOWN_ERROR": "inference", "NONE": "none",
}
#: Refused requests that halves of them would be, too; and outcomes of an attempt by category.
NOT_SMALLER = ("HTTP_INVALID_PARAMETERS", "INVALID_PARAMETERS", "HTTP_SCHEMA_REJECTED", "UNSUPPORTED_SCHEMA")
OUTCOMES = {"INVALID_EVIDENCE_ID": "INVALID_CITATION", "DEGENERATE_OUTPUT": "DEGENERATE", "OUTPUT_TRUNCATED": "TRUNCATED_LENGTH", "JSON_DECODE_ERROR": "JSON_SYNTAX"}
REQUEST_CATEGORIES = ("HTTP_CONTEXT_OVERFLOW", "HTTP_INVALID_PARAMETERS", "HTTP_SCHEMA_REJECTED", "GBNF_GRAMMAR_ERROR", "MODEL_MISMATCH", "TIMEOUT")


def request_category(status: Column, kind: Column) -> Column:
    """The category of a request that wasn't answered, by its status (null: no answer in time) and the kind that exports.http_error() tells."""
    out = F.when(status.isNull(), "TIMEOUT")
    for category, kinds in BY_REQUEST:
        out = out.when(kind.isin(*kinds), category)
    return out.when((kind == "INVALID_PARAMETER") | (status == 400), "HTTP_INVALID_PARAMETERS").when(kind == "MODEL_NOT_LOADED", "MODEL_MISMATCH").otherwise("HTTP_INVALID_PARAMETERS")


def answer_category(error: Column, degenerate: Column, unknown: Column, finish: Column) -> Column:
    """The category of an answer; null for a valid one.

    degenerate: it repeats itself; error: the first rule that it breaks, if any; unknown: it cites what it wasn't given; finish: why the model stopped. A broken answer that was cut off at the limit of its length is OUTPUT_TRUNCATED.
    """
    broken = F.lit(None).cast("string")
    for name, category in BY_ANSWER.items():
        broken = F.when(error == name, category).otherwise(broken)
    broken = F.coalesce(broken, F.lit("SCHEMA_VALIDATION_ERROR"))
    cut = (F.lower(finish) == "length") & broken.isin("JSON_DECODE_ERROR", "SCHEMA_VALIDATION_ERROR")
    return F.when(degenerate, "DEGENERATE_OUTPUT").when(error.isNotNull() & F.coalesce(cut, F.lit(False)), "OUTPUT_TRUNCATED").when(error.isNotNull(), broken).when(unknown, "INVALID_EVIDENCE_ID")


def phase(category: Column) -> Column:
    out = F.lit("none")
    for name, of in PHASES.items():
        out = F.when(category == name, of).otherwise(out)
    return out


def outcome(category: Column) -> Column:
    """OK or the kind of an attempt's failure, by its category (null: none)."""
    out = F.when(category.isin(*REQUEST_CATEGORIES), "BACKEND_ERROR").otherwise("OTHER_STRUCTURED")
    for name, of in OUTCOMES.items():
        out = F.when(category == name, of).otherwise(out)
    return F.when(category.isNull(), "OK").otherwise(out)
