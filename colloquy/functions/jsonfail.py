"""What is wrong with a text that should be a JSON object, told in numbers and kinds only."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of a JSON parser's messages and the kinds they stand for.
KINDS = (
    ("Unterminated string", "UNTERMINATED_STRING"), ("Expecting value", "EXPECTING_VALUE"), ("Expecting ',' delimiter", "EXPECTING_DELIMITER"), ("Expecting ':' delimiter", "EXPECTING_DELIMITER"),
    ("Expecting property name", "EXPECTING_DELIMITER"), ("Extra data", "EXTRA_DATA"), ("Invalid \\escape", "INVALID_ESCAPE"), ("Invalid \\u", "INVALID_ESCAPE"),
    ("Invalid control character", "INVALID_CONTROL_CHAR"),
)
RESULT = "kind string, at int, line int, column int, at_end boolean, chars int"


def failure(text: str | None) -> tuple:
    """(kind, at, line, column, at_end, chars) of the first error; kind is None for an object."""
    text = text or ""
    if not text.strip():
        return "EMPTY_RESPONSE", None, None, None, None, len(text)
    try:
        whole = json.loads(text)
    except json.JSONDecodeError as error:
        kind = next((kind for begins, kind in KINDS if error.msg.startswith(begins)), "OTHER_SYNTAX")
        return kind, error.pos, error.lineno, error.colno, error.pos >= len(text.rstrip()), len(text)
    except RecursionError:
        return "OTHER_SYNTAX", None, None, None, None, len(text)
    return None if isinstance(whole, dict) else "NOT_AN_OBJECT", None, None, None, None, len(text)


def json_failure(text: Column) -> Column:
    """{kind, at, line, column, at_end, chars}: the kind and place of the first error (at counts from 0, line and column from 1), whether only white space follows, and the
    text's length. The kind is null for a JSON object, EMPTY_RESPONSE for null and blank texts, NOT_AN_OBJECT for other values; these have no place."""

    @F.pandas_udf(RESULT)
    def told(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([failure(t) for t in texts], columns=["kind", "at", "line", "column", "at_end", "chars"], dtype=object)
        return rows.astype({"at": "Int32", "line": "Int32", "column": "Int32", "at_end": "boolean", "chars": "Int32"})

    return told(text)


def finish_kind(reason: Column) -> Column:
    """STOP, LENGTH, OTHER, or MISSING for null, of the reason for which a model stopped."""
    low = F.lower(F.trim(reason))
    return F.when(reason.isNull(), "MISSING").when(low == "stop", "STOP").when(low == "length", "LENGTH").otherwise("OTHER")
