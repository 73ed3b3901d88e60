"""Queries over texts and answers that repeat themselves or aren't JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsonfail import json_failure
from ..functions.repetition import answer_repetition, degenerate
from ..registry import query, table

#: For each character of x (id, t) and each period, whether it equals the character a period further, and whether the next turns all do.
_SAME = """c AS (SELECT id, generate_subscripts(string_split(t, ''), 1) AS i, unnest(string_split(t, '')) AS c FROM x WHERE t <> ''),
e AS (SELECT *, {same} FROM c WINDOW w AS (PARTITION BY id ORDER BY i)),
r AS (SELECT *, {turns} FROM e WINDOW v AS (PARTITION BY id ORDER BY i))"""
_PERIODS = range(2, 26)
_EQUAL = _SAME.format(
    same=", ".join(f"coalesce(c <> chr(10) AND c = lead(c, {p}) OVER w, false)::INT AS e{p}" for p in (1, *_PERIODS)),
    turns=", ".join([f"sum(e{p}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {5 * p - 1} FOLLOWING) = {5 * p} AS r{p}" for p in _PERIODS]
    + [f"sum(e1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 2} FOLLOWING) = {n - 1} AS s{n}" for n in (12, 15)]
    + [f"bool_or(c NOT IN (' ', chr(9), chr(11), chr(12), chr(13), chr(160))) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {p - 1} FOLLOWING) AS f{p}" for p in _PERIODS]),
)
_BROKEN = "bool_or(" + " OR ".join([*(f"(r{p} AND f{p})" for p in _PERIODS), "(s15 AND c NOT IN (' ', chr(9), chr(11), chr(12), chr(13), chr(160)))", "(s12 AND c = chr(9))"]) + ")"


@query(f"WITH x AS (SELECT doc_id AS id, text AS t FROM documents), {_EQUAL}, b AS (SELECT id, {_BROKEN} AS broken FROM r GROUP BY id) SELECT x.id AS doc_id, coalesce(broken, false) AS degenerate FROM x LEFT JOIN b USING (id)")
def degenerate_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", degenerate(F.col("text")).alias("degenerate"))


@query(
    """WITH x AS (SELECT conv_id, turn, role, turn % 4 AS k, 2 + length(role) AS n0, 6 + conv_id % 8 AS r0, CASE WHEN 6 + conv_id % 8 >= 12 AND 2 * (2 + length(role)) <= 25 THEN 2 ELSE 1 END AS m FROM conversations),
y AS (SELECT conv_id, turn, role, k, n0 * m AS n, r0 // m AS r, r0 FROM x)
SELECT conv_id, turn, role, CASE WHEN k = 0 THEN 'PATTERN_LOOP' WHEN k = 1 AND n * r >= 64 THEN 'PATTERN_LOOP' WHEN k = 2 THEN 'CHAR_RUN' END AS kind,
CASE WHEN k = 0 OR k = 1 AND n * r >= 64 THEN n WHEN k = 2 THEN 1 END AS pattern_length, CASE WHEN k = 0 OR k = 1 AND n * r >= 64 THEN r WHEN k = 2 THEN 15 + r0 END AS repetitions,
CASE WHEN k = 0 OR k = 1 AND n * r >= 64 THEN n * r WHEN k = 2 THEN 15 + r0 END AS span FROM y"""
)
def answer_repetitions(spark, d):
    """Answers made of roles said 6 to 13 times: as an identifier, as free text (harmless below 64 characters), a character in a text that isn't JSON, and a list of aliases, which may repeat."""
    again = (F.lit(6) + F.col("conv_id") % 8).cast("int")
    loop = F.repeat(F.concat(F.lit("<"), F.col("role"), F.lit(">")), again)
    k = F.col("turn") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit('{"evidence_ids": ["'), loop, F.lit('"], "label": "a"}'))).when(k == 1, F.concat(F.lit('{"topics": [{"label": "'), loop, F.lit('"}]}')))
        .when(k == 2, F.concat(F.lit("{"), F.repeat(F.lit("G"), again + 15))).otherwise(F.concat(F.lit('{"evidence_ids": ['), F.repeat(F.lit('"E001", '), again), F.lit('"E002"]}')))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", answer_repetition(answer).alias("a")).select("conv_id", "turn", "role", "a.*")


@query(
    r"""WITH x AS (SELECT doc_id, doc_id % 5 AS k, regexp_replace(text, '["\\]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, k, t, length(t) AS n, length(regexp_extract(t, '^[^\x00-\x1F]*', 0)) AS clean FROM x), z AS (SELECT *, clean < n AS broken FROM y)
SELECT doc_id, CASE WHEN k = 4 THEN 'NOT_AN_OBJECT' WHEN broken THEN 'INVALID_CONTROL_CHAR' WHEN k = 1 THEN 'UNTERMINATED_STRING' WHEN k = 2 THEN 'EXTRA_DATA' WHEN k = 3 THEN 'EXPECTING_DELIMITER' END AS kind,
CASE WHEN k = 4 THEN NULL WHEN broken THEN CASE WHEN k = 2 THEN 9 ELSE 10 END + clean WHEN k = 1 THEN 9 WHEN k = 2 THEN n + 12 WHEN k = 3 THEN n + 12 END AS "at",
CASE WHEN k = 4 THEN NULL WHEN broken OR k IN (1, 3) THEN 1 WHEN k = 2 THEN 2 END AS line, CASE WHEN k = 4 THEN NULL WHEN broken THEN CASE WHEN k = 2 THEN 10 ELSE 11 END + clean WHEN k = 1 THEN 10 WHEN k = 2 THEN 1 WHEN k = 3 THEN n + 13 END AS "column",
CASE WHEN k = 4 THEN NULL WHEN broken OR k IN (1, 2, 3) THEN false END AS at_end FROM z"""
)
def json_failures(spark, d):
    """Documents as the only field of an answer: whole, cut off, with more behind it, without a comma, and as a list. White space control characters in a text break it earlier."""
    t, k = F.regexp_replace("text", r'["\\]', ""), F.col("doc_id") % 5
    answer = (
        F.when(k == 0, F.concat(F.lit('{"text": "'), t, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"text": "'), t)).when(k == 2, F.concat(F.lit('{"text":"'), t, F.lit('"}\n{"more": 1}')))
        .when(k == 3, F.concat(F.lit('{"text": "'), t, F.lit('" "b": 1}'))).otherwise(F.lit("[1]"))
    )
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", json_failure(answer).alias("f"))
    return rows.select("doc_id", "f.kind", "f.at", "f.line", "f.column", "f.at_end")
