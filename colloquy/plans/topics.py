"""Queries over topics, citations and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import topics as O
from ..registry import query, table

_ID = "'unified:' || source || ':' || doc_id || '::ORIGINAL_TEXT'"


def _sections(spark, d):
    return S.evidence_sections(table(spark, d, "documents"))


def _detections(spark, d):
    """A verdict per labelled document, which cites its own section and sometimes one that doesn't exist."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    id = F.concat(F.lit("unified:"), "source", F.lit(":"), F.col("doc_id").cast("string"), F.lit("::ORIGINAL_TEXT"))
    made_up = F.when(F.col("doc_id") % 3 == 0, "E999").when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string"))
    return table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("topic_id"), F.concat(F.lit("Topic "), "lang").alias("label"), F.lit("").alias("description"),
        F.when(F.col("toxic") == 1, "PRESENT").otherwise("ABSENT").alias("decision"), F.array_compact(F.array(id, made_up)).alias("evidence_ids"),
    )


_CITED = f"""c AS (SELECT doc_id AS document_id, source, lang, toxic, unnest(list_filter([{_ID}, CASE doc_id % 3 WHEN 0 THEN 'E999' WHEN 1 THEN doc_id::VARCHAR END], lambda x: x IS NOT NULL)) AS evidence_id FROM labels JOIN documents USING (doc_id)),
s AS (SELECT {_ID} AS evidence_id, doc_id FROM documents WHERE regexp_matches(text, '\\S'))"""


@query(
    f"""WITH {_CITED}, x AS (SELECT 'detection' AS kind, * FROM c WHERE toxic = 1 UNION ALL SELECT 'discovery' AS kind, * FROM c WHERE lang = 'en')
SELECT kind, document_id, source AS topic_id, evidence_id, doc_id AS seq FROM x JOIN s USING (evidence_id)"""
)
def topic_search(spark, d):
    """Detections with evidence and discoveries about a label, with the sections that they cite."""
    topics = _detections(spark, d)
    found = O.search_topics(topics, "detection", decision="PRESENT").unionByName(O.search_topics(topics, "discovery", label="topic EN"))
    return O.resolved(O.cited(found, ["kind", "document_id", "topic_id"]), _sections(spark, d)).select("kind", "document_id", "topic_id", "evidence_id", "seq")


@query(f"WITH {_CITED} SELECT document_id, evidence_id FROM c WHERE evidence_id NOT IN (SELECT evidence_id FROM s)")
def hallucinated_citations(spark, d):
    return O.hallucinated(O.cited(_detections(spark, d), ["document_id"]), _sections(spark, d)).select("document_id", "evidence_id")


@query(
    f"""WITH {_CITED} SELECT source AS topic_id, CASE WHEN s.doc_id IS NOT NULL THEN 'VALID' WHEN evidence_id = 'E999' THEN 'ALIAS_FORMAT_NOT_IN_BLOCK' WHEN contains(evidence_id, '::') THEN 'FORENSIC_ID_NOT_IN_BLOCK' ELSE 'NUMERIC_ONLY' END AS shape, count(*) AS n
FROM c LEFT JOIN s USING (evidence_id) GROUP BY 1, 2"""
)
def citation_failures(spark, d):
    return O.citation_failures(O.cited(_detections(spark, d), ["topic_id"]), _sections(spark, d), ["topic_id"])


@query(f"WITH {_CITED} SELECT lang AS label, CASE WHEN s.doc_id IS NULL THEN 'NOT_IN_DOCUMENT' ELSE 'ORIGINAL_TEXT' END AS source_type, count(*) AS n FROM c LEFT JOIN s USING (evidence_id) GROUP BY 1, 2")
def evidence_types(spark, d):
    citations = O.cited(_detections(spark, d), ["label"]).withColumn("label", F.substring("label", 7, 10))
    return O.evidence_types(citations, _sections(spark, d), ["label"])


_ERRORS = "NULL INVALID_JSON KEYS DECISION REPEATED_IDS RATIONALE PRESENT_WITHOUT_EVIDENCE ABSENT_WITH_EVIDENCE NOT_AN_OBJECT EVIDENCE_IDS NULL NULL".split()


@query(
    "SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {n} THEN {e if e == 'NULL' else repr(e)}" for n, e in enumerate(_ERRORS)) + " END AS error, CASE WHEN event_id % 12 IN (0, 10, 11) THEN 'PRESENT' END AS decision FROM events"
)
def detection_answers(spark, d):
    """Answers written in twelve ways, valid, mendable and wrong, and what the validation says of each."""
    good = '{"decision": "PRESENT", "evidence_ids": ["E1"], "rationale": "r"}'
    answers = (
        good, '{"decision": ', '{"decision": "PRESENT", "evidence_ids": ["E1"]}', '{"decision": "MAYBE", "evidence_ids": [], "rationale": "r"}', '{"decision": "PRESENT", "evidence_ids": ["E1", "E1"], "rationale": "r"}',
        '{"decision": "PRESENT", "evidence_ids": ["E1"], "rationale": " "}', '{"decision": "PRESENT", "evidence_ids": [], "rationale": "r"}', '{"decision": "ABSENT", "evidence_ids": ["E1"], "rationale": "r"}', "[1]",
        '{"decision": "PRESENT", "evidence_ids": [1], "rationale": "r"}', f"```json\n{good}\n```", good.replace("}", ",}"),
    )
    raw = F.element_at(F.array(*[F.lit(a) for a in answers]), (F.col("event_id") % 12 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", O.detection_answer(raw).alias("a"))
    return rows.select("event_id", "a.error", F.when(F.col("a.error").isNull(), F.col("a.decision")).alias("decision"))


@query(
    """WITH t AS (SELECT event_id, user_id % 12 + 1 AS n, unnest(range(1, user_id % 12 + 2)) AS i, event_type FROM events), e AS (SELECT event_id, n, i, CASE WHEN (event_id + i) % 17 = 0 THEN 'LABEL_INVALID' WHEN (event_id + i) % 19 = 0 THEN 'DESCRIPTION_INVALID'
WHEN (event_id + i) % 37 = 0 THEN 'EVIDENCE_IDS_NOT_LIST' WHEN (event_id + i) % 23 = 0 THEN 'EVIDENCE_IDS_EMPTY' WHEN (event_id + i) % 31 = 0 THEN 'EVIDENCE_ID_NOT_STRING' WHEN (event_id + i) % 29 = 0 THEN 'EVIDENCE_IDS_DUPLICATED' END AS error FROM t),
g AS (SELECT event_id, CASE WHEN n > 10 THEN 'TOPIC_COUNT_EXCEEDS_LIMIT' ELSE first(error ORDER BY i) FILTER (error IS NOT NULL) END AS error, string_agg('E' || i, ',' ORDER BY i) AS evidence FROM e GROUP BY event_id, n)
SELECT event_id, error, CASE WHEN error IS NULL THEN evidence END AS evidence FROM g"""
)
def discovery_answers(spark, d):
    """Answers of one to twelve topics, some with something wrong, what the validation says and the second citation of each topic."""

    def topic(i):
        at = lambda k: (F.col("event_id") + i) % k == 0
        ids = (
            F.when(at(37), F.lit('"E0"')).when(at(23), F.lit("[]")).when(at(31), F.lit('["E0", 1]')).when(at(29), F.lit('["E0", "E0"]')).otherwise(F.concat(F.lit('["E0", "E'), i.cast("string"), F.lit('"]')))
        )
        label = F.when(at(17), " ").otherwise(F.concat("event_type", i.cast("string")))
        return F.concat(F.lit('{"label": "'), label, F.lit('", "short_description": '), F.when(at(19), "5").otherwise('"about it"'), F.lit(', "evidence_ids": '), ids, F.lit("}"))

    topics = F.transform(F.sequence(F.lit(1), F.col("user_id") % 12 + 1), topic)
    raw = F.concat(F.lit('{"topics": ['), F.array_join(topics, ", "), F.lit("]}"))
    rows = table(spark, d, "events").select("event_id", O.discovery_answer(raw).alias("a"))
    return rows.select("event_id", "a.error", F.array_join(F.transform("a.topics", lambda t: t["evidence_ids"][1]), ",").alias("evidence"))
