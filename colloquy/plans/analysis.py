"""Queries over provenance, translations, serialized conversations and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import exports as X
from ..operators import provenance as O
from ..operators import serialization as Z
from ..registry import query, table

# -- conversations as texts -------------------------------------------------------------------------


def _rows(spark, d):
    """Messages with text in parts of a hundred; every fifth turn is a transcript, every seventh stands for media."""
    rows = K.with_aliases(K.unified_messages(table(spark, d, "conversations")))
    part = F.floor((F.col("seq") - 1) / 100)
    rows = rows.withColumns({"part": part, "document": F.concat("chat_id", F.lit("::chunk::"), part.cast("string"))})
    return rows.withColumns(
        {
            "evidence_id": F.concat("message_id", F.lit("::ORIGINAL_TEXT")), "sender": F.col("role"), "source_name": F.lit("conversations"), "language": F.lit(None).cast("string"),
            "source_type": F.when(F.col("turn") % 5 == 4, "AUDIO_TRANSCRIPT").otherwise("ORIGINAL_TEXT"), "source_record_id": F.col("turn").cast("string"), "ordinal": F.lit(0),
            "text": F.when(F.col("turn") % 7 == 3, "<Media omessi>").otherwise(F.col("text")),
        }
    )


_TEXTS = r"""m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS seq FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS k FROM m WHERE regexp_matches(text, '\S')),
r AS (SELECT conv_id, seq, (seq - 1) // 100 AS part, 'E' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS alias, 'unified:conversations:' || conv_id || '-' || turn AS mid, role, turn,
CASE WHEN turn % 7 = 3 THEN '<Media omessi>' ELSE text END AS text, turn % 5 = 4 AS derived FROM s),
l AS (SELECT *, 'chat:conversations:' || conv_id || '::chunk::' || part AS doc,
'{"id": "' || alias || '", "msg_id": "' || mid || '", "sender": ' || to_json(role) || CASE WHEN derived THEN ', "source_type": "AUDIO_TRANSCRIPT"' WHEN text = '<Media omessi>' THEN ', "media_placeholder": true' ELSE '' END || ', "text": ' || to_json(text) || '}' AS line,
'    {' || chr(10) || '      "evidence_id": "' || mid || '::ORIGINAL_TEXT",' || chr(10) || '      "source_type": "' || CASE WHEN derived THEN 'AUDIO_TRANSCRIPT' ELSE 'ORIGINAL_TEXT' END || '",' || chr(10) || '      "message_id": "' || mid || '",' || chr(10)
|| '      "source_name": "conversations",' || chr(10) || '      "source_record_id": "' || turn || '",' || chr(10) || '      "language": null,' || chr(10) || '      "ordinal": 0,' || chr(10) || '      "text": ' || to_json(text) || chr(10) || '    }' AS item FROM r),
t AS (SELECT conv_id, part, count(*) AS n, count(DISTINCT mid) AS n_messages, '=== BEGIN FORENSIC EVIDENCE DATA (UNTRUSTED COMPACT JSONL) === (document_id: ' || doc || ')' || chr(10) || string_agg(line, chr(10) ORDER BY seq) || chr(10) || '=== END FORENSIC EVIDENCE DATA ===' AS compact,
'=== BEGIN FORENSIC EVIDENCE DATA (UNTRUSTED RAW JSON) ===' || chr(10) || '{' || chr(10) || '  "document_id": "' || doc || '",' || chr(10) || '  "strategy": "DIRECT_MULTILINGUAL",' || chr(10) || '  "total_bundles": ' || count(DISTINCT mid) || ',' || chr(10)
|| '  "total_evidence_sections": ' || count(*) || ',' || chr(10) || '  "evidence_sections": [' || chr(10) || string_agg(item, ',' || chr(10) ORDER BY seq) || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '=== END FORENSIC EVIDENCE DATA ===' AS "full" FROM l GROUP BY conv_id, part, doc)"""


@query(f'WITH {_TEXTS} SELECT conv_id, part, compact, "full" FROM t')
def serialized_conversations(spark, d):
    rows = _rows(spark, d)
    return Z.serialized(rows, ["conv_id", "part", "document"], F.col("document")).drop("document")


@query(
    f"""WITH {_TEXTS}, c AS (SELECT conv_id, part, n_messages AS total_messages, n AS total_sections, length("full") AS full_chars, length(compact) AS compact_chars FROM t),
e AS (SELECT *, ceil(full_chars / 2.8::DOUBLE)::BIGINT AS full_tokens, ceil(compact_chars / 2.8::DOUBLE)::BIGINT AS compact_tokens FROM c)
SELECT *, round((full_chars - compact_chars) / full_chars * 100, 2) AS chars_saved_percent, round((full_tokens - compact_tokens) / full_tokens * 100, 2) AS tokens_saved_percent FROM e"""
)
def serialization_savings(spark, d):
    """Told from sums of lengths here, from the texts themselves in the SQL."""
    rows = _rows(spark, d)
    return Z.savings(rows, ["conv_id", "part", "document"], F.col("document")).drop("document")


@query(
    f"""WITH {_TEXTS} SELECT conv_id, count(DISTINCT mid) AS n_messages, count(*) AS n_sections, sum(length(text))::BIGINT AS chars, bool_or(derived) AS multimodal, ceil(sum(length(text)) / 2.8::DOUBLE)::BIGINT AS tokens, max(part) + 1 AS n_chunks FROM r GROUP BY conv_id"""
)
def document_sizes(spark, d):
    rows = _rows(spark, d)
    return Z.document_sizes(rows, rows.select("conv_id", "seq", F.col("part").alias("chunk")), ["conv_id"])


@query(
    """SELECT o_orderkey, sha256('{"max_tokens": ' || o_custkey || ', "model_id": ' || to_json(o_orderpriority) || ', "profile": ' || coalesce(to_json(o_orderstatus)::VARCHAR, 'null') || ', "seed": ' || o_orderkey || '}') AS fingerprint FROM orders"""
)
def config_fingerprints(spark, d):
    settings = {"seed": F.col("o_orderkey"), "profile": F.col("o_orderstatus"), "model_id": F.col("o_orderpriority"), "max_tokens": F.col("o_custkey")}
    return table(spark, d, "orders").select("o_orderkey", Z.config_fingerprint(settings).alias("fingerprint"))


# -- translations and invariants --------------------------------------------------------------------


def _sections(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.col("lang").alias("message_id"), "text", F.col("lang").alias("source_name"))


def _translations(spark, d):
    """Upper case as the translation: none of every seventh document, blanks for others, some twice, and some of labelled documents elsewhere."""
    docs = table(spark, d, "documents").where("text is not null and doc_id % 7 <> 0")
    given = docs.select(F.col("source").alias("document_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.when(F.col("doc_id") % 7 == 1, " ").otherwise(F.upper("text")).alias("translated_text"), "doc_id")
    again = given.where("doc_id % 7 = 2")
    made_up = table(spark, d, "labels").select(F.lit("elsewhere").alias("document_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.lit("x").alias("translated_text"), "doc_id")
    return given.unionByName(again).unionByName(made_up).drop("doc_id")


_TRANSLATIONS = """s AS (SELECT source AS document_id, doc_id::VARCHAR AS evidence_id, lang AS message_id, text FROM documents WHERE text IS NOT NULL),
g AS (SELECT source AS document_id, doc_id::VARCHAR AS evidence_id, CASE WHEN doc_id % 7 = 1 THEN ' ' ELSE upper(text) END AS translated_text, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0),
tr AS (SELECT document_id, evidence_id, translated_text FROM g UNION ALL SELECT document_id, evidence_id, translated_text FROM g WHERE doc_id % 7 = 2 UNION ALL SELECT 'elsewhere', doc_id::VARCHAR, 'x' FROM labels)"""


@query(
    f"""WITH {_TRANSLATIONS} SELECT document_id, evidence_id, 'MISSING' AS error FROM s ANTI JOIN tr USING (document_id, evidence_id) UNION ALL
SELECT document_id, evidence_id, 'DUPLICATE' FROM tr SEMI JOIN s USING (document_id, evidence_id) GROUP BY ALL HAVING count(*) > 1 UNION ALL
SELECT DISTINCT document_id, evidence_id, 'UNKNOWN' FROM tr ANTI JOIN s USING (document_id, evidence_id) UNION ALL
SELECT document_id, evidence_id, 'EMPTY' FROM s JOIN tr USING (document_id, evidence_id) WHERE trim(text) <> '' AND trim(translated_text) = ''"""
)
def translation_errors(spark, d):
    return O.translation_errors(_sections(spark, d), _translations(spark, d))


@query(
    """WITH c AS (SELECT conv_id, turn, length(text || text) AS c FROM conversations WHERE text IS NOT NULL AND turn % 6 <> 5 UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE text IS NOT NULL AND turn % 6 = 5),
g AS (SELECT conv_id AS document_id, (turn // 2) AS message_id, bool_or(c IS NULL) AS missing, max(c) AS longest, sum(c)::BIGINT AS chars FROM c GROUP BY ALL)
SELECT document_id, message_id, CASE WHEN missing THEN 'MISSING' WHEN longest > 1000 THEN 'SECTION_TOO_LONG' ELSE 'MESSAGE_TOO_LONG' END AS error, chars FROM g WHERE missing OR longest > 1000 OR chars > 1000"""
)
def translated_size_errors(spark, d):
    """Two turns as a message, doubled texts as translations, none for every sixth turn, a thousand characters at most."""
    rows = table(spark, d, "conversations").where("text is not null")
    sections = rows.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("evidence_id"), F.floor(F.col("turn") / 2).alias("message_id"), "text")
    given = sections.where("evidence_id % 6 <> 5").select("document_id", "evidence_id", F.concat("text", "text").alias("translated_text"))
    return O.translated_size_errors(sections, given, 1000)


@query(
    """WITH x AS (SELECT doc_id, source, lang, n_chars FROM documents), e AS (SELECT lang AS document_id, n_chars AS evidence_id, count(*) AS k FROM x GROUP BY ALL)
SELECT lang AS document_id, 'SOURCES' AS error, 1::BIGINT AS n FROM x GROUP BY lang HAVING count(DISTINCT source) > 1 UNION ALL SELECT document_id, 'REPEATED_IDS', count(*) FILTER (k > 1) FROM e GROUP BY document_id HAVING max(k) > 1"""
)
def document_errors(spark, d):
    """Languages as documents, lengths as identifiers of evidence."""
    return O.document_errors(table(spark, d, "documents").select(F.col("lang").alias("document_id"), F.col("n_chars").alias("evidence_id"), F.col("source").alias("source_name")))


@query(
    """WITH m AS (SELECT doc_id AS message_id, source, lang FROM documents), r AS (SELECT doc_id + quality * (doc_id % 2) AS message_id, source, lang, CASE WHEN toxic = 1 THEN NULL ELSE doc_id END AS asset, quality FROM labels JOIN documents USING (doc_id))
SELECT message_id, error FROM (SELECT r.message_id, CASE WHEN m.message_id IS NULL THEN 'MESSAGE' WHEN r.source IS DISTINCT FROM m.source THEN 'SOURCE' WHEN r.lang IS DISTINCT FROM m.lang THEN 'RECORD'
WHEN quality = 1 AND asset IS DISTINCT FROM r.message_id THEN 'PROVENANCE' END AS error FROM r LEFT JOIN m ON m.message_id = r.message_id) WHERE error IS NOT NULL"""
)
def derived_errors(spark, d):
    """Results of labelled documents, those of good ones with odd numbers filed under the next number."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("source_record_id"))
    rows = table(spark, d, "labels").join(docs, "doc_id").select(
        (F.col("doc_id") + F.col("quality") * (F.col("doc_id") % 2)).alias("message_id"), "source_name", "source_record_id", F.when(F.col("quality") == 1, "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(F.col("toxic") != 1, F.col("doc_id")).alias("asset_message_id"),
    )
    return O.derived_errors(rows, docs.withColumnRenamed("doc_id", "message_id"))


# -- provenance -------------------------------------------------------------------------------------


@query(
    r"""WITH x AS (SELECT event_id, user_id % 5 AS chunks, event_id % 7 AS recovered, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 3 END AS micro, event_id % 2 AS computed,
CASE WHEN event_id % 3 = 0 THEN upper(sha256(event_type)) WHEN event_id % 3 = 1 THEN sha256('other') ELSE event_type END AS recorded, sha256(event_type) AS active, event_type FROM events)
SELECT event_id, CASE WHEN NOT regexp_full_match(recorded, '[0-9a-fA-F]{64}') THEN 'UNVERIFIABLE' WHEN lower(recorded) = active THEN 'MATCH' ELSE 'MISMATCH' END AS snapshot,
CASE WHEN chunks <= 0 THEN 'UNDETERMINED' WHEN recovered >= chunks THEN 'RESTORED_FROM_CHECKPOINT' WHEN recovered > 0 THEN 'MIXED' WHEN micro > 0 AND computed > 0 THEN 'MIXED' WHEN micro > 0 THEN 'RESTORED_FROM_CHECKPOINT' ELSE 'COMPUTED_THIS_RUN' END AS origin,
CASE WHEN event_type = 'click' OR computed = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS completeness FROM x"""
)
def run_states(spark, d):
    n, kind = F.col("event_id"), F.col("event_type")
    recorded = F.when(n % 3 == 0, F.upper(F.sha2(kind, 256))).when(n % 3 == 1, F.sha2(F.lit("other"), 256)).otherwise(kind)
    micro = F.when(kind != "error", F.col("user_id") % 3)
    status = F.when(kind == "click", "PARTIAL")
    return table(spark, d, "events").select(
        "event_id", O.snapshot_status(recorded, F.sha2(kind, 256)).alias("snapshot"), O.execution_origin(F.col("user_id") % 5, n % 7, micro, n % 2).alias("origin"),
        O.completeness(status, F.lit(None).cast("string"), n % 2 == 1).alias("completeness"),
    )


@query(
    """WITH t AS (SELECT doc_id, source AS document, CASE WHEN doc_id % 11 = 1 THEN ' ' WHEN doc_id % 11 = 2 THEN 'other' ELSE source END AS topic_document, CASE WHEN doc_id % 11 = 3 THEN NULL ELSE 'run' || lang END AS topic_run,
CASE WHEN doc_id % 11 = 4 THEN '' ELSE lang END AS label, n_chars FROM documents),
r AS (SELECT lang, 'run' || lang AS run_id, min(source) AS run_document, CASE WHEN lang = 'de' THEN 'SYNTHETIC_REFERENCE' WHEN lang = 'fr' THEN NULL ELSE 'LIVE' END AS origin FROM documents WHERE lang <> 'es' GROUP BY lang)
SELECT doc_id, CASE WHEN document IS NULL THEN 'NO_DOCUMENT' WHEN n_chars = 0 THEN 'NO_EVIDENCE' WHEN trim(coalesce(topic_document, '')) = '' THEN 'PROVENANCE_MISSING' WHEN topic_document <> document THEN 'DOCUMENT_MISMATCH' WHEN topic_run IS NULL THEN 'RUN_ID_MISSING'
WHEN trim(label) = '' THEN 'TOPIC_METADATA_INVALID' WHEN r.run_id IS NULL THEN 'DISCOVERY_RUN_UNAVAILABLE' WHEN run_document <> document THEN 'DOCUMENT_MISMATCH' WHEN origin IS NULL THEN 'ORIGIN_MISSING' WHEN origin = 'SYNTHETIC_REFERENCE' THEN 'SYNTHETIC_REFERENCE_ORIGIN'
WHEN doc_id % 2 = 0 THEN 'SNAPSHOT_MISMATCH' END AS block FROM t LEFT JOIN r ON r.run_id = t.topic_run"""
)
def verification_blocks(spark, d):
    """Topics of documents and a run per language, with what is missing or wrong in some of them."""
    docs, k = table(spark, d, "documents"), F.col("doc_id") % 11
    topics = docs.select(
        "doc_id", F.col("source").alias("document"), F.when(k == 1, " ").when(k == 2, "other").otherwise(F.col("source")).alias("topic_document"), F.when(k != 3, F.concat(F.lit("run"), "lang")).alias("topic_run"),
        F.when(k == 4, "").otherwise(F.col("lang")).alias("label"), F.col("n_chars"),
    )
    origin = F.when(F.col("lang") == "de", "SYNTHETIC_REFERENCE").when(F.col("lang") != "fr", "LIVE")
    runs = docs.where("lang <> 'es'").groupBy("lang").agg(F.min("source").alias("run_document")).select(F.concat(F.lit("run"), "lang").alias("run_id"), "run_document", origin.alias("origin"))
    c = F.col
    rows = topics.join(runs, c("topic_run") == c("run_id"), "left")
    topic = {"document_id": c("topic_document"), "run_id": c("topic_run"), "label": c("label"), "n_evidence": F.lit(1)}
    run = {"found": c("run_id").isNotNull(), "document_id": c("run_document"), "run_id": c("run_id"), "origin": c("origin")}
    snapshot = F.when(c("doc_id") % 2 == 0, "MISMATCH").otherwise("MATCH")
    return rows.select("doc_id", O.verification_block(c("document"), c("n_chars"), topic, run, snapshot).alias("block"))


@query(
    """WITH t AS (SELECT DISTINCT source AS document_id, lang, 'dtp_' || sha256(lang || chr(31) || source || chr(31) || 'about ' || lang || chr(31) || 'E1' || chr(31) || 'E2')[1:16] AS topic_uid FROM documents),
c AS (SELECT doc_id, toxic, t.* FROM labels JOIN documents USING (doc_id) JOIN t ON t.document_id = source AND t.lang = documents.lang)
SELECT doc_id, topic_uid FROM c WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 AND toxic <> 1"""
)
def verification_records(spark, d):
    """A topic per source and language; a record and a detection for each labelled document, some of them no verifications, blank or of other runs."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("document_id"), F.col("lang").alias("discovery_run_id"))
    ids = F.array(F.lit("E1"), F.lit("E2"))
    uid = O.topic_uid(F.col("discovery_run_id"), F.col("document_id"), F.concat(F.lit("about "), "discovery_run_id"), ids)
    topics = docs.select("document_id", "discovery_run_id").distinct().withColumn("topic_uid", uid)
    rows = table(spark, d, "labels").join(docs, "doc_id").withColumn("topic_uid", uid)
    results = rows.withColumn("detection_run_id", F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("doc_id").cast("string")))
    detections = rows.select(
        F.col("doc_id").cast("string").alias("run_id"), "document_id", F.when(F.col("toxic") == 1, "MANUAL_DETECTION").otherwise("DISCOVERY_VERIFICATION").alias("origin_flow"),
        F.when(F.col("doc_id") % 3 != 0, "another run").when(F.col("doc_id") % 2 == 0, F.col("discovery_run_id")).alias("verified_run_id"),
    )
    return O.verification_records(results, topics, detections).select("doc_id", "topic_uid")


# -- exports ----------------------------------------------------------------------------------------


@query(
    r"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'qwen' ELSE 'unknown' END AS family, CASE WHEN event_type = 'view' THEN NULL WHEN event_id % 2 = 0 THEN 'Q8_0' ELSE 'UNKNOWN' END AS quantization,
CASE WHEN event_id % 4 = 0 THEN 'E' || user_id WHEN event_id % 4 = 1 THEN 'E_UNKNOWN' ELSE 'ev_' || sha256('unified:' || user_id)[1:12] END AS evidence, CASE WHEN event_id % 5 = 0 THEN 'NOT_RECORDED' ELSE 'run_' || sha256('run ' || user_id)[1:12] END AS run,
CASE WHEN props IS NOT NULL THEN '[OSCURATO PER PRIVACY / REDACTED]' END AS text,
'detection_' || CASE WHEN user_id % 2 = 0 THEN 'syn_' || user_id ELSE 'chat_' || sha256('chat ' || user_id)[1:12] END || CASE WHEN event_type = 'view' THEN '_qwen_' ELSE '_mod_' || sha256(event_type)[1:12] || '_' END
|| CASE WHEN event_id % 5 = 0 THEN 'x_1' ELSE 'run_' || sha256('run ' || user_id)[1:12] END || strftime(ts, '_%Y%m%dT%H%M%S.json') AS file FROM events"""
)
def exported_values(spark, d):
    n, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    run = F.when(n % 5 == 0, " unknown ").otherwise(F.concat(F.lit("run "), user))
    evidence = F.when(n % 4 == 0, F.concat(F.lit(" E"), user)).when(n % 4 != 1, F.concat(F.lit("unified:"), user))
    dataset = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("syn_"), user)).otherwise(F.concat(F.lit("chat "), user))
    model = F.when(kind == "view", "qwen").otherwise(kind)
    return table(spark, d, "events").select(
        "event_id", X.shown(F.when(kind == "view", "Qwen "), "model_family").alias("family"), X.shown(F.when(kind != "view", F.when(n % 2 == 0, "q8_0").otherwise("q9")), "quantization").alias("quantization"),
        X.shown_evidence_id(evidence).alias("evidence"), X.shown_run_id(run).alias("run"), X.shown_text(F.col("props")).alias("text"),
        X.file_name(F.lit("topic_DETECTION"), dataset, model, run, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("x/1")).alias("file"),
    )


@query(
    """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 404 END AS status, CASE WHEN event_id % 5 = 4 THEN '' ELSE lower(CASE user_id % 6 WHEN 0 THEN 'Too many tokens' WHEN 1 THEN 'CUDA failed' WHEN 2 THEN 'bad json_schema' WHEN 3 THEN 'no model loaded' WHEN 4 THEN 'seed?' ELSE 'empty grammar' END) END AS m FROM events),
f AS (SELECT *, regexp_matches(m, 'empty grammar|grammar stack|llama_decode|stream returned an error') AS engine FROM x)
SELECT event_id, CASE WHEN status = 400 THEN CASE WHEN regexp_matches(m, 'context|n_ctx|too many tokens|exceed|window') THEN 'CONTEXT_OVERFLOW' WHEN engine OR regexp_matches(m, 'cuda|vram|memory|metal') THEN 'INFERENCE_BACKEND_ERROR'
WHEN regexp_matches(m, 'response_format|schema|grammar|structured output') THEN 'UNSUPPORTED_STRUCTURED_OUTPUT' WHEN regexp_matches(m, 'no model loaded|model not found|not loaded') THEN 'MODEL_NOT_LOADED'
WHEN regexp_matches(m, 'parameter|unknown field|temperature|max_tokens|seed|out of range') THEN 'INVALID_PARAMETER' ELSE 'UNCLASSIFIED_HTTP_ERROR' END
WHEN status = 429 THEN 'RATE_LIMIT_EXCEEDED' WHEN status = 503 AND engine THEN 'INFERENCE_BACKEND_ERROR' WHEN status = 503 THEN 'SERVER_ERROR' ELSE 'HTTP_ERROR' END AS category FROM f"""
)
def http_errors(spark, d):
    """Failed requests by status, with the message in five forms of a body; behind 200 characters of a text it isn't seen."""
    said = F.element_at(F.array(*[F.lit(m) for m in ("Too many tokens", "CUDA failed", "bad json_schema", "no model loaded", "seed?", "empty grammar")]), (F.col("user_id") % 6 + 1).cast("int"))
    status = F.element_at(F.array(*[F.lit(s) for s in (400, 429, 503, 404)]), (F.col("event_id") % 4 + 1).cast("int"))
    n = F.col("event_id") % 5
    body = F.when(n == 0, F.concat(F.lit('{"error": {"message": "'), said, F.lit('"}}'))).when(n == 1, F.concat(F.lit('{"error": "'), said, F.lit('"}'))).when(n == 2, said)
    body = body.when(n == 3, F.concat(F.lit('{"error": {}, "message": "'), said, F.lit('"}'))).otherwise(F.concat(F.repeat(F.lit("x"), F.lit(200)), said))
    return table(spark, d, "events").select("event_id", X.http_error(status, body).alias("category"))


@query(
    r"""WITH x AS (SELECT o_orderkey, o_orderkey % 4 AS k, sha256(o_orderkey::VARCHAR) AS h FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'NONE' WHEN 1 THEN 'TIMEOUT' ELSE 'UNKNOWN_ERROR' END AS category, CASE k WHEN 1 THEN 'inference' ELSE 'unknown' END AS phase, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'length' ELSE 'unknown' END AS finish,
CASE k WHEN 1 THEN 'PARTIAL' ELSE 'NOT_RECORDED' END AS status, CASE k WHEN 0 THEN left(h, 12) ELSE 'NOT_RECORDED' END AS commit, CASE k WHEN 0 THEN 'v1.' || o_orderkey || '.0-rc' ELSE '9.9' END AS version,
CASE k WHEN 0 THEN 'Qwen' WHEN 1 THEN 'mod_' || left(sha256('qwen/' || o_orderkey), 12) WHEN 2 THEN 'mod_unknown' ELSE 'mod_' || left(sha256('other'), 12) END AS model, CASE k WHEN 3 THEN NULL ELSE 'src_' || left(sha256('/home/' || o_orderkey), 12) END AS source FROM x"""
)
def exported_states(spark, d):
    """Categories, phases, reasons, commits, versions, models and sources as exports may show them."""
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    of = lambda known, other: F.when(k == 1, known).when(k > 1, other)
    commit = F.when(k == 0, F.substring(F.sha2(key, 256), 1, 12)).when(k == 1, F.lit("release_x")).when(k == 2, F.lit("abc12"))
    version = F.when(k == 0, F.concat(F.lit("v1."), key, F.lit(".0-rc"))).when(k == 1, "1.2-admin").when(k == 2, "one")
    model = F.when(k == 0, " Qwen").when(k == 1, F.concat(F.lit("qwen/"), key)).when(k == 2, " ").otherwise("other")
    return table(spark, d, "orders").select(
        "o_orderkey", X.shown(of(" timeout", "what the chat said"), "diagnostic_category").alias("category"), X.shown(of("Inference", "chat"), "failure_phase").alias("phase"), X.shown(of("LENGTH ", "odd"), "finish_reason").alias("finish"),
        X.shown(of("partial", "odd"), "execution_status").alias("status"), X.shown_commit(commit).alias("commit"), X.shown_version(version, "9.9").alias("version"), X.shown_model(model).alias("model"),
        X.shown_source(F.when(k != 3, F.concat(F.lit("/home/"), key))).alias("source"),
    )
