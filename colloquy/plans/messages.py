"""Queries over messages: actors, types, participants, chats, media and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import messages as M
from ..operators import records as R
from ..registry import query, table

_KIND = "CASE WHEN x IS NULL THEN NULL WHEN x = 'LOCAL_USER' THEN 'local_user' WHEN contains(x, '@') THEN 'jid' ELSE 'phone' END"
_STORE = """s AS (SELECT o_orderkey, o_orderkey % 3 AS from_me, CASE WHEN o_orderkey % 7 = 0 THEN 'g' || o_custkey || '@g.us' ELSE '+39000' || o_custkey || '@s.whatsapp.net' END AS remote,
CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN '+39111' || o_custkey END AS resource FROM orders)"""


def _store(spark, d):
    key, custkey = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return table(spark, d, "orders").select(
        "o_orderkey", (key % 3).alias("from_me"), F.when(key % 7 == 0, F.concat(F.lit("g"), custkey, F.lit("@g.us"))).otherwise(F.concat(F.lit("+39000"), custkey, F.lit("@s.whatsapp.net"))).alias("remote"),
        F.when((key % 7 == 0) & (key % 2 == 0), F.concat(F.lit("+39111"), custkey)).alias("resource"),
    )


@query(
    f"""WITH {_STORE}, a AS (SELECT o_orderkey, CASE WHEN from_me = 1 THEN 'LOCAL_USER' WHEN from_me = 0 AND resource IS NOT NULL THEN resource WHEN from_me = 0 AND NOT contains(remote, '@g.us') THEN remote END AS sender,
CASE WHEN from_me = 0 THEN 'LOCAL_USER' WHEN from_me = 1 AND NOT contains(remote, '@g.us') THEN remote END AS recipient FROM s)
SELECT o_orderkey, sender, {_KIND.replace("x", "sender")} AS sender_kind, recipient, {_KIND.replace("x", "recipient")} AS recipient_kind FROM a"""
)
def directed_actors(spark, d):
    rows = _store(spark, d).select("o_orderkey", M.directed_actors(F.col("from_me"), F.col("remote"), F.col("resource")).alias("a"))
    return rows.select("o_orderkey", F.col("a.sender.raw").alias("sender"), F.col("a.sender.kind").alias("sender_kind"), F.col("a.recipient.raw").alias("recipient"), F.col("a.recipient.kind").alias("recipient_kind"))


@query(
    f"""WITH {_STORE}, a AS (SELECT o_orderkey, remote, CASE WHEN from_me = 1 THEN 'LOCAL_USER' WHEN from_me = 0 AND resource IS NOT NULL THEN resource WHEN from_me = 0 AND NOT contains(remote, '@g.us') THEN remote END AS sender FROM s),
c AS (SELECT '+39000' || c_custkey || '@s.whatsapp.net' AS identifier, 'entity:jid:' || c_custkey AS candidate_id FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, CASE WHEN sender = 'LOCAL_USER' THEN 'participant:local_user:LOCAL_USER' WHEN sender IS NOT NULL AND o_orderkey % 9 = 0 THEN 'participant:entity:reference:2' WHEN candidate_id IS NOT NULL THEN 'participant:' || candidate_id
WHEN sender IS NOT NULL THEN 'participant:unresolved:store:' || o_orderkey || ':sender' END AS participant_id,
'chat:store:' || remote AS chat_id, CASE WHEN contains(remote, '@g.us') THEN 'group' ELSE 'direct' END AS kind FROM a LEFT JOIN c ON c.identifier = a.sender"""
)
def participants_and_chats(spark, d):
    """Senders by reference, else by identifier; each record's chat."""
    rows = _store(spark, d).withColumn("a", M.directed_actors(F.col("from_me"), F.col("remote"), F.col("resource")))
    records = rows.select(F.lit("store").alias("source_name"), F.col("o_orderkey").cast("string").alias("record_id"), F.lit("sender").alias("role"), F.col("a.sender").alias("actor"), "o_orderkey", "remote")
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    references = records.where("o_orderkey % 9 = 0").select("source_name", "record_id", "role", twice).withColumn("candidate_id", F.concat(F.lit("entity:reference:"), F.col("seq").cast("string")))
    custkey = F.col("c_custkey").cast("string")
    identifiers = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("+39000"), custkey, F.lit("@s.whatsapp.net")).alias("identifier"), F.concat(F.lit("entity:jid:"), custkey).alias("candidate_id"))
    c = F.col
    found = M.with_candidates(records, references, identifiers).withColumn("p", M.participant(c("source_name"), c("record_id"), c("role"), c("actor"), c("candidate_id")))
    none = F.lit(None).cast(found.schema["p"].dataType)
    return found.withColumn("c", M.chat(c("source_name"), c("remote"), c("p"), none)).select("o_orderkey", "p.participant_id", "c.chat_id", "c.kind")


@query(
    """WITH r AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL ELSE l_returnflag || '.jpg' END AS path, l_linenumber AS seq FROM lineitem WHERE l_orderkey % 4 > 0),
g AS (SELECT l_orderkey, count(DISTINCT path) + max((path IS NULL)::INT) AS n, arg_min(coalesce(path, ''), seq) AS first FROM r GROUP BY l_orderkey)
SELECT o_orderkey AS record_id, CASE WHEN n IS NULL THEN 'NO_REFERENCE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN first = '' THEN 'MISSING' ELSE 'REFERENCED' END AS media_state, CASE WHEN n = 1 AND first <> '' THEN first END AS media_path
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""
)
def media_references(spark, d):
    path = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1), F.lit(None)).otherwise(F.concat("l_returnflag", F.lit(".jpg")))
    refs = table(spark, d, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("record_id"), path.alias("file_path"), F.col("l_linenumber").alias("seq"))
    return M.with_media(table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id")), refs)


@query(
    """WITH m AS (SELECT DISTINCT p_brand || '/' || (p_partkey % 150) || '.pdf' AS member FROM part), b AS (SELECT split_part(member, '/', 2) AS base, count(*) AS n, min(member) AS one FROM m GROUP BY 1),
a AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_brand || '/' || (p_partkey % 150) || '.pdf' WHEN 2 THEN (p_partkey % 150) || '.pdf' WHEN 3 THEN '../' || (p_partkey % 150) || '.pdf' ELSE 'none.pdf' END AS name FROM part)
SELECT p_partkey, name, CASE WHEN name IS NULL THEN 'NO_REFERENCE' WHEN name LIKE '../%' THEN 'OUTSIDE' WHEN m.member IS NOT NULL OR n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS state,
CASE WHEN name LIKE '../%' THEN NULL WHEN m.member IS NOT NULL THEN name WHEN n = 1 THEN one END AS member FROM a LEFT JOIN m ON m.member = a.name LEFT JOIN b ON b.base = regexp_extract(name, '[^/]*$')"""
)
def attachment_members(spark, d):
    part, number = table(spark, d, "part"), F.concat((F.col("p_partkey") % 150).cast("string"), F.lit(".pdf"))
    full, case = F.concat("p_brand", F.lit("/"), number), F.col("p_partkey") % 5
    name = F.when(case == 0, F.lit(None)).when(case == 1, full).when(case == 2, number).when(case == 3, F.concat(F.lit("../"), number)).otherwise("none.pdf")
    return M.with_members(part.select("p_partkey", name.alias("name")), part.select(full.alias("member"))).select("p_partkey", "name", "state", "member")


@query(
    """WITH r AS (SELECT event_id % 8 AS k FROM events), s AS (SELECT CASE WHEN k = 0 THEN 'AUDIO_NOT_FOUND' WHEN k = 1 THEN 'STT_NOT_RUN' WHEN k = 2 THEN 'TRANSCRIBED' WHEN k = 3 THEN 'TRANSCRIBED_EMPTY' WHEN k = 4 THEN 'STT_UNAVAILABLE' WHEN k = 5 THEN 'TRANSCRIPTION_FAILED' END AS state FROM r)
SELECT state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY state"""
)
def audio_states(spark, d):
    k = F.col("event_id") % 8
    rows = table(spark, d, "events").select(
        F.when(k == 0, "AUDIO").otherwise("TEXT").alias("kind"), F.when(k == 1, "a.OPUS").when(k == 6, "a.jpg").alias("reference"), F.when(k.isin(2, 3), "SUCCESS").when(k.isin(4, 5), "FAILED").alias("status"),
        F.when(k == 4, "STT_UNAVAILABLE").alias("reason"), F.when(k == 2, "words").when(k == 3, " ").alias("text"),
    )
    return M.state_counts(rows.select(M.audio_state(*[F.col(c) for c in ("kind", "reference", "status", "reason", "text")]).alias("s")), "s", M.AUDIO_STATES)


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'IMAGE' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'VIDEO' WHEN 3 THEN 'SYSTEM' WHEN 4 THEN 'OTHER' ELSE 'UNKNOWN' END AS message_type FROM events"""
)
def message_types(spark, d):
    k = F.col("event_id") % 6
    rows = table(spark, d, "events").select(
        "event_id", F.when(k == 0, "store").when(k == 1, "store").when(k == 2, "report_csv").when(k == 5, "report_xml").otherwise("export").alias("source"),
        F.when(k == 5, "message").when(k == 1, "chat").otherwise("message").alias("record_type"), F.when(k < 2, "1").when(k == 2, " Video ").alias("raw"), F.when(k == 4, "a.pdf").alias("attachment"), (k == 3).alias("system"),
    )
    return rows.select("event_id", M.message_type(*[F.col(c) for c in ("source", "record_type", "raw", "attachment", "system")]).alias("message_type"))


@query("SELECT lang AS chat_key, row_number() OVER (ORDER BY lang = 'UNRESOLVED', lang) AS number FROM (SELECT DISTINCT CASE WHEN lang = 'de' THEN 'UNRESOLVED' ELSE lang END AS lang FROM documents)")
def conversation_numbers(spark, d):
    rows = table(spark, d, "documents").select(F.when(F.col("lang") == "de", "UNRESOLVED").otherwise(F.col("lang")).alias("chat_key"))
    return M.conversation_numbers(rows, "chat_key")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark, d):
    return M.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) > count(*) OVER (PARTITION BY conv_id) // 2)::INT AS half FROM conversations")
def conversation_halves(spark, d):
    return M.halves(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query(
    """WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1), n AS (SELECT event_type, row_number() OVER (ORDER BY first) AS k FROM f)
SELECT event_id, event_type, 'SENDER_' || lpad(k::VARCHAR, 3, '0') AS token FROM events JOIN n USING (event_type)"""
)
def sequential_tokens(spark, d):
    return M.anonymised(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(
    """SELECT source AS source_name, count(*) AS n_records, count(*) FILTER (doc_id % 5 > 0) AS n_messages, count(*) FILTER (doc_id % 5 = 0) AS n_auxiliary, count(*) FILTER (length(text) < 100)::BIGINT AS n_issues FROM documents GROUP BY source"""
)
def ingestion_summary(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("source_name"), F.when(F.col("doc_id") % 5 > 0, "message").otherwise("chat").alias("record_type"), R.issues({"SHORT": ("INFO", F.length("text") < 100)}).alias("issues")
    )
    return M.ingestion_summary(rows)


@query()
def substantive_messages(spark, d):
    """Which turns say anything; word classes and look-ups of the greeting test are checked on a small fixture."""
    return M.substantive(table(spark, d, "conversations"), ["conv_id", "turn"])


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ALIAS_FORMAT_NOT_IN_BLOCK' WHEN 1 THEN 'NUMERIC_ONLY' WHEN 2 THEN 'FORENSIC_ID_NOT_IN_BLOCK' ELSE 'OTHER' END AS shape,
CASE WHEN c_custkey % 4 = 0 THEN 'E' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') ELSE 'ev_' || left(sha256(CASE c_custkey % 4 WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN 'unified:' || c_custkey ELSE c_name END), 12) END AS redacted FROM customer"""
)
def citation_shapes(spark, d):
    key, case = F.col("c_custkey"), F.col("c_custkey") % 4
    id = F.when(case == 0, F.concat(F.lit("E"), F.lpad((key % 1000).cast("string"), 3, "0"))).when(case == 1, key.cast("string")).when(case == 2, F.concat(F.lit("unified:"), key.cast("string"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.citation_shape(id).alias("shape"), T.redacted_id(id).alias("redacted"))
