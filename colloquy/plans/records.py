"""Queries over raw records of all sources: issues, times, actors, types, duplicates and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from ..registry import query, table

_S = F.lit


def _raw(spark, d):
    """Raw records made of orders, by the rest of the key by twelve: six sources, each with a sound time and with a bad one."""
    k, good, cust = F.col("o_orderkey") % 6, F.col("o_orderkey") % 12 < 6, F.col("o_custkey").cast("string")
    jid = F.concat(_S("+39"), cust, _S("@s.whatsapp.net"))
    time = lambda x, bad: F.when(good, x).otherwise(bad)
    fields = (
        F.when(k == 0, F.create_map(_S("timestamp"), time(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"), _S("0")), _S("key_from_me"), _S("1"), _S("key_remote_jid"), jid, _S("data"), _S("hi"), _S("media_wa_type"), _S("1"), _S("deleted"), _S("0")))
        .when(k == 1, F.create_map(_S("jid"), time(jid, _S(" ")), _S("phone_number"), F.concat(_S("+39 000 "), cust), _S("status"), _S("busy")))
        .when(k == 2, F.create_map(_S("TimeStamp"), time(_S("2024-01-02 03:04:05"), _S("")), _S("From"), F.concat(_S("+39 (000) "), cust), _S("To"), _S("LOCAL_USER"), _S("Body"), _S(" "), _S("ChatId"), _S(" chat_x "), _S("MessageType"), _S(" Audio"), _S("Deleted"), _S("TRUE")))
        .when(k == 3, F.create_map(_S("timestamp"), time(_S("2024-01-02T03:04:05+02:00"), F.lit(None)), _S("sender"), _S("group_participant_A"), _S("chat_id"), _S("chat_7"), _S("type"), _S("image"), _S("text"), _S(""), _S("deleted"), _S("x")))
        .when(k == 4, F.create_map(_S("Timestamp"), time(_S("2024-01-02T03:04:05"), _S(" ")), _S("Sender"), _S("someone"), _S("Body"), _S("b"), _S("Deleted"), _S("false")))
        .otherwise(F.create_map(_S("raw_timestamp"), time(_S("1/2/24, 3:04 PM"), _S("‎ ")), _S("sender"), _S("chat_9"), _S("is_system"), time(_S("false"), _S("true")), _S("text"), _S(""), _S("attachment_name"), time(_S("a.opus"), F.lit(None))))
    )
    source = F.element_at(F.array(*map(_S, ("store", "contacts", "report_csv", "report_json", "report_xml", "export"))), (k + 1).cast("int"))
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", source.alias("source"), F.col("o_orderkey").cast("string").alias("record_id"), F.when(k == 1, "contact").otherwise("message").alias("record_type"), fields.alias("fields"))


@query(
    """WITH r AS (SELECT *, o_orderkey % 6 AS k, o_orderkey % 12 < 6 AS good FROM orders) SELECT o_orderkey,
CASE WHEN good THEN '' WHEN k = 0 THEN 'MSGSTORE_ANOMALOUS_TIMESTAMP' WHEN k = 1 THEN 'WA_DB_EMPTY_JID' WHEN k = 2 THEN 'CSV_EMPTY_TIMESTAMP' WHEN k = 3 THEN 'JSON_MISSING_TIMESTAMP' WHEN k = 4 THEN 'XML_EMPTY_TIMESTAMP' ELSE '' END AS codes,
CASE WHEN k = 1 OR NOT good THEN 'ABSENT' WHEN k IN (0, 3) THEN 'KNOWN_UTC' ELSE 'NAIVE_UNKNOWN' END AS status,
CASE WHEN NOT good OR k = 1 THEN NULL WHEN k = 0 THEN epoch_ms(o_orderdate) WHEN k = 3 THEN epoch_ms(TIMESTAMP '2024-01-02 01:04:05') WHEN k = 5 THEN epoch_ms(TIMESTAMP '2024-02-01 15:04:00') ELSE epoch_ms(TIMESTAMP '2024-01-02 03:04:05') END AS ms,
CASE k WHEN 0 THEN 'local_user' WHEN 1 THEN CASE WHEN good THEN 'jid' END WHEN 2 THEN 'phone' WHEN 3 THEN 'alias' WHEN 4 THEN 'unknown' ELSE CASE WHEN good THEN 'chat_id' END END AS sender,
CASE k WHEN 0 THEN 'jid' WHEN 2 THEN 'local_user' END AS recipient,
CASE k WHEN 0 THEN '+39' || o_custkey || '@s.whatsapp.net' WHEN 2 THEN 'chat_x' WHEN 3 THEN 'chat_7' WHEN 5 THEN 'chat_1' END AS chat_id,
CASE k WHEN 0 THEN 'IMAGE' WHEN 2 THEN 'AUDIO' WHEN 3 THEN 'IMAGE' WHEN 5 THEN CASE WHEN good THEN 'AUDIO' ELSE 'SYSTEM' END ELSE 'UNKNOWN' END AS message_type,
CASE k WHEN 0 THEN false WHEN 2 THEN true WHEN 4 THEN false END AS deleted, CASE k WHEN 0 THEN 'hi' WHEN 1 THEN 'busy' WHEN 3 THEN '' WHEN 4 THEN 'b' WHEN 5 THEN '' END AS text FROM r"""
)
def normalized_records(spark, d):
    rows = R.normalized_records(_raw(spark, d))
    return rows.select(
        "o_orderkey", F.array_join(F.transform("issues", lambda x: x["code"]), ",").alias("codes"), "stamp.status", F.unix_millis(F.coalesce("stamp.utc", F.col("stamp.naive").cast("timestamp"))).alias("ms"),
        F.col("sender.kind").alias("sender"), F.col("recipient.kind").alias("recipient"), "chat_id", "message_type", "deleted", "text",
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 5 THEN epoch_ms(date_trunc('second', o_orderdate)) WHEN 4 THEN CASE WHEN day(o_orderdate) <= 12 THEN epoch_ms(make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), hour(o_orderdate), minute(o_orderdate), 0))
ELSE epoch_ms(date_trunc('minute', o_orderdate)) END ELSE epoch_ms(date_trunc('minute', o_orderdate)) END AS ms FROM orders"""
)
def written_dates(spark, d):
    """Order dates written in seven ways, with direction marks and unbreakable blanks too, and one that is none; a month in front is taken for a day where it can be."""
    when, case = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 8
    told = lambda p: F.date_format(when, p)
    raw = (
        F.when(case == 0, told("d/M/yy, H:mm")).when(case == 1, F.concat(_S("[‎"), told("dd/MM/yyyy, h:mm"), _S(" "), told("a"), _S("]"))).when(case == 2, told("d.M.yyyy H:mm")).when(case == 3, told("yyyy/M/d, H:mm"))
        .when(case == 4, told("M/d/yyyy, H:mm")).when(case == 5, told("yyyy-MM-dd HH:mm:ss")).when(case == 6, F.concat(told("dd-MM-yyyy,"), _S(" "), told("HH:mm"))).otherwise(told("dd-MM-yyyy HH:mm 'PM'"))
    )
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(R.written_parsed(raw)["naive"].cast("timestamp")).alias("ms"))


@query(
    """WITH x AS (SELECT o_orderkey, o_orderkey // 4 AS g, o_orderkey % 4 AS k, (o_orderkey // 4) % 3 AS form FROM orders), y AS (SELECT *, CASE WHEN form = 0 THEN 0 WHEN form = 1 THEN k % 2 ELSE CASE WHEN k = 3 THEN 1 ELSE 0 END END AS cluster FROM x),
c AS (SELECT g, form, cluster, min(g * 4) AS gs, count(*) AS n_records, count(DISTINCT k % 2) AS n_sources FROM y GROUP BY 1, 2, 3 HAVING count(*) > 1),
s AS (SELECT g, min(o_orderkey) AS group_seq FROM x GROUP BY g)
SELECT 'duplicate_candidate:' || row_number() OVER (ORDER BY group_seq, cluster) AS candidate_id, n_records, n_sources, CASE WHEN form = 0 AND n_sources > 1 THEN 'STRONG' ELSE 'WEAK' END AS confidence FROM c JOIN s USING (g)"""
)
def duplicate_candidates(spark, d):
    """Orders in groups of four as messages: all of one phone in two sources; of two phones by turns, each in its source; and one phone with an unknown sender, against another phone."""
    key = F.col("o_orderkey")
    group, k, form = F.expr("o_orderkey div 4"), key % 4, F.expr("(o_orderkey div 4) % 3")
    raw = F.when(form == 0, "+39 11111").when(form == 1, F.when(k % 2 == 0, "+39 11111").otherwise("+39 22222")).otherwise(F.when(k == 3, "+39 33333").when(k == 1, "someone").otherwise("+39 11111"))
    stamp = R.from_milliseconds(group + 1)
    rows = table(spark, d, "orders").select(
        key.cast("string").alias("record_id"), key.alias("seq"), F.when(k % 2 == 0, "store").otherwise("report_csv").alias("source"), R.actor(raw).alias("sender"), stamp.alias("stamp"), F.lit("TEXT").alias("message_type"),
        F.concat(F.lit(" text "), group.cast("string")).alias("text"),
    )
    return R.duplicate_candidates(rows)[0]


@query(
    """WITH t AS (SELECT p_partkey, p_name, p_size, p_partkey % 9000 AS context, length(p_name) AS n, len(string_split(trim(p_name), ' ')) AS w FROM part),
u AS (SELECT *, 32 + greatest(64, ceil(n / 3.0) + 16)::BIGINT + 6 + ceil(4 / 3.0)::BIGINT + (greatest(ceil(n / 2.8::DOUBLE), ceil(w * 1.35::DOUBLE)) + 4)::BIGINT AS used FROM t), r AS (SELECT *, context - 3028 AS room FROM u)
SELECT p_partkey, used, used + 1500 + 1000 AS needed, greatest(0, context - used - 1000) AS headroom, used + 2500 <= context AS fits,
CASE WHEN greatest(0, context - used - 1000) < 512 THEN 0 ELSE least(greatest(0, context - used - 1000), greatest(512, p_size * 40)) END::BIGINT AS output,
CASE WHEN room < 256 THEN NULL WHEN p_partkey % 3 = 0 AND room >= 5200 THEN 'PERFORMANCE' WHEN p_partkey % 3 = 1 AND room >= 2500 THEN 'PRUDENT' WHEN room >= 4200 THEN 'BALANCED' ELSE 'PRUDENT' END AS profile,
CASE WHEN room < 256 THEN NULL WHEN p_partkey % 3 = 0 AND room >= 5200 THEN 5200 WHEN p_partkey % 3 = 1 AND room >= 2500 THEN 2500 WHEN room >= 4200 THEN 4200 WHEN room >= 2500 THEN 2500 ELSE room END::BIGINT AS tokens FROM r"""
)
def token_budgets(spark, d):
    """A request for each part, within contexts of many sizes, and the profile that there is room for."""
    context, used = F.col("p_partkey") % 9000, T.request_tokens([(F.lit("user"), F.col("p_name"))], F.col("p_name"))
    profile = F.element_at(F.array(*map(_S, (" performance", "PRUDENT", "other"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", "p_size", context.alias("context"), used.alias("used"), profile.alias("asked"))
    rows = rows.withColumn("b", T.budget_plan(F.col("context"), F.col("used"), F.lit(1500), F.lit(1000))).withColumn("p", T.effective_profile(F.col("asked"), F.col("context")))
    return rows.select("p_partkey", "used", "b.needed", "b.headroom", "b.fits", T.output_budget(F.col("context"), F.col("used"), F.col("p_size") * 40).alias("output"), "p.profile", "p.tokens")
