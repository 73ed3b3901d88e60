"""Queries that write tables as sources write them, and read them back through recognition and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ingestion import ingest
from ..operators.staging import shared_folder
from ..registry import query, table
from ..sources.raw import read_records

#: Lines of a text without blanks around them; the same in SQL.
_PLAIN = r"[\x00-\x20]*[\r\n][\x00-\x20]*"
_TURNS = rf"""t AS (SELECT conv_id % 8 AS part, conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '{_PLAIN}', chr(10), 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text FROM conversations),
n AS (SELECT *, row_number() OVER w AS n, 1 + length(text) - length(replace(text, chr(10), '')) AS height FROM t WINDOW w AS (PARTITION BY part ORDER BY conv_id, turn, role, text)),
p AS (SELECT *, (1 + coalesce(sum(height) OVER (PARTITION BY part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line FROM n)"""


def _turns(spark, d):
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, "\n"), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 8).alias("part"), "conv_id", "turn", "role", text.alias("text"))
    return rows.repartition(8, "part").sortWithinPartitions("part", "conv_id", "turn", "role", "text")


@query(
    rf"""WITH {_TURNS} SELECT 'part=' || part AS file, 'unified:export:msg_' || n AS message_id, n AS seq, line AS place, CASE WHEN text = '' THEN NULL ELSE role END AS sender, CASE WHEN text = '' THEN role || ':' ELSE text END AS text,
epoch_ms(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (turn % 1440)) AS ms, CASE WHEN text = '' THEN 'SYSTEM' ELSE 'TEXT' END AS message_type, 'chat:export:chat_1' AS chat FROM p"""
)
def ingested_exports(spark, d):
    """Conversations written as eight chat exports, recognised and read back as messages."""
    when = F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + (F.col("turn") % 1440) * 60_000), "dd/MM/yyyy, HH:mm")
    folder = shared_folder(spark, "exports")
    _turns(spark, d).select("part", F.concat(when, F.lit(" - "), "role", F.lit(": "), "text").alias("value")).write.partitionBy("part").text(folder)
    rows = ingest(spark, folder).messages
    return rows.select(
        F.regexp_extract("file", "(part=[0-9])", 1).alias("file"), "message_id", "seq", "place", F.col("sender.raw").alias("sender"), "text", F.unix_millis(F.col("stamp.naive").cast("timestamp")).alias("ms"), "message_type",
        F.col("chat.chat_id").alias("chat"),
    )


@query(
    rf"""WITH {_TURNS} SELECT 'part=' || part AS file, line + 1 AS place, 'row:' || (line + 1) AS record_id, role AS sender, '"' || text || '",x' AS text, turn::VARCHAR AS chat FROM p"""
)
def report_rows(spark, d):
    """Conversations written as CSV reports, their texts in quotes within cells of several lines, and read back with the physical line of each row."""
    body = F.concat(F.lit('"'), "text", F.lit('",x'))
    columns = [F.lit("x").alias("Source"), F.lit("Text").alias("MessageType"), F.lit("").alias("TimeStamp"), F.lit("In").alias("Direction"), F.col("turn").alias("ChatId"), F.col("role").alias("From"), body.alias("Body")]
    folder = shared_folder(spark, "reports")
    _turns(spark, d).select("part", *columns).write.partitionBy("part").option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    rows = read_records(spark, "report_csv", [f"{folder}/part={n}" for n in range(8)])
    field = lambda name: F.element_at("fields", F.lit(name))
    return rows.select(F.regexp_extract("file", "(part=[0-9])", 1).alias("file"), "place", "record_id", field("From").alias("sender"), field("Body").alias("text"), field("ChatId").alias("chat"))
