"""From files to messages in one call: recognition, records, issues, entities, possible duplicates, messages, conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..sources.raw import read_records
from ..sources.sniff import recognised
from . import messages as M
from . import records as R
from .duplicates import duplicate_candidates, with_duplicates
from .staging import kept

UNRESOLVED = "UNRESOLVED"


@dataclass(frozen=True)
class Ingested:
    """What an ingestion gives.

    files: path, size, kind, charset and transcript. records: normalised records of all sources. entities: candidates. messages: with participants, chat, place and duplicates.
    conversations: a row each. duplicates: candidates of duplicates.
    """

    files: DataFrame
    records: DataFrame
    entities: DataFrame
    messages: DataFrame
    conversations: DataFrame
    duplicates: DataFrame

    def summary(self) -> DataFrame:
        """Per file: kind, size, records, messages, auxiliary records, issues, conversations, and the status: SUCCESS, AUXILIARY_ONLY without messages, UNSUPPORTED of no kind."""
        counts = self.records.groupBy("file").agg(
            F.count("*").alias("n_records"), F.count_if(F.col("record_type") == "message").alias("n_messages"), F.sum(F.size("issues")).alias("n_issues"),
            F.count_distinct(F.when(F.col("record_type") == "message", chat_key(F.col("chat_id"), F.col("recipient.raw")))).alias("n_conversations"),
        )
        status = F.when(F.col("kind").isNull(), "UNSUPPORTED").when(F.col("n_messages") > 0, "SUCCESS").otherwise("AUXILIARY_ONLY")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_records", "n_messages", "n_issues", "n_conversations")]
        return self.files.join(counts, "file", "left").select("file", "kind", "size", *zero, (F.coalesce("n_records", F.lit(0)) - F.coalesce("n_messages", F.lit(0))).alias("n_auxiliary"), status.alias("status"))


def chat_key(chat_id: Column, peer: Column) -> Column:
    """What groups messages into conversations: the chat, else the recipient, else UNRESOLVED."""
    return F.coalesce(F.nullif(F.trim(chat_id), F.lit("")), F.concat(F.lit("peer:"), F.trim(peer)), F.lit(UNRESOLVED))


def document_id(source: Column, file: Column, key: Column) -> Column:
    """A conversation's identifier, which tells neither file nor chat in clear."""
    name = F.when(key == UNRESOLVED, "unresolved").otherwise(F.substring(F.sha2(key, 256), 1, 12))
    return F.concat_ws("::", F.lit("doc"), source, F.substring(F.sha2(file, 256), 1, 12), name)


def references(records: DataFrame) -> DataFrame:
    """(identifier, kind): the senders and recipients of records."""
    who = F.explode(F.array_compact(F.array("sender", "recipient"))).alias("a")
    return records.select(who).select(F.coalesce("a.phone", "a.raw").alias("identifier"), F.col("a.kind").alias("kind"))


def unified(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Messages of normalised records, with their participants by the candidates of their identifiers, chat, conversation, and place in it."""
    named = entities.groupBy("identifier").agg(F.min("candidate_id").alias("candidate_id"))
    rows = records.where("record_type = 'message'")
    for role in ("sender", "recipient"):
        known = named.select(F.col("identifier").alias(f"_{role}_id"), F.col("candidate_id").alias(f"_{role}_candidate"))
        rows = rows.withColumn(f"_{role}_id", F.coalesce(f"{role}.phone", f"{role}.raw")).join(known, f"_{role}_id", "left")
    p = lambda role: M.participant(F.col("source"), F.col("record_id"), F.lit(role), F.col(role), F.col(f"_{role}_candidate"))
    rows = rows.withColumns({"sender_participant": p("sender"), "recipient_participant": p("recipient"), "chat_key": chat_key(F.col("chat_id"), F.col("recipient.raw"))})
    rows = rows.withColumn("chat", M.chat(F.col("source"), F.col("chat_id"), F.col("sender_participant"), F.col("recipient_participant")))
    rows = rows.withColumn("document_id", document_id(F.col("source"), F.col("file"), F.col("chat_key")))
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy("place", "record_id"))
    return rows.select(
        "document_id", seq.cast("long").alias("seq"), F.concat_ws(":", F.lit("unified"), "source", "record_id").alias("message_id"), "source", "file", "record_id", "place", "stamp", "sender", "recipient",
        "sender_participant", "recipient_participant", "chat_key", "chat", "message_type", "deleted", "text", "media_reference", "issues",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """A row per conversation: messages, sections with text, participants, first and last known time, and the chat."""
    when = F.coalesce("stamp.utc", F.col("stamp.naive").cast("timestamp"))
    return messages.groupBy("document_id", "source", "file", "chat_key").agg(
        F.count("*").alias("n_messages"), F.count_if(has_text(F.col("text"))).alias("n_sections"), F.count_distinct("sender_participant.participant_id").alias("n_senders"),
        F.first("chat.chat_id", ignorenulls=True).alias("chat_id"), F.min(when).alias("first_time"), F.max(when).alias("last_time"),
    )


def from_records(raw: DataFrame, files: DataFrame) -> Ingested:
    """Everything that follows from raw records (sources.raw.COLUMNS). Records and messages are kept, so that each step reads the one before."""
    normal = kept(R.normalized_records(kept(raw)))
    found = R.candidate_entities(references(normal))
    entities = found.withColumn("identifier", F.explode(F.when(F.col("kind") == "jid", F.array("identifier", F.substring_index("identifier", "@", 1))).otherwise(F.array("identifier"))))
    told = kept(unified(normal, entities.select("identifier", "candidate_id")))
    candidates, members = duplicate_candidates(told.withColumn("seq", F.xxhash64("file", "place")).select(F.concat_ws("|", "file", "record_id").alias("record_id"), "seq", "source", "sender", "stamp", "message_type", "text"))
    marked = with_duplicates(told.withColumn("_own", F.col("record_id")).withColumn("record_id", F.concat_ws("|", "file", "_own")), members).withColumn("record_id", F.col("_own")).drop("_own")
    return Ingested(files, normal, found, marked, conversations(told), candidates)


def ingest(spark: SparkSession, path: str | list[str]) -> Ingested:
    """All sources below a path (or paths), whatever their names, as messages. Files of no kind are listed and left out.

    The list of files and kinds passes the driver, as Spark's own list of files does; each kind and charset is one read of all its files.
    """
    files = recognised(spark, path)
    groups: dict[tuple[str, str], list[str]] = {}
    for r in files.where("kind IS NOT NULL").collect():
        groups.setdefault((r.kind, r.charset or "utf-8"), []).append(r.file)
    raw = None
    for (kind, charset), paths in sorted(groups.items()):
        part = read_records(spark, kind, paths, charset)
        raw = part if raw is None else raw.unionByName(part)
    if raw is None:
        raw = spark.createDataFrame([], "source string, file string, place long, record_id string, record_type string, fields map<string,string>, media_reference string")
    return from_records(raw, files)


def ingest_stream(spark: SparkSession, folder: str, store, checkpoint: str, **read):
    """A streaming query that ingests the files which come into a folder into a store (sources.store.KeyedStore by file, source, record_id, record_type), each file once.

    An extension: the same operators over each micro-batch's new files. The stream reads names only as far as it must; a batch that runs again after a failure writes the same rows. Records
    are stored normalised; entities, conversations and duplicates follow from all of them (from_records).
    """
    names = spark.readStream.format("binaryFile").options(**read).schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(found: DataFrame, _: int) -> None:
        paths = [r.path for r in found.select("path").distinct().collect()]
        if paths:
            rows = ingest(spark, paths).records
            store.write(rows.select("file", "source", "record_id", "record_type", "place", F.to_json("fields").alias("fields"), "media_reference"))

    return names.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_records(store) -> DataFrame:
    """The raw records (sources.raw.COLUMNS) that ingest_stream() has stored, for from_records()."""
    return store.read().withColumn("fields", F.from_json("fields", "map<string,string>"))
