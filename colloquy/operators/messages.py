"""Messages from records: actors and types per source, participants, chats, media references, attachments and their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, is_media_placeholder, is_greeting
from .records import actor

#: Extensions by kind of attachment.
IMAGES, AUDIO, VIDEO = ("jpg", "jpeg", "png", "webp", "gif"), ("opus", "mp3", "wav", "ogg", "m4a", "aac"), ("mp4", "3gp", "mov", "mkv", "avi", "3gpp")
AUDIO_STATES = ("AUDIO_NOT_FOUND", "STT_NOT_RUN", "STT_UNAVAILABLE", "TRANSCRIPTION_FAILED", "TRANSCRIBED_EMPTY", "TRANSCRIBED")
IMAGE_STATES = ("IMAGE_NOT_FOUND", "OCR_NOT_RUN", "OCR_UNAVAILABLE", "OCR_FAILED", "OCR_NO_TEXT", "OCR_TEXT_EXTRACTED")


def directed_actors(from_me: Column, remote: Column, resource: Column) -> Column:
    """{sender, recipient} of a message store's row: 1 is sent by the local user, 0 received, anything else tells nothing."""
    group = F.coalesce(F.contains(remote, F.lit("@g.us")), F.lit(False))
    peer, me = F.when(~group, actor(remote)), actor(F.lit("LOCAL_USER"))
    return F.struct(
        F.when(from_me == 1, me).when((from_me == 0) & has_text(resource), actor(resource)).when(from_me == 0, peer).alias("sender"),
        F.when(from_me == 1, peer).when(from_me == 0, me).alias("recipient"),
    )


def message_type(source: Column, record_type: Column, raw: Column, attachment: Column, system: Column) -> Column:
    """The canonical type: by number in a message store, by name in reports, by extension in chat exports, else UNKNOWN."""
    name = F.upper(F.trim(raw))
    named = F.when(name.isin("TEXT", "IMAGE", "AUDIO", "VIDEO"), name).otherwise("UNKNOWN")
    number = F.when(raw == "0", "TEXT").when(raw == "1", "IMAGE").when(raw == "2", "AUDIO").when(raw == "3", "VIDEO").otherwise("UNKNOWN")
    ext = F.lower(F.regexp_extract(attachment, r"\.([^./\\]+)$", 1))
    export = (
        F.when(F.coalesce(system, F.lit(False)), "SYSTEM").when(F.coalesce(attachment, F.lit("")) == "", "TEXT")
        .when(ext.isin(*IMAGES), "IMAGE").when(ext.isin(*AUDIO), "AUDIO").when(ext.isin(*VIDEO), "VIDEO").otherwise("OTHER")
    )
    return (
        F.when(F.coalesce(record_type, F.lit("")) != "message", "UNKNOWN").when(source == "store", number).when(source.isin("report_csv", "report_json"), named)
        .when(source == "export", export).otherwise("UNKNOWN")
    )


def text_content(source: Column, text: Column) -> Column:
    """Blank texts of CSV and XML reports are null; other sources keep theirs."""
    return F.when(source.isin("report_csv", "report_xml") & ~has_text(text), F.lit(None)).otherwise(text)


def chat_identifier(source: Column, raw: Column) -> Column:
    """The trimmed identifier; chat_1 for an export without one; null for XML reports."""
    return F.when(source != "report_xml", F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.when(source == "export", F.lit("chat_1"))))


def with_candidates(records: DataFrame, references: DataFrame, identifiers: DataFrame) -> DataFrame:
    """records (source_name, record_id, role, actor) with candidate_id, by reference and else by identifier.

    references: (source_name, record_id, role, candidate_id, seq), of which the last one holds. identifiers:
    (identifier, candidate_id). Both are equi-joins on keys reduced before the shuffle; no record is lost or doubled.
    """
    keys = ["source_name", "record_id", "role"]
    last = references.groupBy(*keys).agg(F.max_by("candidate_id", "seq").alias("by_reference"))
    known = identifiers.groupBy("identifier").agg(F.min("candidate_id").alias("by_identifier"))
    rows = records.join(last, keys, "left").withColumn("identifier", F.coalesce("actor.phone", "actor.raw"))
    return rows.join(known, "identifier", "left").withColumn("candidate_id", F.coalesce("by_reference", "by_identifier")).drop("by_reference", "by_identifier")


def participant(source: Column, record: Column, role: Column, who: Column, candidate: Column) -> Column:
    """{participant_id, identifier, resolved, is_local_user} of an actor: the local user first, then groups, candidates, and what stays unresolved."""
    local, group = who["kind"] == "local_user", (who["kind"] == "jid") & who["raw"].endswith("@g.us")
    name = (
        F.when(local, F.lit("participant:local_user:LOCAL_USER")).when(group, F.concat(F.lit("participant:group:"), who["raw"]))
        .when(candidate.isNotNull(), F.concat(F.lit("participant:"), candidate)).otherwise(F.concat_ws(":", F.lit("participant:unresolved"), source, record, role))
    )
    return F.when(
        who.isNotNull(), F.struct(name.alias("participant_id"), F.coalesce(who["phone"], who["raw"]).alias("identifier"), (local | group | candidate.isNotNull()).alias("resolved"), local.alias("is_local_user"))
    )


def chat(source: Column, chat_id: Column, sender: Column, recipient: Column) -> Column:
    """{chat_id, kind, participants} from participants; a chat with the recipient where no identifier is given; null without either."""
    raw, peer = F.trim(chat_id), recipient["identifier"]
    named, by_peer = has_text(chat_id), recipient.isNotNull()
    kind = (
        F.when(named & F.contains(raw, F.lit("@g.us")), "group").when(named & F.contains(raw, F.lit("@s.whatsapp.net")), "direct").when(named, "unknown")
        .when(peer.endswith("@s.whatsapp.net"), "direct").otherwise("unknown")
    )
    id = F.when(named, F.concat(F.lit("chat:"), source, F.lit(":"), raw)).otherwise(F.concat(F.lit("chat:"), source, F.lit(":peer:"), peer))
    members = F.array_distinct(F.array_compact(F.array(sender["participant_id"], recipient["participant_id"])))
    return F.when(named | by_peer, F.struct(id.alias("chat_id"), kind.alias("kind"), members.alias("participants")))


def with_titles(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """messages with the title of their raw chat identifier, the first by seq that isn't blank."""
    titles = chats.where(has_text(F.col("title"))).groupBy("raw_chat_id").agg(F.min_by("title", "seq").alias("title"))
    return messages.join(titles, "raw_chat_id", "left")


def contact_names(entities: DataFrame, contacts: DataFrame) -> DataFrame:
    """entities (identifier) with the sorted display names of contacts (jid, phone, display_name) of that JID or phone."""
    by = contacts.select(F.explode(F.array_compact(F.array("jid", "phone"))).alias("identifier"), F.trim("display_name").alias("name")).where(has_text(F.col("name")))
    return entities.join(by.groupBy("identifier").agg(F.array_sort(F.collect_set("name")).alias("names")), "identifier", "left")


def with_media(messages: DataFrame, references: DataFrame) -> DataFrame:
    """messages (record_id) with the path of their media references (record_id, file_path, seq); several different paths, null included, are ambiguous."""
    path = F.col("file_path")
    one = references.groupBy("record_id").agg(
        F.count("*").alias("n_references"), (F.count_distinct(path) + F.max(path.isNull().cast("int"))).alias("n_paths"), F.min_by(F.struct("file_path"), "seq").alias("first")
    )
    state = F.when(F.col("n_references").isNull(), "NO_REFERENCE").when(F.col("n_paths") > 1, "AMBIGUOUS").when(~has_text(F.col("first.file_path")), "MISSING").otherwise("REFERENCED")
    out = messages.join(one, "record_id", "left").withColumn("media_state", state)
    return out.withColumn("media_path", F.when(F.col("media_state") == "REFERENCED", F.col("first.file_path"))).drop("n_references", "n_paths", "first")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def safe_member(path: Column) -> Column:
    """Whether an archive member's name stays inside: not blank, absolute, a drive or home, and without . or .. as a part."""
    return has_text(path) & ~path.rlike(r"^([/\\~]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.{1,2}([/\\]|$)")


def with_members(attachments: DataFrame, members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """attachments (keys, name) with the archive member (keys, member) of that full name, else of that base name if only one has it. keys tell archives apart.

    state: NO_REFERENCE, OUTSIDE for names that leave the archive, RESOLVED, AMBIGUOUS, MISSING.
    """
    keys = keys or []
    full = members.select(*keys, "member").distinct()
    names = full.groupBy(*keys, base_name(F.col("member")).alias("base")).agg(F.count("*").alias("n_base"), F.min("member").alias("by_base"))
    exact = full.select(*keys, F.col("member").alias("name"), F.lit(True).alias("exact"))
    rows = attachments.withColumn("base", base_name(F.col("name"))).join(exact, [*keys, "name"], "left").join(names, [*keys, "base"], "left")
    state = (
        F.when(~has_text(F.col("name")), "NO_REFERENCE").when(~safe_member(F.col("name")), "OUTSIDE").when(F.col("exact") | (F.col("n_base") == 1), "RESOLVED")
        .when(F.col("n_base") > 1, "AMBIGUOUS").otherwise("MISSING")
    )
    member = F.when(F.col("exact"), F.col("name")).otherwise(F.col("by_base"))
    return rows.withColumn("state", state).withColumn("member", F.when(F.col("state") == "RESOLVED", member)).drop("base", "exact", "n_base", "by_base")


def _media_state(states: tuple, reference: Column, status: Column, reason: Column, text: Column) -> Column:
    absent, idle, unavailable, failed, empty, done = states
    return (
        F.when(status.isNull() & ~has_text(reference), absent).when(status.isNull(), idle).when((status == "SUCCESS") & has_text(text), done)
        .when(status.isin("SUCCESS", "NO_TEXT"), empty).when(reason == unavailable, unavailable).otherwise(failed)
    )


def audio_state(kind: Column, reference: Column, status: Column, reason: Column, text: Column) -> Column:
    """The state of a voice message's transcription (status is null if there is none); null for other messages."""
    voice = (kind == "AUDIO") | status.isNotNull() | F.lower(F.regexp_extract(reference, r"\.([^.]+)$", 1)).isin(*AUDIO)
    return F.when(voice, _media_state(AUDIO_STATES, reference, status, reason, text))


def image_state(kind: Column, reference: Column, status: Column, reason: Column, text: Column) -> Column:
    """The state of an image's text recognition (status is null if there is none); null for other messages."""
    image = (kind == "IMAGE") | status.isNotNull() | F.lower(F.regexp_extract(reference, r"\.([^.]+)$", 1)).isin(*IMAGES)
    return F.when(image, _media_state(IMAGE_STATES, reference, status, reason, text))


def state_counts(rows: DataFrame, state: str, states: tuple) -> DataFrame:
    """(state, n) for every possible state, zero where no row has it."""
    every = rows.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return every.join(rows.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def substantive(sections: DataFrame, key: list[str]) -> DataFrame:
    """(key, substantive, greeting) per message: whether a section says anything, and whether all that do are greetings."""
    real = ~is_media_placeholder(F.col("text"))
    return sections.groupBy(*key).agg(F.bool_or(real).alias("substantive"), F.coalesce(F.bool_and(F.when(real, is_greeting(F.col("text")))), F.lit(False)).alias("greeting"))


def conversation_numbers(chats: DataFrame, key: str) -> DataFrame:
    """Chat keys numbered from 1 in their order, UNRESOLVED last."""
    from .records import numbered

    rows = chats.select(key).distinct().withColumn("_last", F.col(key) == "UNRESOLVED")
    return numbered(rows, ["_last", key], "number").select(key, (F.col("number") + 1).alias("number"))


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is last by the given columns."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by]))).where("_n = 1").drop("_n")


def halves(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's rows with half 0 or 1 in order; the first half is the smaller one."""
    w = Window.partitionBy(*keys)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return rows.withColumn("half", (k > F.floor(n / 2)).cast("int"))


def ingestion_summary(records: DataFrame) -> DataFrame:
    """Counts by source of records (source_name, record_type, issues): all, messages, auxiliary ones and issues."""
    return records.groupBy("source_name").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("record_type") == "message").alias("n_messages"), F.count_if(F.coalesce("record_type", F.lit("")) != "message").alias("n_auxiliary"),
        F.sum(F.coalesce(F.size("issues"), F.lit(0))).cast("long").alias("n_issues"),
    )


def anonymised(rows: DataFrame, value: str, order: str, category: str = "SENDER") -> DataFrame:
    """rows with a token, CATEGORY_001 and so on, in the order in which values occur first; null stays null."""
    from .records import numbered

    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    named = numbered(first, ["_first", value], "_k").withColumn("_k", F.col("_k") + 1)
    text = F.col("_k").cast("string")
    token = F.concat(F.lit(f"{category}_"), F.when(F.col("_k") < 1000, F.lpad(text, 3, "0")).otherwise(text))
    return rows.join(named.select(value, token.alias("token")), value, "left")
