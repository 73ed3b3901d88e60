"""Records from sources: validation, timestamps, actors, references, candidate entities and possible duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, canonical_phone, has_text, visible
from .duplicates import duplicate_candidates, with_duplicates  # noqa: F401
from .staging import kept

#: A written date: three numbers and the marks between, then the time of day with or without seconds, and AM or PM.
WRITTEN = r"^(\d{1,4})([/.-])(\d{1,2})\2(\d{4}|\d{1,2}),? (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AaPp][Mm]))?$"
ISO = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)?"
OFFSET = r"(Z|[+-]\d\d:?\d\d)$"
#: Sources by name, and those with ISO texts.
SOURCES = ("store", "contacts", "report_csv", "report_json", "report_xml", "export")
REPORTS = ("report_csv", "report_json", "report_xml")


#: A date's eight parts side by side, each after a mark that no date has.
APART, PARTS = "\x01", "".join(f"\x01${n}" for n in range(1, 9))


def _stamp(utc: Column, naive: Column) -> Column:
    status = F.when(utc.isNotNull(), "KNOWN_UTC").when(naive.isNotNull(), "NAIVE_UNKNOWN").otherwise("ABSENT")
    return F.struct(status.alias("status"), utc.alias("utc"), naive.alias("naive"))


def _iso(text: Column) -> Column:
    """{status, utc, naive} of a trimmed text."""
    utc = F.when(text.rlike(ISO + OFFSET), text.try_cast("timestamp"))
    return bound(utc, lambda u: bound(F.when(u.isNull() & text.rlike(ISO + "$"), text.try_cast("timestamp_ntz")), lambda n: _stamp(u, n)))


def iso_parsed(raw: Column) -> Column:
    """{status, utc, naive} of an ISO text: with an offset KNOWN_UTC, without NAIVE_UNKNOWN, anything else ABSENT."""
    return bound(F.trim(raw), _iso)


def written_parsed(raw: Column) -> Column:
    """{status, utc, naive} of a date as chat exports write it: NAIVE_UNKNOWN, or ABSENT.

    The text is cleaned and taken apart once. With / the day comes first, or else the month if a comma follows the date; with . or - the day comes first; four
    digits in front are a year. AM and PM only go with /, dates with - and a day in front need the comma, as do years in front with /. Two-digit years are 1969 to 2068.
    """
    clean = F.trim(F.regexp_replace(visible(F.regexp_replace(F.trim(raw), r"^\[+|\]+$", "")), r"\s+", " "))
    none = F.lit(None).cast("timestamp")
    pieces = lambda text: F.split(F.regexp_replace(text, WRITTEN, PARTS), APART)
    return bound(clean, lambda text: bound(pieces(text), lambda parts: bound(_written(text, parts), lambda naive: _stamp(none, naive))))


def _written(text: Column, parts: Column) -> Column:
    part = lambda n: F.get(parts, F.lit(n))
    number = lambda n: F.nullif(part(n), F.lit("")).cast("int")
    mark, comma, noon = part(2), F.contains(text, F.lit(",")), F.upper(part(8))
    hour = F.when(noon == "", number(5)).when(number(5).between(1, 12), number(5) % 12 + F.when(noon == "PM", 12).otherwise(0))
    short = number(4)
    year = F.when(F.length(part(4)) == 4, short).when(F.length(part(4)) == 2, short + F.when(short < 69, 2000).otherwise(1900))
    made = lambda y, m, d: F.when(y > 0, F.try_make_timestamp_ntz(y, m, d, hour, number(6), F.coalesce(number(7), F.lit(0)).cast("decimal(8,6)")))
    front = F.length(part(1))
    day_first, month_first = made(year, number(3), number(1)), made(year, number(1), number(3))
    year_first = made(number(1), number(3), F.when(F.length(part(4)) < 4, short))
    return (
        F.when((F.size(parts) != 9) | (part(0) != "") | (front == 3), F.lit(None)).when((front == 4) & (noon == "") & ((mark == "-") | ((mark == "/") & comma)), year_first).when(front == 4, F.lit(None))
        .when(mark == "/", F.coalesce(day_first, F.when(comma, month_first))).when((noon == "") & ((mark == ".") | comma), day_first)
    )


def parsed_timestamp(raw: Column) -> Column:
    """{status, utc, naive} of a text that is ISO or a written date."""
    else_written = lambda text, iso: F.when(iso["status"] != "ABSENT", iso).otherwise(written_parsed(text))
    return bound(F.trim(raw), lambda text: bound(F.when(text.rlike(ISO), _iso(text)).otherwise(_stamp(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp_ntz"))), lambda iso: else_written(text, iso)))


def from_milliseconds(ms: Column) -> Column:
    """{status, utc, naive} of milliseconds since 1970; zero, negative and null ones are ABSENT."""
    return _stamp(F.when(ms > 0, F.timestamp_millis(ms)), F.lit(None).cast("timestamp_ntz"))


def source_timestamp(source: Column, raw: Column) -> Column:
    """{status, utc, naive} of a record's raw time, by its source: milliseconds in a store, ISO in reports, written dates in exports, else none."""
    none = _stamp(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp_ntz"))
    return bound(
        raw, lambda x: F.when(source == "store", from_milliseconds(x.try_cast("bigint"))).when(source.isin(*REPORTS), iso_parsed(x)).when(source == "export", written_parsed(x)).otherwise(none)
    )


#: The codes of issues, by source.
TIMESTAMP_CODES = {"report_csv": "CSV_EMPTY_TIMESTAMP", "report_json": "JSON_MISSING_TIMESTAMP", "report_xml": "XML_EMPTY_TIMESTAMP", "export": "WHATSAPP_EXPORT_EMPTY_TIMESTAMP"}


def source_issues(source: Column, record_type: Column, n_fields: Column, raw_time: Column, jid: Column) -> Column:
    """The issues {code, severity} of a raw record; all are warnings, and no record is dropped for them.

    A record without fields; a blank time in reports and exports; a time of a store's message that is a number and not above zero (null isn't
    flagged); a contact with a blank JID.
    """
    number = raw_time.try_cast("double")
    rules = {"GENERIC_EMPTY_RAW_FIELDS": ("WARNING", n_fields == 0)}
    rules |= {code: ("WARNING", (source == name) & ~has_text(raw_time)) for name, code in TIMESTAMP_CODES.items()}
    rules["MSGSTORE_ANOMALOUS_TIMESTAMP"] = ("WARNING", (source == "store") & (record_type == "message") & (number <= 0))
    rules["WA_DB_EMPTY_JID"] = ("WARNING", (source == "contacts") & ~has_text(jid))
    return issues(rules)


def issues(rules: dict[str, tuple[str, Column]]) -> Column:
    """An array of {code, severity} of the rules (code: severity, condition) that hold; no row is dropped."""
    return F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, cond) in rules.items()]))


def is_valid(found: Column) -> Column:
    return ~F.exists(found, lambda x: x["severity"] == "ERROR")


def actor(raw: Column) -> Column:
    """{raw, kind, phone, jid_local, jid_domain} of a sender or recipient; null if blank."""

    def told(text, phone):
        kind = (
            F.when(text == "LOCAL_USER", "local_user").when(text.contains("@"), "jid").when(text.startswith("group_participant_"), "alias")
            .when(text.startswith("chat_"), "chat_id").when(phone.isNotNull(), "phone").otherwise("unknown")
        )
        at = F.instr(text, "@")
        parts = lambda k: F.struct(
            text.alias("raw"), k.alias("kind"), F.when(k == "phone", phone).alias("phone"), F.when(k == "jid", F.substring(text, F.lit(1), at - 1)).alias("jid_local"),
            F.when(k == "jid", F.substring(text, at + 1, F.length(text))).alias("jid_domain"),
        )
        return F.when(has_text(text), bound(kind, parts))

    return bound(F.trim(raw), lambda text: bound(canonical_phone(text), lambda phone: told(text, phone)))


def deleted_flag(source: Column, raw: Column) -> Column:
    """Whether a record was deleted: true or 1, false or 0; null for anything else and for exports, which don't tell."""
    text = F.lower(F.trim(raw.cast("string")))
    return F.when(source == "export", F.lit(None)).when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def source_actors(source: Column, record_type: Column, fields: Column) -> Column:
    """{sender, recipient} of a record from its fields (a map), by its source; chats and media references have none.

    A store's message by its direction; From and To of a report as CSV; the sender of other reports and of exports (none of a system message);
    a contact's JID or else its phone.
    """
    from .messages import directed_actors

    f = lambda name: F.try_element_at(fields, F.lit(name))
    none = F.lit(None).cast("struct<raw:string,kind:string,phone:string,jid_local:string,jid_domain:string>")
    pair = lambda sender, recipient: F.struct(sender.alias("sender"), recipient.alias("recipient"))
    message, nobody = record_type == "message", pair(none, none)
    system = F.coalesce(F.lower(f("is_system")) == "true", F.lit(False))
    return (
        F.when(record_type.isin("chat", "media_ref"), nobody)
        .when((source == "store") & message, directed_actors(f("key_from_me").try_cast("int"), f("key_remote_jid"), f("remote_resource")))
        .when(source == "contacts", pair(actor(F.coalesce(F.nullif(f("jid"), F.lit("")), f("phone_number"))), none)).when(source == "report_csv", pair(actor(f("From")), actor(f("To"))))
        .when(source == "report_json", pair(actor(f("sender")), none)).when(source == "report_xml", pair(actor(f("Sender")), none))
        .when((source == "export") & message & ~system, pair(actor(f("sender")), none)).otherwise(nobody)
    )


#: The field of a record's time, text, chat, kind and deletion mark, by source.
FIELDS = {
    "store": ("timestamp", "data", "key_remote_jid", "media_wa_type", "deleted"), "report_csv": ("TimeStamp", "Body", "ChatId", "MessageType", "Deleted"),
    "report_json": ("timestamp", "text", "chat_id", "type", "deleted"), "report_xml": ("Timestamp", "Body", None, None, "Deleted"),
    "export": ("raw_timestamp", "text", "chat_id", None, None), "contacts": (None, "status", None, None, None),
}


def normalized_records(raw: DataFrame) -> DataFrame:
    """Raw records (source, record_id, record_type, fields map<string,string>) with issues, stamp, sender, recipient, chat_id, message_type, deleted and text.

    One projection; a source that isn't known gives nulls. No record is dropped.
    """
    from .messages import chat_identifier, message_type, text_content

    source, kind, fields = F.col("source"), F.col("record_type"), F.col("fields")

    def of(n: int) -> Column:
        out = F.lit(None).cast("string")
        for name, names in FIELDS.items():
            if names[n]:
                out = F.when(source == name, F.try_element_at(fields, F.lit(names[n]))).otherwise(out)
        return out

    named = raw.withColumns({"_time": of(0), "_text": of(1), "_chat": of(2), "_kind": of(3), "_deleted": of(4), "_jid": F.try_element_at(fields, F.lit("jid"))})
    attachment = F.try_element_at(fields, F.lit("attachment_name"))
    system = F.lower(F.try_element_at(fields, F.lit("is_system"))) == "true"
    c = F.col
    return named.withColumn("_actors", source_actors(source, kind, fields)).select(
        *raw.columns, source_issues(source, kind, F.size(fields), c("_time"), c("_jid")).alias("issues"), source_timestamp(source, c("_time")).alias("stamp"),
        c("_actors.sender").alias("sender"), c("_actors.recipient").alias("recipient"), chat_identifier(source, c("_chat")).alias("chat_id"),
        message_type(source, kind, c("_kind"), attachment, system).alias("message_type"), deleted_flag(source, c("_deleted")).alias("deleted"), text_content(source, c("_text")).alias("text"),
    )


def candidate_entities(references: DataFrame) -> DataFrame:
    """(candidate_id, identifier, kind, n_references, level) from references (identifier, kind, seq): a local user first, then JIDs, then phones.

    A phone that is the local part of a JID is part of that JID's entity. Numbers follow the order of identifiers within
    a class, given by a sort over ranges; equal inputs get equal numbers.
    """
    jid_local = references.where("kind = 'jid'").select(F.substring_index("identifier", "@", 1).alias("identifier"), F.col("identifier").alias("jid")).distinct()
    one = jid_local.groupBy("identifier").agg(F.min("jid").alias("jid"))
    merged = references.join(one, "identifier", "left").select(
        F.when((F.col("kind") == "phone") & F.col("jid").isNotNull(), F.col("jid")).otherwise(F.col("identifier")).alias("identifier"),
        F.when((F.col("kind") == "phone") & F.col("jid").isNotNull(), F.lit("jid")).otherwise(F.col("kind")).alias("kind"),
        (F.col("kind") == "phone").alias("by_phone"),
    )
    groups = merged.where(F.col("kind").isin("local_user", "jid", "phone")).groupBy("kind", "identifier").agg(F.count("*").alias("n_references"), F.bool_or("by_phone").alias("by_phone"))
    level = (
        F.when((F.col("kind") == "jid") & F.col("identifier").endswith("@g.us"), "EXACT").when((F.col("kind") == "jid") & F.col("by_phone"), "STRONG").when(F.col("n_references") == 1, "WEAK")
        .when(F.col("kind") == "jid", "EXACT").when(F.col("kind") == "phone", "STRONG").otherwise("EXACT")
    )
    return groups.select("kind", "identifier", "n_references", level.alias("level"), F.concat(F.lit("entity:"), F.col("kind"), F.lit(":"), F.col("identifier")).alias("candidate_id"))


def possible_duplicates(records: DataFrame) -> DataFrame:
    """Groups of records (record_id, source_name, actor, stamp, text) with equal text and time and compatible senders.

    Within a group, records of each known sender form a cluster, and those without one join the first cluster. A group
    isn't collected: clusters are grouped counts.
    """
    rows = records.where(has_text(F.col("text")) & F.col("stamp").isNotNull())
    key = rows.select("record_id", "source_name", "actor", "stamp", F.md5(F.trim("text")).alias("fingerprint"))
    lead = key.where("actor is not null").groupBy("stamp", "fingerprint").agg(F.min(F.struct("record_id", "actor")).alias("lead"))
    named = key.join(lead, ["stamp", "fingerprint"], "left").withColumn("sender", F.coalesce("actor", "lead.actor", F.lit("")))
    groups = named.groupBy("stamp", "fingerprint", "sender").agg(
        F.count("*").alias("n_records"), F.min("record_id").alias("first_record"), F.count_distinct("source_name").alias("n_sources"), F.bool_and(F.col("actor").isNotNull()).alias("known")
    )
    confidence = F.when((F.col("n_sources") > 1) & F.col("known"), "STRONG").otherwise("WEAK")
    return groups.where("n_records > 1").select("stamp", "fingerprint", "sender", "n_records", "first_record", "n_sources", confidence.alias("confidence"))


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Rows numbered from 0 in an order: a sort over ranges, then the counts of the ranges before; no task gets all rows.

    The ranges are dealt once and kept, as counts and rows must see the same ones.
    """
    ranged = kept(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # a row per range: few enough for one task and a broadcast
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.withColumn("_own", own).join(F.broadcast(base.select("_p", "_base")), "_p").withColumn(name, F.col("_base") + F.col("_own")).drop("_p", "_own", "_base")
