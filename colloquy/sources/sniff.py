"""What a file is, told by its first bytes: charset, delimiter, and the kind of source. Nothing here fails on a broken file."""

from __future__ import annotations

import codecs
import csv
import io
import json
import sqlite3
import xml.parsers.expat
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..operators.messages import safe_member
from .chats import header
from .files import EACH, MEMBERS, RATIO, TOTAL
from .scan import heads

#: Charsets, delimiters, and what a source must have to be one of a kind.
CHARSETS, DELIMITERS = ("utf-8", "utf-16", "latin-1", "cp1252"), ",;\t|"
CSV_COLUMNS, JSON_KEYS = {"Source", "MessageType", "TimeStamp", "Direction", "ChatId"}, {"chat_id", "sender", "timestamp", "type"}
XML_ROOT, XML_CONTAINERS = "DumpFile", ("InstantMessages", "Message")
STORE_TABLES, STORE_COLUMNS = {"messages", "chat_list"}, {"key_remote_jid", "key_from_me", "key_id"}
CONTACT_COLUMNS = {"jid", "display_name", "phone_number"}
#: Characters of a sample for delimiters; control characters that a text may have, as a share, to be one; and bytes that aren't letters in cp1252.
SAMPLE, STRANGE, UNDEFINED = 4096, 0.15, (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def charset(head: bytes) -> str | None:
    """The charset of a text by its first bytes: by a byte order mark, by zero bytes in every other place, by UTF-8's rules (a character cut off at the end
    counts), else a single-byte one, which is cp1252 if bytes have a letter there that latin-1 lacks. None if there are zero bytes or too many control characters."""
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8-sig"
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    even, odd = head[::2], head[1::2]
    if len(head) >= 4 and max(even.count(0) / len(even), odd.count(0) / len(odd)) > 0.3 and min(even.count(0), odd.count(0)) == 0:
        return "utf-16le" if odd.count(0) else "utf-16be"
    strange = sum(b < 32 and b not in (9, 10, 12, 13) for b in head)
    if head and (strange / len(head) > STRANGE or 0 in head):
        return None
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, len(head) < 65_536)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    if not any(0x80 <= b <= 0x9F for b in head):
        return "latin-1"
    return "cp1252" if not any(b in UNDEFINED for b in head) else "latin-1"


def decoded(head: bytes, name: str | None) -> str:
    return codecs.getincrementaldecoder(name or "utf-8")("replace").decode(head)


def delimiter(sample: str) -> str:
    """The delimiter whose number of columns is steady over a sample's lines; a comma where none is."""
    try:
        return csv.Sniffer().sniff(sample[:SAMPLE], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _first_element(text: str) -> object:
    text = text.lstrip("﻿ \t\r\n")
    if not text.startswith("["):
        return None
    return json.JSONDecoder().raw_decode(text, len(text) - len(text[1:].lstrip(" \t\r\n")))[0]


def _is_report(head: bytes) -> bool:
    """Whether an XML document begins with a report's root or containers; one that declares a document type or entities isn't."""
    found = []

    class Refused(Exception):
        pass

    def begins(tag, attributes):
        name = tag.rpartition(":")[2]
        if name in XML_CONTAINERS:
            found.append(name)
            raise Refused

    def refused(*_):
        raise Refused

    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler, parser.StartDoctypeDeclHandler, parser.EntityDeclHandler = begins, refused, refused
    try:
        parser.Parse(head, False)
    except Refused:
        pass
    return bool(found)


def text_kind(head: bytes) -> str | None:
    """report_json, report_xml or report_csv of a file's first bytes; None of any other, broken ones too."""
    try:
        begin = head[:1024].lstrip(codecs.BOM_UTF8 + b" \t\r\n")
        if begin.startswith(b"["):
            first = _first_element(head.decode("utf-8", "ignore"))
            return "report_json" if isinstance(first, dict) and first.keys() >= JSON_KEYS else None
        if begin.startswith(b"<"):
            return "report_xml" if _is_report(head) else None
        row = next(csv.reader(io.StringIO(head.decode("utf-8-sig", "ignore"), newline="")), [])
        return "report_csv" if {c.strip() for c in row} >= CSV_COLUMNS else None
    except (ValueError, RecursionError, csv.Error, xml.parsers.expat.ExpatError):
        return None


def looks_like_export(text: Column) -> Column:
    """Whether a text's first hundred lines that aren't blank hold two message headers, or one if there are three lines or fewer."""
    full = F.slice(F.filter(F.split(text, "\r\n|\r|\n"), has_text), 1, 100)
    hits = F.size(F.filter(full, lambda line: header(line).isNotNull()))
    return F.coalesce(F.when(F.size(full) <= 3, hits >= 1).otherwise(hits >= 2), F.lit(False))


def sniffed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, charset, delimiter, kind, text): what the first bytes of each file tell. kind: a report's, "sqlite", "zip" or null; text is the beginning, decoded."""

    @F.pandas_udf("charset string, delimiter string, kind string, text string")
    def told(found: pd.Series) -> pd.DataFrame:
        rows = []
        for head in found:
            name = charset(head)
            binary = "sqlite" if head.startswith(b"SQLite format 3\x00") else "zip" if head.startswith(b"PK\x03\x04") else None
            text = None if binary or name is None else decoded(head, name)
            rows.append((None if binary else name, delimiter(text) if text is not None else None, binary or text_kind(head), text))
        return pd.DataFrame(rows, columns=["charset", "delimiter", "kind", "text"], dtype=object)

    return heads(spark, path).select("file", "size", told("head").alias("t")).select("file", "size", "t.*")


def database_kind(content: bytes) -> str | None:
    """store or contacts by a database's tables and columns; None of any other, broken ones too."""
    connection = sqlite3.connect(":memory:")
    try:
        connection.deserialize(content)
        tables = {r[0] for r in connection.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        columns = lambda name: {r[1] for r in connection.execute(f"PRAGMA table_info({name})")}
        if tables >= STORE_TABLES and columns("messages") >= STORE_COLUMNS:
            return "store"
        return "contacts" if "contacts" in tables and columns("contacts") >= CONTACT_COLUMNS else None
    except (sqlite3.Error, OverflowError):
        return None
    finally:
        connection.close()


def archive_texts(content: bytes) -> list[tuple[str, bytes]] | None:
    """(name, first bytes) of the texts of an archive; None of a broken or unsafe one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = archive.infolist()
            unsafe = len(infos) > MEMBERS or sum(i.file_size for i in infos) > TOTAL or any(
                (i.external_attr >> 28) == 0xA or i.file_size > EACH or (i.compress_size and i.file_size > 1 << 20 and i.file_size > RATIO * i.compress_size) for i in infos
            )
            if unsafe:
                return None
            return [(i.filename, archive.open(i).read(65_536)) for i in infos if i.filename.lower().endswith(".txt") and not i.is_dir()] or [("", b"")]
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError, NotImplementedError):
        return None


def recognised(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, charset, delimiter, kind, transcript): the kind of source of each file by what it holds, whatever its name; null if it is none.

    store and contacts (databases), report_csv, report_json (by the first element, if it lies within 64 KB), report_xml, export, and export_zip, an archive with exactly one transcript, which is
    named. Of files only the first bytes are looked at, but for databases and archives. Broken files are of no kind.
    """
    told = sniffed(spark, path).withColumn("kind", F.coalesce("kind", F.when(looks_like_export(F.col("text")), "export"))).drop("text")
    wanted = told.where(F.col("kind").isin("sqlite", "zip")).select("file", "kind")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content")

    @F.pandas_udf("string")
    def database(found: pd.Series) -> pd.Series:
        return pd.Series([database_kind(x) for x in found], dtype=object)

    @F.pandas_udf("array<struct<name:string,text:string>>")
    def texts(found: pd.Series) -> pd.Series:
        rows = []
        for content in found:
            listed = archive_texts(content)
            rows.append(None if listed is None else [{"name": n, "text": decoded(h, charset(h))} for n, h in listed])
        return pd.Series(rows, dtype=object)

    files = binary.join(F.broadcast(wanted), "file")
    stores = files.where("kind = 'sqlite'").select("file", database("content").alias("found"), F.lit(None).cast("string").alias("transcript"))
    listed = files.where("kind = 'zip'").select("file", texts("content").alias("t"))
    like = F.filter("t", lambda x: safe_member(x["name"]) & looks_like_export(x["text"]))
    archives = listed.select("file", F.when(F.size(like) == 1, "export_zip").alias("found"), F.when(F.size(like) == 1, F.get(like, F.lit(0))["name"]).alias("transcript"))
    found = stores.unionByName(archives)
    rows = told.join(found, "file", "left")
    kind = F.when(F.col("kind").isin("sqlite", "zip"), F.col("found")).otherwise(F.col("kind"))
    return rows.select("file", "size", "charset", "delimiter", kind.alias("kind"), "transcript")


def can_import(spark: SparkSession, path: str, kind: str) -> bool:
    """Whether a path holds a source of a kind; False, never an error, for one that is missing, empty or broken."""
    try:
        return recognised(spark, path).where(F.col("kind") == kind).head() is not None
    except Exception as error:  # Spark tells a missing path by several classes
        if "PATH_NOT_FOUND" in str(error) or "FileNotFound" in str(error):
            return False
        raise
