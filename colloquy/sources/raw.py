"""Records of every kind of source in one form, as they are written there.

source, file, place (their order within the file), record_id, record_type, fields (a map of texts) and media_reference. Nothing is interpreted here; operators.records
does that.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .chats import read_export
from .files import read_sqlite, sqlite_catalog, zip_lines

COLUMNS = ["source", "file", "place", "record_id", "record_type", "fields", "media_reference"]


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def export_records(messages: DataFrame) -> DataFrame:
    """Messages of chat exports (sources.chats.export_messages) as records."""
    names = ["raw_timestamp", "sender", "text", "raw_line", "line_start", "line_end", "is_system", "attachment_name", "chat_id"]
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return messages.select(
        F.lit("export").alias("source"), "file", F.col("line_start").cast("long").alias("place"), F.col("source_record_id").alias("record_id"), F.lit("message").alias("record_type"), fields.alias("fields"),
        F.lit(None).cast("string").alias("media_reference"),
    )


def _export(spark: SparkSession, path, charset: str) -> DataFrame:
    return export_records(read_export(spark, path, charset))


def _export_zip(spark: SparkSession, path, charset: str) -> DataFrame:
    """The transcripts of archives; attachments are joined to members by operators.messages.with_members. The transcript is the one that sniff.recognised() names."""
    from .chats import export_messages
    from .sniff import recognised

    chosen = recognised(spark, path).where("kind = 'export_zip'").select(F.concat_ws("!", "file", "transcript").alias("file"))
    lines = zip_lines(spark, path).join(F.broadcast(chosen), "file")
    return export_records(export_messages(lines).withColumn("file", F.substring_index("file", "!", 1)))


def cells(text: Column, names: Column, file: Column, line: Column) -> Column:
    """The cells of a CSV record by the header's names; a record with more or fewer cells than names is an error."""

    @F.pandas_udf("map<string,string>")
    def told(texts: pd.Series, headers: pd.Series, files: pd.Series, places: pd.Series) -> pd.Series:
        rows = []
        for text, header, file, place in zip(texts, headers, files, places, strict=True):
            found = next(csv.reader(io.StringIO(text, newline="")))
            if len(found) != len(header):
                raise ValueError(f"{file}, line {place}: {len(found)} cells, the header has {len(header)}")
            rows.append(dict(zip(header, found, strict=True)))
        return pd.Series(rows, dtype=object)

    return told(text, names, file, line)


def csv_rows(spark: SparkSession, path, charset: str = "utf-8") -> DataFrame:
    """(file, place, last_line, fields): the rows of CSV files with a header, place being their first physical line. Cells may hold line ends; files are read by as many tasks as they have blocks."""

    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        return pd.Series([next(csv.reader(io.StringIO(t, newline=""))) for t in texts], dtype=object)

    found = scan.csv_records(scan.lines(spark, path, charset)).withColumn("text", F.array_join(F.transform("lines", lambda x: x["value"]), "\n")).drop("lines")
    headers = found.where("n = 1").select("file", names("text").alias("names"))
    rows = found.where("n > 1").join(headers, "file")
    return rows.select("file", F.col("first_line").alias("place"), "last_line", cells(F.col("text"), F.col("names"), F.col("file"), F.col("first_line")).alias("fields"))


def _report_csv(spark: SparkSession, path, charset: str) -> DataFrame:
    rows = csv_rows(spark, path, charset)
    return rows.select(
        F.lit("report_csv").alias("source"), "file", "place", F.concat(F.lit("row:"), F.col("place").cast("string")).alias("record_id"), F.lit("message").alias("record_type"), "fields",
        F.nullif(F.try_element_at("fields", F.lit("Attachments")), F.lit("")).alias("media_reference"),
    )


def _report_json(spark: SparkSession, path, charset: str) -> DataFrame:
    """Elements of a JSON array; what content and metadata hold stands beside the other fields. A file that isn't an array of objects is an error."""
    items = F.from_json("value", "array<string>")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), items.alias("items"))
    broken = F.raise_error(F.concat(F.lit("not an array of records: "), "file"))
    each = whole.select("file", F.posexplode(F.coalesce("items", broken.cast("array<string>"))).alias("place", "item"))
    item = F.when(F.startswith("item", F.lit("{")), F.col("item")).otherwise(broken.cast("string"))
    each = each.withColumn("item", item)
    inner = {"text": "$.content.text", "media_path": "$.content.media_path", "deleted": "$.metadata.deleted", "forwarded": "$.metadata.forwarded", "starred": "$.metadata.starred"}
    read = lambda p: F.get_json_object("item", p)
    own = F.map_filter(F.from_json("item", "map<string,string>"), lambda k, _: ~k.isin(*inner))
    fields = F.map_concat(own, F.create_map(*[x for k, p in inner.items() for x in (F.lit(k), read(p))]))
    return each.select(
        F.lit("report_json").alias("source"), "file", F.col("place").cast("long").alias("place"), F.coalesce(_filled(read("$.id")), F.concat(F.lit("item:"), F.col("place").cast("string"))).alias("record_id"),
        F.lit("message").alias("record_type"), fields.alias("fields"), _filled(read("$.content.media_path")).alias("media_reference"),
    )


def _report_xml(spark: SparkSession, path, charset: str) -> DataFrame:
    """Messages at any depth, all their children and attributes as texts (a child with children of its own as XML). A file that declares a document type is an error."""
    rows = spark.read.format("xml").option("rowTag", "Message").option("ignoreSurroundingSpaces", False).option("mode", "FAILFAST")
    names = rows.option("inferSchema", False).load(path).schema.names  # one pass over the names
    read = rows.schema(", ".join(f"`{n}` string" for n in names)).load(path)
    declared = scan.heads(spark, path).where(F.expr("position(cast('<!DOCTYPE' AS binary), head) > 0 OR position(cast('<!ENTITY' AS binary), head) > 0")).select(F.col("file").alias("declared"))
    fields = F.create_map(*[x for n in names for x in (F.lit(n.removeprefix("_") if n == "_id" else n), F.col(f"`{n}`"))])
    told = read.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("block"), F.monotonically_increasing_id().alias("at"), fields.alias("fields"))
    numbered = scan.with_line_numbers(told).withColumn("place", F.col("line") - 1).join(declared, F.col("file") == F.col("declared"), "left")
    refused = F.raise_error(F.concat(F.lit("a document type is declared: "), "file")).cast("string")
    return numbered.select(
        F.lit("report_xml").alias("source"), F.when(F.col("declared").isNotNull(), refused).otherwise(F.col("file")).alias("file"), "place",
        F.coalesce(F.trim(_filled(F.try_element_at("fields", F.lit("id")))), F.concat(F.lit("message:"), F.col("place").cast("string"))).alias("record_id"), F.lit("message").alias("record_type"), "fields",
        F.lit(None).cast("string").alias("media_reference"),
    )


#: The tables of databases by kind of source: table, record type, the field that refers to media.
TABLES = {"store": (("messages", "message", "media_url"), ("chat_list", "chat", None), ("media_refs", "media_ref", "file_path")), "contacts": (("contacts", "contact", None),)}


def _database(kind: str) -> Callable[[SparkSession, str, str], DataFrame]:
    def read(spark: SparkSession, path, charset: str) -> DataFrame:
        """Rows of a database's tables, one table after the other. A table that no file has gives no rows."""
        there = {r.name for r in sqlite_catalog(spark, path).select("name").distinct().collect()}
        out = None
        for n, (table, record_type, media) in enumerate(TABLES[kind]):
            if table not in there:
                continue
            fields = F.from_json("fields", "map<string,string>")
            rows = read_sqlite(spark, path, table).select(
                F.lit(kind).alias("source"), F.col("path").alias("file"), (F.col("place") + n * (1 << 40)).alias("place"), fields.alias("fields"), F.lit(record_type).alias("record_type"),
            )
            rows = rows.withColumn("record_id", F.try_element_at("fields", F.lit("_id"))).withColumn("media_reference", F.nullif(F.try_element_at("fields", F.lit(media or "")), F.lit("")))
            out = rows.select(*COLUMNS) if out is None else out.unionByName(rows.select(*COLUMNS))
        return out

    return read


READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    "export": _export, "export_zip": _export_zip, "report_csv": _report_csv, "report_json": _report_json, "report_xml": _report_xml, "store": _database("store"), "contacts": _database("contacts"),
}


def read_records(spark: SparkSession, kind: str, path: str | list[str], charset: str = "utf-8") -> DataFrame:
    """The records of sources of a kind, in one form."""
    if kind not in READERS:
        raise ValueError(f"the kind is none of {sorted(READERS)}")
    return READERS[kind](spark, path, charset).select(*COLUMNS)
