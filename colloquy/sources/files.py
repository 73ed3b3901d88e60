"""Files and archives as DataFrames: inventory, digests, signatures, encodings, members of ZIP files and tables of SQLite files."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import base_name, safe_member

#: Limits of a source file and of an archive: bytes, members, bytes unpacked in all and each, and how far a member over 1 MiB may be compressed.
LARGEST_FILE, MEMBERS, TOTAL, EACH, RATIO = 2 << 30, 50_000, 4 << 30, 2 << 30, 100
KINDS = {
    "image": ("jpg", "jpeg", "png", "webp", "gif", "heic"), "audio": ("opus", "mp3", "wav", "ogg", "m4a", "aac"), "video": ("mp4", "3gp", "mov", "mkv", "avi"),
    "database": ("db", "sqlite", "sqlite3", "crypt14", "crypt15"), "text": ("txt", "csv", "json", "xml", "md", "log"),
}
SQLITE = b"SQLite format 3\x00"


def file_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("other")
    for kind, known in KINDS.items():
        out = F.when(ext.isin(*known), kind).otherwise(out)
    return out


def inventory(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(path, name, kind, size) of all files below a folder, with sha256 if asked; without it no content is read. Empty files give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extra = [F.sha2("content", 256).alias("sha256")] if digests else []
    return files.select("path", base_name(F.col("path")).alias("name"), file_kind(F.col("path")).alias("kind"), F.col("length").alias("size"), *extra)


def inventory_summary(files: DataFrame) -> DataFrame:
    """By kind: number, bytes, smallest, largest, average to one digit and the largest file's name."""
    return files.groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.round(F.avg("size"), 1).alias("average"),
        F.max_by("name", F.struct("size", "name")).alias("largest_name"),
    )


def preflight(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, encoding, error) of source files; error is null, TOO_LARGE, NUL_BYTES (in text) or NOT_SQLITE (by name).

    encoding is utf-8-sig, utf-8 or null for another one. Spark's reader returns no row for an empty file and fails at files of 2 GB or more.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("kind", file_kind(F.col("path")))
    head, size = F.substring("content", 1, 4096), F.col("length")
    nul = F.expr("position(X'00', substring(content, 1, 4096)) > 0")
    error = (
        F.when(size > LARGEST_FILE, "TOO_LARGE").when((F.col("kind") == "text") & nul, "NUL_BYTES")
        .when((F.col("kind") == "database") & ~F.startswith(head, F.lit(SQLITE)), "NOT_SQLITE")
    )
    encoding = F.when(F.col("kind") != "text", F.lit(None)).when(F.expr("startswith(content, X'EFBBBF')"), "utf-8-sig").when(F.expr("is_valid_utf8(cast(content AS string))"), "utf-8")
    return files.select("path", "kind", size.alias("size"), F.sha2("content", 256).alias("sha256"), encoding.alias("encoding"), error.alias("error"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, packed, error) of every member but folders; an archive's members are listed by one task each archive.

    error: UNSAFE_NAME, LINK, TOO_LARGE, TOO_DENSE for a member; TOO_MANY or TOO_LARGE_IN_ALL for all of an archive; NOT_AN_ARCHIVE.
    """

    def listed(frames):
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    infos = [i for i in zipfile.ZipFile(io.BytesIO(raw)).infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None, False, 0, 0))
                    continue
                total = sum(i.file_size for i in infos)
                rows += [(path, i.filename, i.file_size, i.compress_size, (i.external_attr >> 28) == 0xA, len(infos), total) for i in infos]
            yield pd.DataFrame(rows, columns=["path", "member", "size", "packed", "link", "n", "total"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(listed, "path string, member string, size long, packed long, link boolean, n long, total long")
    c = F.col
    error = (
        F.when(c("member").isNull(), "NOT_AN_ARCHIVE").when(c("n") > MEMBERS, "TOO_MANY").when(c("total") > TOTAL, "TOO_LARGE_IN_ALL").when(~safe_member(c("member")), "UNSAFE_NAME").when(c("link"), "LINK")
        .when(c("size") > EACH, "TOO_LARGE").when((c("size") > 1 << 20) & (c("size") > RATIO * c("packed")), "TOO_DENSE")
    )
    return rows.select("path", "member", "size", "packed", error.alias("error"))


def zip_lines(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(file, line_no, value) of the members with a suffix, line by line, for sources.chats.export_messages. Only these members leave their archives; broken archives and members have no
    lines, and bytes that aren't UTF-8 are replaced."""
    from .media import archive_members, member_bytes

    wanted = archive_members(spark, path).where(F.lower("member").endswith(suffix) & (F.col("size") <= EACH))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff|(\r\n|\r|\n)$", "")
    found = member_bytes(spark, path, wanted).where("content IS NOT NULL").select(F.concat_ws("!", "file", "member").alias("file"), text.alias("text"))
    return found.select("file", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "value"))


def _sqlite(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """read(connection) of every database, opened in memory where its bytes are, so any store that Spark reads will do."""

    def run(frames):
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                connection = sqlite3.connect(":memory:")
                connection.deserialize(raw)
                for rows in read(connection):
                    yield pd.DataFrame([(path, *r) for r in rows], columns=names, dtype=object)
                connection.close()

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_sqlite(spark: SparkSession, path: str, table: str, order: str = "_id") -> DataFrame:
    """(path, place, fields) of a table's rows in order; fields is a JSON object, its values read with get_json_object."""
    quoted = lambda name: '"' + name.replace('"', '""') + '"'

    def rows(connection):
        cursor = connection.execute(f"SELECT * FROM {quoted(table)} ORDER BY {quoted(order)}")
        names, place = [c[0] for c in cursor.description], 0
        while part := cursor.fetchmany(5000):
            yield [(place + n, json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in zip(names, r, strict=True)})) for n, r in enumerate(part)]
            place += len(part)

    return _sqlite(spark, path, rows, "path string, place long, fields string")


def sqlite_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, name, n_rows) of the tables and views of SQLite files, without SQLite's own; n_rows of tables."""

    def rows(connection):
        found = connection.execute("SELECT type, name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY type, name").fetchall()
        count = lambda name: connection.execute('SELECT count(*) FROM "' + name.replace('"', '""') + '"').fetchone()[0]
        yield [(kind, name, count(name) if kind == "table" else None) for kind, name in found]

    return _sqlite(spark, path, rows, "path string, type string, name string, n_rows long")


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines with sorted fields, or as CSV with a header."""
    out = rows.select(*sorted(rows.columns))
    out.write.mode("overwrite").json(path) if kind == "json" else out.write.mode("overwrite").option("header", True).csv(path)


def save_results(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append a run's results to a store partitioned by keys; latest_results() reads the last of each part."""
    rows.withColumn("updated_at", F.current_timestamp()).write.mode("append").partitionBy(*keys).parquet(path)


def latest_results(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    from ..operators.messages import latest

    return latest(spark.read.parquet(path), keys, ["updated_at"])
