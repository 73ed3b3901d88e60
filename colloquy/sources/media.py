"""Bytes of media in archives: only the members that are asked for leave the archive, cut out by the places that its directory tells."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.messages import with_members

#: Bytes at an archive's end that hold where its directory is, and the most before a member's data: a fixed head, a name and extras.
END, LOCAL = 65_557, 30 + 2 * 65_535
MEMBER = "array<struct<member:string,method:int,packed:long,size:long,at:long,crc:long>>"


def _directory_place(tail: bytes) -> tuple[int, int] | None:
    """(place, length) of the directory by an archive's last bytes; None of one that is broken, cut into volumes, or larger than 4 GB."""
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        return None
    size, place = struct.unpack_from("<II", tail, at + 12)
    return None if 0xFFFFFFFF in (size, place) else (place, size)


def _members(directory: bytes) -> list[dict] | None:
    out, at = [], 0
    while at + 46 <= len(directory) and directory[at : at + 4] == b"PK\x01\x02":
        flags, method, _, _, crc, packed, size, n, extra, comment = struct.unpack_from("<HHHHIIIHHH", directory, at + 8)
        place = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        if not name.endswith("/"):
            out.append({"member": name, "method": method, "packed": packed, "size": size, "at": place, "crc": crc})
        at += 46 + n + extra + comment
    return out


def archive_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, member, method, packed, size, at, crc): the members of ZIP archives by their directories, of which only the bytes are taken from a file. Broken archives have none."""

    @F.pandas_udf("struct<place:long,length:long>")
    def place(tails: pd.Series) -> pd.DataFrame:
        found = [_directory_place(t) or (None, None) for t in tails]
        return pd.DataFrame(found, columns=["place", "length"]).astype("Int64")

    @F.pandas_udf(MEMBER)
    def listed(directories: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else _members(d) for d in directories], dtype=object)

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", "length")
    ends = files.select("file", "length", place(F.expr(f"substring(content, greatest(1, length - {END} + 1), {END})")).alias("d")).where("d.place IS NOT NULL")
    directories = files.drop("length").join(ends, "file").select("file", listed(F.expr("substring(content, cast(d.place AS int) + 1, cast(d.length AS int))")).alias("m"))
    return directories.select("file", F.inline("m"))


def member_bytes(spark: SparkSession, path: str | list[str], wanted: DataFrame) -> DataFrame:
    """(file, member, content, error): the bytes of the wanted members (file, member) of archives. error: UNSUPPORTED for methods other than stored and deflated, BROKEN where the bytes don't
    give what the directory tells; content is null then. Members that aren't there give no row."""

    @F.pandas_udf("content binary, error string")
    def unpacked(cuts: pd.Series, methods: pd.Series, packed: pd.Series, sizes: pd.Series, crcs: pd.Series) -> pd.DataFrame:
        rows = []
        for cut, method, n, size, crc in zip(cuts, methods, packed, sizes, crcs, strict=True):
            if method not in (0, 8):
                rows.append((None, "UNSUPPORTED"))
                continue
            try:
                begin = 30 + sum(struct.unpack_from("<HH", cut, 26))
                data = bytes(cut[begin : begin + int(n)])
                data = zlib.decompressobj(-15).decompress(data, int(size) + 1) if method == 8 else data
                ok = len(data) == size and zlib.crc32(data) == crc and bytes(cut[:4]) == b"PK\x03\x04"
                rows.append((data, None) if ok else (None, "BROKEN"))
            except (struct.error, zlib.error):
                rows.append((None, "BROKEN"))
        return pd.DataFrame(rows, columns=["content", "error"], dtype=object)

    asked = archive_members(spark, path).join(wanted.select("file", "member").distinct(), ["file", "member"])
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    cut = F.expr(f"substring(content, cast(at AS int) + 1, cast(packed AS int) + {LOCAL})")
    cuts = files.join(asked, "file").select("file", "member", cut.alias("cut"), "method", "packed", "size", "crc")
    return cuts.select("file", "member", unpacked("cut", "method", "packed", "size", "crc").alias("u")).select("file", "member", "u.*")


#: What reads the text of media: texts of contents, in their order; None for none. It runs on executors.
Reader = Callable[[list[bytes]], list[str | None]]


def with_texts(messages: DataFrame, contents: DataFrame, kinds: dict[str, Reader]) -> DataFrame:
    """messages (file, member, message_type, more) with derived_text and derived_status by the content (contents: file, member, content, error) of their member.

    kinds names a reader for each message type that is read. Status: null for messages of other types or without a member; FAILED where the content is missing or broken or its reader
    fails; NO_TEXT; SUCCESS. A content is read once, however many messages refer to it, so doing it again changes nothing.
    """
    used = messages.where(F.col("message_type").isin(*kinds) & has_member()).select("file", "member", "message_type").distinct().join(contents, ["file", "member"], "left")
    told = None
    for kind, reader in kinds.items():
        part = used.where(F.col("message_type") == kind).select("file", "member", "message_type", _read(reader)("content").alias("t"))
        told = part if told is None else told.unionByName(part)
    if told is None:
        return messages.withColumns({"derived_text": F.lit(None).cast("string"), "derived_status": F.lit(None).cast("string")})
    status = F.when(F.col("t.failed"), "FAILED").when(F.trim(F.coalesce("t.text", F.lit(""))) == "", "NO_TEXT").otherwise("SUCCESS")
    each = told.select("file", "member", "message_type", F.when(status == "SUCCESS", F.col("t.text")).alias("derived_text"), status.alias("derived_status"))
    return messages.join(each, ["file", "member", "message_type"], "left")


def _read(reader: Reader):
    @F.pandas_udf("text string, failed boolean")
    def told(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for content in batch:
            try:
                rows.append((None, True) if content is None else (reader([bytes(content)])[0], False))
            except Exception:  # one content that can't be read must not fail the others
                rows.append((None, True))
        return pd.DataFrame(rows, columns=["text", "failed"])

    return told


def has_member() -> Column:
    return F.col("member").isNotNull()


def export_media(spark: SparkSession, path: str | list[str], messages: DataFrame) -> DataFrame:
    """messages (file, attachment_name, more) of archives with the member that their attachment names (state, member by operators.messages.with_members, file by file), and its content and error."""
    rows = with_members(messages.withColumn("name", F.col("attachment_name")), archive_members(spark, path), ["file"]).drop("name")
    return rows.join(member_bytes(spark, path, rows.where(has_member()).select("file", "member")), ["file", "member"], "left")
