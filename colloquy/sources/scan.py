"""Text files as lines that many tasks read, and records of several lines put together across the blocks they were read in.

Spark cuts a text file into blocks at line ends. A line's place is its file, its block, and its order within the block; what needs a number
over the whole file (line numbers, numbers of messages, open quotes) comes from counts per block, summed over the blocks before. So a file of any
size is read by as many tasks as it has blocks, and only a record's own lines meet in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What cannot be cut at line ends, as a line feed is two bytes there.
WIDE = ("utf-16", "utf-16le", "utf-16be")
#: Files with up to this many bytes are read whole where only their beginning is wanted, others by lines; and the bytes of a beginning.
WHOLE_FILE, HEAD = 64 << 20, 65_536


def _cp1252() -> tuple[str, str]:
    """The characters that latin-1 has where cp1252 has letters, and those letters."""
    own = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in own if b), "".join(b for _, b in own)


def lines(spark: SparkSession, path: str | list[str], charset: str = "utf-8") -> DataFrame:
    """(file, block, at, value): the lines of text files, ended by a line feed, a carriage return or both; at orders those of a block.

    A byte order mark at the beginning is left out. A line that isn't valid in its charset is an error: nothing is replaced. Files in UTF-16 are read by one task each.
    """
    charset = charset.lower()
    if charset not in (*WIDE, "utf-8", "utf-8-sig", "latin-1", "cp1252"):
        raise ValueError(f"the charset {charset} isn't known")
    if charset in WIDE:
        text = F.decode("content", {"utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}[charset])
        whole = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "(\r\n|\r|\n)$", "").alias("t"))
        return whole.select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("t", "\r\n|\r|\n")).alias("at", "value")).withColumn("at", F.col("at").cast("long"))
    raw = F.col("value")
    if charset in ("utf-8", "utf-8-sig"):
        value = F.when(F.is_valid_utf8(raw), raw).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "_metadata.file_path")).cast("string"))
    else:
        value = F.decode(raw.cast("binary"), "ISO-8859-1")
        value = F.translate(value, *_cp1252()) if charset == "cp1252" else value
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace(value, "^﻿", "").alias("value")
    )


def before(counts: DataFrame, sums: dict[str, str], lasts: dict[str, str] | None = None) -> DataFrame:
    """(file, block) with the sums of columns, and the last values that aren't null, over the file's blocks before."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    out = [F.coalesce(F.sum(of).over(earlier), F.lit(0)).alias(name) for name, of in sums.items()]
    return counts.select("file", "block", *out, *[F.last(of, ignorenulls=True).over(earlier).alias(name) for name, of in (lasts or {}).items()])


def with_line_numbers(rows: DataFrame) -> DataFrame:
    """rows (file, block, at, more) with line, from 1 over the file."""
    base = before(rows.groupBy("file", "block").agg(F.count("*").alias("n")), {"_before": "n"})
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.join(base, ["file", "block"]).withColumn("line", F.col("_before") + own).drop("_before")


def records(rows: DataFrame, starts: Column) -> DataFrame:
    """(file, n, first_line, last_line, lines): lines put together, from each one where `starts` holds up to the next; n numbers a file's records from 1.

    rows: file, block, line, value (with_line_numbers), and what starts needs. lines is an array of {line, value} in order. Lines before a file's first start are left out.
    """
    place = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select("file", "block", "line", "value", F.coalesce(starts, F.lit(False)).alias("_starts"))
    told = marked.withColumns({"_first": F.max(F.when(F.col("_starts"), F.col("line"))).over(place), "_k": F.sum(F.col("_starts").cast("long")).over(place)})
    blocks = told.groupBy("file", "block").agg(F.max("_first").alias("last_first"), F.max("_k").alias("starts"))
    base = before(blocks, {"_started": "starts"}, {"_open": "last_first"})
    whole = told.join(base, ["file", "block"]).select("file", F.coalesce("_first", "_open").alias("first_line"), (F.col("_started") + F.col("_k")).alias("n"), "line", "value")
    found = whole.where("first_line IS NOT NULL").groupBy("file", "first_line").agg(F.min("n").alias("n"), F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines"))
    return found.select("file", "n", "first_line", "last_line", "lines")


def csv_records(rows: DataFrame) -> DataFrame:
    """records() of lines (file, block, at, value) of CSV files: a line starts a record unless a quoted cell is open before it.

    A cell is open where the quotes before are odd in number. A file whose quotes are odd in all is an error. Blank lines between records are left out, but counted.
    """
    quotes = with_line_numbers(rows).withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    counts = quotes.groupBy("file", "block").agg(F.sum("_quotes").alias("n"))
    odd = counts.groupBy("file").agg((F.sum("n") % 2 == 1).alias("_odd"))
    earlier = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    open_ = (F.col("_quoted") + F.coalesce(F.sum("_quotes").over(earlier), F.lit(0))) % 2 == 1
    told = quotes.join(before(counts, {"_quoted": "n"}).join(odd, "file"), ["file", "block"]).withColumn("_open", open_)
    refused = F.raise_error(F.concat(F.lit("a quoted cell isn't closed: "), "file")).cast("string")
    return records(told.withColumn("value", F.when(F.col("_odd"), refused).otherwise(F.col("value"))).where("_open OR value <> ''"), ~F.col("_open"))


def heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, size, head): the first 64 KB of each file as bytes. A larger file is read for it by its lines, so that none has to fit a task; empty files give no row."""
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= WHOLE_FILE)
    small = small.select(F.col("path").alias("file"), F.col("length").alias("size"), F.substring("content", 1, HEAD).alias("head"))
    text = spark.read.option("recursiveFileLookup", True).text(path).where((F.col("_metadata.file_size") > WHOLE_FILE) & (F.col("_metadata.file_block_start") == 0))
    large = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.concat(F.col("value").cast("binary"), F.lit("\n").cast("binary")).alias("head"))

    def first(batches):
        """The first HEAD bytes of each file of a task; its lines come in order."""
        import pyarrow as pa

        held: dict[str, tuple[int, bytes]] = {}
        for batch in batches:
            for file, size, line in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "head")), strict=True):
                have = held.get(file, (size, b""))[1]
                if len(have) < HEAD:
                    held[file] = size, (have + line)[:HEAD]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([s for s, _ in held.values()]), pa.array([h for _, h in held.values()], pa.binary())], names=["file", "size", "head"])

    return small.unionByName(large.mapInArrow(first, "file string, size long, head binary"))
