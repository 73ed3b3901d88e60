"""Merkle fixity audit of WARC archives.

Records are written to WARC files, one per range of identifiers, by tasks. Each file has a tree: its leaves are the SHA-256 of its
records in the order of their offsets, every inner node hashes up to FAN_OUT neighbours and stands for the range of offsets
they cover. The files' roots have a tree above them: files are dealt to GROUPS groups by a hash of their path, a group's node hashes its
files' paths and roots in order, and the replica's root hashes the groups. All nodes of a replica are one table, written by level. An
audit compares the two replicas' roots, then groups, then files' roots, then joins level by level downwards only where a node
differs. Equal replicas are told by their roots; of unequal ones each level's table is read for the differing files alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, small, stored

FAN_OUT, GROUPS = 16, 4096
#: Names of differing files that are put into the filter of a scan, at most; beyond, they are joined.
LISTED = 1000
#: Records of one archive file at most, about; there is a file for each shuffle partition at least.
FILE_RECORDS = 20_000
_END = b"\r\n\r\n"
_NODES = "path string, level int, n long, first_offset long, end_offset long, digest string, record_id long"


def warc_record(record_id: int | None, url: str | None, body: bytes) -> bytes:
    """A WARC/1.1 resource record with a deflated body. Its identifier is derived from its content, so that writing is repeatable."""
    body = zlib.compress(body, 6)
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"record {record_id} {url} {hashlib.sha256(body).hexdigest()}")
    number = "" if record_id is None else f"X-Record-Number: {record_id}\r\n"
    head = (
        "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {' '.join((url or '').split())}\r\n{number}"
        f"Content-Type: text/html\r\nContent-Encoding: deflate\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + body + _END


def read_records(stream) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, end, record number or None, bytes) of every record of a stream, one in memory at a time.

    A record is found by its version line, and a damaged head ends with the next version line or the end of the
    stream; what lies between is one record without a number, so that every byte belongs to a record.
    """
    window = _Window(stream)
    while window.reach(1):
        number = size = None
        end = window.find(_END)
        if end >= 0 and window.bytes(0, 5) == b"WARC/":
            for line in window.bytes(0, end).split(b"\r\n")[1:]:
                key, _, value = line.partition(b":")
                value = value.strip()
                if key.lower() == b"content-length" and value.isdigit():
                    size = int(value)
                elif key.lower() == b"x-record-number" and value.lstrip(b"-").isdigit():
                    number = int(value)
        if size is not None:
            whole = end + 4 + size + 4
            window.reach(whole + 5)
            if window.bytes(whole - 4, whole) != _END or window.bytes(whole, whole + 5) not in (b"", b"WARC/"):
                size = None
        if size is None:
            found = window.find(b"\r\n\r\nWARC/", 1)
            whole = window.held() if found < 0 else found + 4
        yield window.at, window.at + whole, number, window.take(whole)


class _Window:
    """What has been read of a stream and not yet taken. Bytes are moved once a CHUNK only, and none is searched twice for a mark."""

    CHUNK = 1 << 20

    def __init__(self, stream):
        self.stream, self.buffer, self.start, self.at, self.over = stream, bytearray(), 0, 0, False

    def held(self) -> int:
        return len(self.buffer) - self.start

    def reach(self, n: int) -> bool:
        """Whether n bytes are there, after reading as far as needed."""
        while self.held() < n and not self.over:
            got = self.stream.read(max(self.CHUNK, n - self.held()))
            self.over = not got
            self.buffer += got
        return self.held() >= n

    def find(self, mark: bytes, start: int = 0) -> int:
        """The place of a mark from `start` on, or -1 after all has been read."""
        while True:
            found = self.buffer.find(mark, self.start + start)
            if found >= 0:
                return found - self.start
            start = max(start, self.held() - len(mark) + 1)
            if not self.reach(self.held() + 1):
                return -1

    def bytes(self, a: int, b: int) -> bytes:
        return bytes(self.buffer[self.start + a : self.start + b])

    def take(self, n: int) -> bytes:
        out = self.bytes(0, n)
        self.start += n
        self.at += n
        if self.start > self.CHUNK:
            del self.buffer[: self.start]
            self.start = 0
        return out


def write_archives(pages: DataFrame, folder: str | None = None, file_records: int = FILE_RECORDS, id: str = "page_id", url: str = "url", body: str = "html") -> str:
    """Write pages as WARC files in order of their identifiers, a range each; returns the folder.

    A file is written under a name of the task attempt's own and then moved into place. Null bodies are empty records;
    rows without an identifier come first and have no number; repeated rows are written each; a body of any length is one record; an empty
    table gives a folder without files; other columns are ignored.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(F.col(id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // file_records))
    tie = F.xxhash64("url", "body")
    home, top = fs.FileSystem.from_uri(folder)
    home.create_dir(top, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own, n = f"{root}/writing-{uuid.uuid4().hex}", 0
        with store.open_output_stream(own) as stream:
            for batch in batches:
                for k in range(batch.num_rows):
                    stream.write(warc_record(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py().encode("utf-8", "surrogatepass")))
                    n += 1
        if n:
            store.move(own, f"{root}/part-{TaskContext.get().partitionId():06d}.warc")
        else:
            store.delete_file(own)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = rows.withColumn("tie", tie).repartitionByRange(parts, "record_id", "tie").sortWithinPartitions("record_id", "tie").drop("tie")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def replicate(spark: SparkSession, folder: str, change=None) -> str:
    """Copy a folder of archives record by record to a new one, a task per file; change(record number, bytes), if given, gives the bytes to write."""
    from pyarrow import fs

    to = new_folder(spark, "replica")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        target, top = fs.FileSystem.from_uri(to)
        target.create_dir(top, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own = f"{top}/writing-{uuid.uuid4().hex}"
                with store.open_input_stream(f"{root}/{path}") as source, target.open_output_stream(own) as stream:
                    for _, _, number, raw in read_records(source):
                        stream.write(change(number, raw) if change else raw)
                target.move(own, f"{top}/{path}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    archive_paths(spark, folder).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return to


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of the archive files in a folder, relative to it, spread over tasks; a row per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"))
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def digest_tree(rows: list[tuple[int, int, str, int | None]], path: str, fan_out: int = FAN_OUT) -> list[tuple]:
    """All nodes of a file from its leaves (offset, end, digest, record number): leaves are level 0, the root comes last."""
    nodes = [(path, 0, n, a, b, d, r) for n, (a, b, d, r) in enumerate(rows)]
    level, now = 0, nodes[:]
    while len(now) > 1:
        level += 1
        groups = [now[k : k + fan_out] for k in range(0, len(now), fan_out)]
        now = [(path, level, n, g[0][3], g[-1][4], _inner(g), None) for n, g in enumerate(groups)]
        nodes += now
    return nodes


def _inner(group: list[tuple]) -> str:
    h = hashlib.sha256(b"\1")
    for x in group:
        h.update(bytes.fromhex(x[5]) + (x[4] - x[3]).to_bytes(8, "big"))
    return h.hexdigest()


def build_trees(spark: SparkSession, folder: str, fan_out: int = FAN_OUT) -> DataFrame:
    """(path, level, n, first_offset, end_offset, digest, record_id, is_root) of all files in a replica's folder.

    A task holds one record and a file's digests. Every byte of a file lies in a leaf, whether or not it can be parsed.
    """
    from pyarrow import fs

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path}") as stream:
                    leaves = [(a, b, hashlib.sha256(b"\0" + raw).hexdigest(), r) for a, b, r, raw in read_records(stream)]
                nodes = digest_tree(leaves, path, fan_out)
                if nodes:
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                    names = ["path", "level", "n", "first_offset", "end_offset", "digest", "record_id"]
                    cols = [pa.array(c, k) for c, k in zip(zip(*nodes, strict=True), kinds, strict=True)]
                    top = [False] * (len(nodes) - 1) + [True]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(top)], names=[*names, "is_root"])

    return archive_paths(spark, folder).mapInArrow(run, f"{_NODES}, is_root boolean")


def with_tops(trees: DataFrame) -> DataFrame:
    """trees with two more levels: a node per group of files (level -1, path its number) and the replica's root (level -2).

    The digests cover paths and roots in order; a group has about a GROUPS-th of the files.
    """
    files = trees.where("is_root").select("path", "digest", F.pmod(F.xxhash64("path"), F.lit(GROUPS)).cast("string").alias("group"))
    listed = lambda a, b: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(a, b))), lambda x: F.concat(x[a], F.lit(" "), x[b])), "\n"), 256)
    groups = files.groupBy("group").agg(listed("path", "digest").alias("digest"))
    root = groups.agg(F.coalesce(listed("group", "digest"), F.lit("")).alias("digest"))
    node = lambda t, path, level: t.select(
        path.alias("path"), F.lit(level).alias("level"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first_offset"), F.lit(0).cast("long").alias("end_offset"), "digest",
        F.lit(None).cast("long").alias("record_id"), F.lit(False).alias("is_root"),
    )
    return trees.unionByName(node(groups, F.col("group"), -1)).unionByName(node(root, F.lit(""), -2))


def stored_trees(spark: SparkSession, folder: str, fan_out: int = FAN_OUT) -> DataFrame:
    """All nodes of a replica as a table partitioned by level, so that a level is read without the others."""
    files = stored(build_trees(spark, folder, fan_out), "files")
    at = new_folder(spark, "tree")
    with_tops(files).write.partitionBy("level").parquet(at)
    return spark.read.schema(files.schema).parquet(at)


def compare_trees(left: DataFrame, right: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The leaves on which two replicas' trees (of stored_trees()) differ: (path, n, status, left and right offsets, digests and record numbers).

    status is changed, only_left or only_right. The replicas' roots are compared first, then groups of files, then the roots of files in the groups that
    differ; below, only children of nodes that differ are.
    Files that one side lacks give all its leaves. If the trees have unlike heights, the comparison starts at the roots' level of
    the lower one. The leaves found are paired by offset; a replica in which bytes are inserted or removed differs from there on.
    """
    keys = ["path", "level", "n"]
    tag = lambda t, s: t.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("first_offset", "end_offset", "digest", "record_id")], F.lit(True).alias(f"in_{s}"))
    one, two = tag(left, "left"), tag(right, "right")
    tops = [t.where("level = -2").agg(F.max("digest")).head()[0] or "" for t in (left, right)]
    if tops[0] == tops[1]:
        return _differences(one, two, keys).where("false")
    groups = lambda t, s: t.where("level = -1").select("path", F.col("digest").alias(s))
    odd_groups = groups(left, "l").join(groups(right, "r"), "path", "full_outer").where("l is null or r is null or l <> r").select(F.col("path").alias("group"))
    group = F.pmod(F.xxhash64("path"), F.lit(GROUPS)).cast("string")
    roots = lambda t, s: t.where("level >= 0 and is_root").select("path", F.col("level").alias(f"{s}_level"), F.col("digest").alias(f"{s}_root"))
    files = roots(left, "left").join(roots(right, "right"), "path", "full_outer").withColumn("group", group).join(small(odd_groups), "group", "left_semi")
    odd = stored(files.where("left_root is null or right_root is null or left_root <> right_root").select("path", F.least("left_level", "right_level").alias("level")), "odd")
    names = [r[0] for r in odd.select("path").limit(LISTED + 1).collect()]
    if len(names) <= LISTED:  # few enough for the scans to skip all other files' nodes
        one, two = (t.where(F.col("path").isin(names)) for t in (one, two))
    found = odd.agg(F.max("level")).head()[0]
    start = odd.select("path", "level")
    open_nodes = None
    for level in range(found, -1, -1):
        here = start.where(F.col("level") == level).select("path").distinct()
        sides = []
        for t in (one, two):
            rows = t.where(F.col("level") == level)
            now = rows.join(here, "path", "left_semi")
            if open_nodes is not None:
                now = now.unionByName(_children(rows, open_nodes, fan_out))
            sides.append(now)
        changed = stored(_differences(*sides, keys), "differing")
        if level == 0:
            return _by_offset(changed)
        open_nodes = changed.select("path", "n")
    raise ValueError("a tree has no leaves")


def _children(rows: DataFrame, parents: DataFrame, fan_out: int) -> DataFrame:
    up = parents.select("path", F.col("n").alias("up"))
    return rows.withColumn("up", F.floor(F.col("n") / fan_out)).join(up, ["path", "up"], "left_semi").drop("up")


def _by_offset(changed: DataFrame) -> DataFrame:
    """Differing leaves paired anew by their offsets, so that a record that damage has split leaves those behind it alone."""
    side = lambda s: changed.where(f"{s}_digest is not null").select("path", F.col(f"{s}_first_offset").alias("at"), F.col("n").alias(f"{s}_n"), *[f"{s}_{c}" for c in ("first_offset", "end_offset", "digest", "record_id")], F.lit(True).alias(f"in_{s}"))
    both = side("left").join(side("right"), ["path", "at"], "full_outer").withColumn("n", F.coalesce("left_n", "right_n"))
    return _told(both)


def _differences(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    return _told(one.join(two, keys, "full_outer"))


def _told(both: DataFrame) -> DataFrame:
    status = F.when(F.col("in_right").isNull(), F.lit("only_left")).when(F.col("in_left").isNull(), F.lit("only_right")).otherwise(F.lit("changed"))
    odd = both.where("left_digest is null or right_digest is null or left_digest <> right_digest")
    return odd.withColumn("status", status).select(
        "path", "n", "status", "left_first_offset", "left_end_offset", "right_first_offset", "right_end_offset", "left_digest", "right_digest", "left_record_id", "right_record_id"
    )


def audit(spark: SparkSession, left_folder: str, right_folder: str, fan_out: int = FAN_OUT) -> DataFrame:
    """Where two replicas of a folder of WARC files differ: compare_trees() over the stored trees of both. Equal or empty folders give no rows."""
    return compare_trees(stored_trees(spark, left_folder, fan_out), stored_trees(spark, right_folder, fan_out), fan_out)
