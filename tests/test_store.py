"""The keyed store, staged tables, containment and media in archives."""

import os
import posixpath
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.operators import chunks, containment, ingestion, staging
from colloquy.sources import media
from colloquy.sources.store import KeyedStore


def rows(spark, data):
    return spark.createDataFrame(data, "doc string, chunk int, value string, at int")


def test_store_against_a_dict(spark, tmp_path):
    store, want, rng = KeyedStore(spark, str(tmp_path / "s"), ["doc", "chunk"], 4), {}, random.Random(1)
    assert store.read() is None and store.delete(rows(spark, [("a", 1, "x", 1)]).select("doc")) == 0
    for step in range(4):
        data = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 2, None]), f"v{step}-{n}", step * 100 + n) for n in range(6)]
        for d, c, v, at in data:
            want[d, c] = (v, at)
        store.write(rows(spark, data), ["at"])
        assert {(r.doc, r.chunk): (r.value, r["at"]) for r in store.read().collect()} == want
        assert store.read().count() == len(want)
    store.write(rows(spark, data), ["at"])
    assert {(r.doc, r.chunk): (r.value, r["at"]) for r in store.read().collect()} == want
    gone = [k for k in want if k[0] == "a"]
    assert store.delete(spark.createDataFrame([("a",)], "doc string")) == len(gone)
    want = {k: v for k, v in want.items() if k[0] != "a"}
    assert {(r.doc, r.chunk) for r in store.read().collect()} == set(want)
    left = store.missing(rows(spark, [("a", 0, "", 0), ("b", 77, "", 0), *[(d, c, "", 0) for d, c in want]])).collect()
    assert {(r.doc, r.chunk) for r in left} == {("a", 0), ("b", 77)}
    everything = store.read().select("doc", "chunk").collect()
    store.delete(spark.createDataFrame([tuple(r) for r in everything], "doc string, chunk int"))
    assert store.read() is None or store.read().count() == 0


def test_store_keeps_the_old_rows_of_a_failed_write(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["doc"], 2)
    store.write(rows(spark, [("a", 1, "old", 1), ("b", 1, "old", 1)]))
    broken = rows(spark, [("a", 1, "new", 2), ("b", 1, "bad", 2)]).withColumn("value", F.when(F.col("value") == "bad", F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        store.write(broken)
    assert {r.doc: r.value for r in store.read().collect()} == {"a": "old", "b": "old"}


def test_register(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "r"), ["doc", "chunk"], 2)
    store.register(rows(spark, [("a", 1, "x", 1)]))
    store.register(rows(spark, [("a", 1, "x", 1), ("a", 2, "y", 1)]))
    with pytest.raises(ValueError, match="registered with other values"):
        store.register(rows(spark, [("a", 1, "z", 1), ("a", 3, "y", 1)]))
    assert {(r.doc, r.chunk, r.value) for r in store.read().collect()} == {("a", 1, "x"), ("a", 2, "y")}


def test_staged_tables_need_no_shuffle(spark):
    turns = spark.createDataFrame([(c, t, "user", "x" * (t % 50)) for c in range(7) for t in range(120)], "conv_id long, turn long, role string, text string")
    messages = chunks.unified_messages(turns)
    want = {(r.conv_id, r.seq): r.chunk for r in chunks.chunks(messages, 500, 20).collect()}
    try:
        staged = staging.stage(messages, "staged_messages", "conv_id", ["seq"], 4)
        found = chunks.chunks(staged, 500, 20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and {(r.conv_id, r.seq): r.chunk for r in found.collect()} == want
        listed = chunks.conversation_list(staged)
        assert "Exchange" not in listed._jdf.queryExecution().executedPlan().toString() and listed.count() == 7
        assert [r[0] for r in staging.staged_keys(spark, "staged_messages", "conv_id").collect()] == list(range(7))
    finally:
        spark.sql("DROP TABLE IF EXISTS staged_messages")


def test_containment(spark):
    rng = random.Random(5)
    paths = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "", "c.jpg"]) for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["/", "//x//", "/..", "/a/../../b"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", containment.resolved_path(F.col("p")).alias("r"), containment.ancestors(containment.resolved_path(F.col("p"))).alias("a")).collect()
    for r in got:
        want = "/" + posixpath.normpath(r.p).lstrip("/")
        assert r.r == (want if want != "/." else "/")
        assert set(r.a) == {"/", *("/" + "/".join(r.r.split("/")[1 : n + 1]) for n in range(1, r.r.count("/") + 1))}
    files = spark.createDataFrame([("/data/in/x.jpg", 5), ("/data/media/y.jpg", 6), ("/etc/passwd", 7), ("/data/media/x.jpg", 8), ("/database/z.jpg", 9)], "path string, size int")
    refs = [
        ("x.jpg", "/data/in/chat.txt", False, "RESOLVED", "/data/in/x.jpg"), ("y.jpg", "/data/in/chat.txt", False, "RESOLVED", "/data/media/y.jpg"), ("../../etc/passwd", "/data/in/chat.txt", False, "OUTSIDE_ALLOWED_ROOT", None),
        ("/etc/passwd", None, False, "OUTSIDE_ALLOWED_ROOT", None), ("/data/media/./x.jpg", None, False, "RESOLVED", "/data/media/x.jpg"), ("/data/none", None, False, "MISSING", None), ("HTTPS://a/b", None, False, "REMOTE_REFERENCE", None),
        (" ", None, False, "NO_REFERENCE", None), (None, None, False, "NO_REFERENCE", None), ("x.jpg", None, True, "AMBIGUOUS", None), ("/database/z.jpg", None, False, "OUTSIDE_ALLOWED_ROOT", None),
        ("x.jpg", "/other/c.txt", False, "RESOLVED", "/data/media/x.jpg"), ("q.jpg", "/other/c.txt", None, "MISSING", None),
    ]
    df = spark.createDataFrame([(n, r, s, a) for n, (r, s, a, _, _) in enumerate(refs)], "message_id int, reference string, source_path string, is_ambiguous boolean")
    told = {r.message_id: (r.state, r.path) for r in containment.media_states(df, ["/data/", "/data/media"], files).collect()}
    want = dict(enumerate((s, p) for *_, s, p in refs))
    want[1], want[11] = ("MISSING", None), ("MISSING", None)  # /data comes before /data/media, and neither has it
    assert {k: v for k, v in told.items() if k not in (1, 11)} == {k: v for k, v in want.items() if k not in (1, 11)}
    assert told[1] == ("RESOLVED", "/data/media/y.jpg") and told[11] == ("RESOLVED", "/data/media/x.jpg")
    assert containment.media_states(df, [], files).where("state = 'RESOLVED'").count() == 0


def test_media_in_archives(spark, tmp_path):
    noise = random.Random(1).randbytes(200_000)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_chat.txt", "text")
        z.writestr("media/é.jpg", b"picture " * 1000)
        z.writestr("b/x.opus", noise, zipfile.ZIP_STORED)
        z.writestr("c/x.opus", b"")
        z.writestr("odd.bin", b"z" * 5000, zipfile.ZIP_BZIP2)
        z.mkdir("folder")
        z.comment = b"c" * 300
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("media/é.jpg", b"other")
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 nothing")
    told = media.archive_members(spark, str(tmp_path))
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        want = {(i.filename, i.file_size, i.compress_size, i.CRC, i.header_offset) for i in z.infolist() if not i.is_dir()}
    assert {(r.member, r["size"], r.packed, r.crc, r["at"]) for r in told.where("file LIKE '%a.zip'").collect()} == want and told.where("file LIKE '%bad.zip'").count() == 0
    names = [("a.zip", "é.jpg"), ("b.zip", "é.jpg"), ("a.zip", "x.opus"), ("a.zip", "b/x.opus"), ("a.zip", "odd.bin"), ("a.zip", "../up"), ("a.zip", None), ("a.zip", "c/x.opus"), ("a.zip", "none.jpg")]
    files = {os.path.basename(r.file): r.file for r in told.select("file").distinct().collect()}
    messages = spark.createDataFrame([(n, files[f], a, "IMAGE" if a and "jpg" in a else "AUDIO") for n, (f, a) in enumerate(names)], "n int, file string, attachment_name string, message_type string")
    found = media.export_media(spark, str(tmp_path), messages)
    got = {r.n: (r.state, None if r.content is None else bytes(r.content), r.error) for r in found.collect()}
    assert got == {0: ("RESOLVED", b"picture " * 1000, None), 1: ("RESOLVED", b"other", None), 2: ("AMBIGUOUS", None, None), 3: ("RESOLVED", noise, None), 4: ("RESOLVED", None, "UNSUPPORTED"), 5: ("OUTSIDE", None, None),
                   6: ("NO_REFERENCE", None, None), 7: ("RESOLVED", b"", None), 8: ("MISSING", None, None)}

    def sizes(contents):
        if contents[0] == b"other":
            raise RuntimeError("can't be read")
        return [f"{len(c)} bytes" if c else " " for c in contents]

    contents = found.select("file", "member", "content", "error").where("member IS NOT NULL").distinct()
    texts = media.with_texts(found.drop("content", "error"), contents, {"IMAGE": sizes, "AUDIO": sizes})
    assert {r.n: (r.derived_status, r.derived_text) for r in texts.collect()} == {0: ("SUCCESS", "8000 bytes"), 1: ("FAILED", None), 2: (None, None), 3: ("SUCCESS", "200000 bytes"), 4: ("FAILED", None), 5: (None, None),
                                                                                    6: (None, None), 7: ("NO_TEXT", None), 8: (None, None)}


def test_stream_equals_one_run(spark, tmp_path):
    source, keys = tmp_path / "in", ["file", "source", "record_id", "record_type"]
    source.mkdir()
    store = KeyedStore(spark, str(tmp_path / "store"), keys, 4)
    for n in range(2):
        (source / f"c{n}.txt").write_text(f"01/02/2024, 10:0{n} - Ann: hello {n}\n01/02/2024, 10:01 - Bob: more\n")
        ingestion.ingest_stream(spark, str(source), store, str(tmp_path / "checkpoint")).awaitTermination()
    told = ingestion.from_records(ingestion.stored_records(store), spark.createDataFrame([], "file string")).messages
    once = ingestion.ingest(spark, str(source)).messages
    shape = lambda df: sorted((r.file, r.seq, r.message_id, r.text) for r in df.collect())
    assert shape(told) == shape(once) and len(shape(once)) == 4
