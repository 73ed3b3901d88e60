"""Files, archives and databases written by the test and read back."""

import hashlib
import sqlite3
import zipfile

from colloquy.sources import chats, files


def test_inventory_and_preflight(spark, tmp_path):
    (tmp_path / "a.txt").write_text("né", "utf-8")
    (tmp_path / "b.txt").write_bytes(b"a\x00b")
    (tmp_path / "c.db").write_bytes(b"no database")
    (tmp_path / "d.csv").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(b"\xef\xbb\xbfx")
    (tmp_path / "f.txt").write_bytes(b"\xe9t\xe9")
    rows = {r.path[-5:]: r for r in files.preflight(spark, str(tmp_path)).collect()}
    assert {k: r.error for k, r in rows.items()} == {"a.txt": None, "b.txt": "NUL_BYTES", "/c.db": "NOT_SQLITE", "e.txt": None, "f.txt": None}
    assert rows["a.txt"].encoding == "utf-8" and rows["e.txt"].encoding == "utf-8-sig" and rows["f.txt"].encoding is None
    listed = files.inventory(spark, str(tmp_path), digests=True)
    assert {r.name: r.sha256 for r in listed.collect()}["a.txt"] == hashlib.sha256("né".encode()).hexdigest()
    assert {r.kind: r.n for r in files.inventory_summary(listed).collect()} == {"text": 4, "database": 1}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("chat.txt", "1/2/25, 10:00 - Ann: hello\nmore\n1/2/25, 10:01 - Bob: yes: no")
        z.writestr("../up.jpg", "x")
        z.writestr("dense.bin", bytes(3 << 20))
    (tmp_path / "y.zip").write_bytes(b"nothing")
    got = {(r.path[-5:], r.member): r.error for r in files.zip_members(spark, str(tmp_path)).collect()}
    assert got == {("x.zip", "chat.txt"): None, ("x.zip", "../up.jpg"): "UNSAFE_NAME", ("x.zip", "dense.bin"): "TOO_DENSE", ("y.zip", None): "NOT_AN_ARCHIVE"}
    told = chats.export_messages(files.zip_lines(spark, str(tmp_path / "x.zip"))).orderBy("line_start").collect()
    assert [(r.sender, r.text) for r in told] == [("Ann", "hello\nmore"), ("Bob", "yes: no")]


def test_sqlite_and_store(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "m.db")
    db.execute("CREATE TABLE messages (_id INTEGER, data TEXT, raw BLOB)")
    db.executemany("INSERT INTO messages VALUES (?, ?, ?)", [(2, "b", None), (1, "a", b"\x01")])
    db.commit()
    db.close()
    rows = files.read_sqlite(spark, str(tmp_path / "m.db"), "messages").selectExpr("place", "get_json_object(fields, '$.data') AS data", "get_json_object(fields, '$.raw') AS raw").orderBy("place").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "01"), (1, "b", None)]
    assert [(r.type, r.name, r.n_rows) for r in files.sqlite_catalog(spark, str(tmp_path / "m.db")).collect()] == [("table", "messages", 2)]
    store = str(tmp_path / "store")
    for value in ("old", "new"):
        files.save_results(spark.createDataFrame([("d1", 0, value)], "doc string, chunk int, value string"), store, ["doc", "chunk"])
    assert [r.value for r in files.latest_results(spark, store, ["doc", "chunk"]).collect()] == ["new"]
    files.write_report(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["a", "b"]
