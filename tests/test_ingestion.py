"""Sources of all kinds written by the test, recognised, read in blocks, and ingested."""

import csv
import json
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.operators import ingestion
from colloquy.sources import chats, raw, scan, sniff


@pytest.fixture
def blocks(spark):
    """Text files cut into blocks of 700 bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write_sources(folder):
    put = lambda name, data: (folder / name).write_bytes(data)
    put("chat.bin", "﻿01/02/2024, 10:00 - Ann: hello\r\n\r\nmore\r\n01/02/2024, 10:01 - Bob: see é\r\n".encode())
    put("latin.txt", "01/02/2024, 10:00 - Añn: hello ñ “x”\n01/02/2024, 10:01 - Bob: sí\n".encode("cp1252"))
    put("wide.txt", "01/02/2024, 10:00 - Ann: hello ñ\n01/02/2024, 10:01 - Bob: sí\n".encode("utf-16"))
    item = {"id": "a", "chat_id": "c", "sender": "+39333111", "timestamp": "2024-01-01T00:00:00Z", "type": "text", "content": {"text": "hi", "media_path": " "}, "metadata": {"deleted": True}}
    put("r.json", json.dumps([item, {"chat_id": "c", "sender": "Bo", "timestamp": "x", "type": "image"}], indent=1).encode())
    put("r.csv", b'Source,MessageType,TimeStamp,Direction,ChatId,From,To,Body,Attachments,Deleted\nW,Text,2024-01-01T00:00:00,In,c9,+39 333 111,LOCAL_USER,"two\nlines, ""q""",,False\nW,Text,2024-01-01T00:00:01,In,c9,+39 333 111,LOCAL_USER,x,p.jpg,True\n')
    put("r.xml", b'<DumpFile type="UFDR"><InstantMessages><Message id="m1"><Timestamp>2024-01-01T00:00:00</Timestamp><Sender>0012</Sender><Body> b </Body><Deleted>false</Deleted></Message><Message><Sender>z</Sender></Message></InstantMessages></DumpFile>')
    with sqlite3.connect(folder / "m.dat") as db:
        db.execute("CREATE TABLE messages (_id INTEGER, key_remote_jid TEXT, key_from_me INT, key_id TEXT, data TEXT, timestamp INT, media_url TEXT, media_wa_type INT, remote_resource TEXT, deleted INT)")
        db.execute("INSERT INTO messages VALUES (1,'39333111@s.whatsapp.net',0,'k','hi',1704067200000,NULL,0,NULL,0)")
        db.execute("CREATE TABLE chat_list (_id INTEGER, key_remote_jid TEXT, subject TEXT)")
    with sqlite3.connect(folder / "c.dat") as db:
        db.execute("CREATE TABLE contacts (_id INTEGER, jid TEXT, display_name TEXT, phone_number TEXT, status TEXT)")
        db.execute("INSERT INTO contacts VALUES (1,'39333111@s.whatsapp.net','A','+39 333 111','busy')")
    with zipfile.ZipFile(folder / "e.zip", "w") as z:
        z.writestr("_chat.txt", "[01/02/2024, 10:00:00] Ann: zip <attached: a.jpg>\n[01/02/2024, 10:00:05] Bob: y\n")
        z.writestr("notes.txt", "nothing here")
    with zipfile.ZipFile(folder / "two.zip", "w") as z:
        z.writestr("a.txt", "01/02/2024, 10:00 - A: x\n")
        z.writestr("b.txt", "01/02/2024, 10:00 - A: x\n")
    put("broken.json", b'[{"chat_id": ')
    put("evil.xml", b'<!DOCTYPE x [<!ENTITY a "b">]><DumpFile type="UFDR"><InstantMessages/></DumpFile>')
    put("bad.zip", b"PK\x03\x04nothing")
    put("bad.db", b"SQLite format 3\x00junk" * 30)
    put("pic.jpg", bytes(range(256)) * 40)
    put("empty.txt", b"")


def name(column="file"):
    return F.regexp_extract(column, "([^/]*)$", 1)


def test_ingest(spark, tmp_path):
    write_sources(tmp_path)
    got = ingestion.ingest(spark, str(tmp_path))
    kinds = {r.f: (r.kind, r.charset, r.transcript) for r in got.files.withColumn("f", name()).collect()}
    assert kinds == {
        "chat.bin": ("export", "utf-8-sig", None), "latin.txt": ("export", "cp1252", None), "wide.txt": ("export", "utf-16", None), "r.json": ("report_json", "utf-8", None), "r.csv": ("report_csv", "utf-8", None),
        "r.xml": ("report_xml", "utf-8", None), "m.dat": ("store", None, None), "c.dat": ("contacts", None, None), "e.zip": ("export_zip", None, "_chat.txt"), "two.zip": (None, None, None),
        "broken.json": (None, "utf-8", None), "evil.xml": (None, "utf-8", None), "bad.zip": (None, None, None), "bad.db": (None, None, None), "pic.jpg": (None, None, None),
    }
    rows = {(r.f, r.record_id): r for r in got.records.withColumn("f", name()).collect()}
    assert rows["chat.bin", "msg_1"].text == "hello\n\nmore" and rows["latin.txt", "msg_1"].text == "hello ñ “x”" and rows["latin.txt", "msg_1"].sender.raw == "Añn" and rows["wide.txt", "msg_2"].text == "sí"
    assert rows["r.csv", "row:2"].text == 'two\nlines, "q"' and rows["r.csv", "row:4"].deleted and rows["r.csv", "row:2"].recipient.kind == "local_user" and rows["r.csv", "row:4"].media_reference == "p.jpg"
    assert rows["r.json", "a"].stamp.status == "KNOWN_UTC" and rows["r.json", "a"].deleted and rows["r.json", "item:1"].message_type == "IMAGE" and rows["r.xml", "m1"].sender.raw == "0012"
    assert rows["r.xml", "m1"].text == " b " and rows["r.xml", "message:1"].sender.raw == "z" and rows["m.dat", "1"].sender.kind == "jid" and rows["e.zip", "msg_1"].message_type == "IMAGE"
    messages = {(r.f, r.seq): r for r in got.messages.withColumn("f", name()).collect()}
    assert messages["r.csv", 1].sender_participant.participant_id == "participant:entity:phone:+39333111" and messages["r.csv", 1].chat.chat_id == "chat:report_csv:c9"
    assert messages["latin.txt", 2].duplicate_ids == messages["wide.txt", 2].duplicate_ids == ["duplicate_candidate:1"] and len(messages) == 15
    status = {r.f: (r.n_messages, r.n_auxiliary, r.status) for r in got.summary().withColumn("f", name()).collect()}
    assert status["c.dat"] == (0, 1, "AUXILIARY_ONLY") and status["m.dat"] == (1, 0, "SUCCESS") and status["pic.jpg"] == (0, 0, "UNSUPPORTED")
    assert {r.chat_key for r in got.conversations.collect()} == {"chat_1", "c9", "c", "UNRESOLVED", "39333111@s.whatsapp.net"}
    assert sniff.can_import(spark, str(tmp_path / "r.csv"), "report_csv") and not sniff.can_import(spark, str(tmp_path / "bad.db"), "store") and not sniff.can_import(spark, str(tmp_path / "none"), "store")


def test_nothing_to_ingest(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\x00\x01")
    got = ingestion.ingest(spark, str(tmp_path))
    assert got.messages.count() == 0 and [r.status for r in got.summary().collect()] == ["UNSUPPORTED"]


def test_export_in_blocks(spark, tmp_path, blocks):
    rng = random.Random(3)
    lines, want = ["before all", ""], []
    for n in range(400):
        body = ["text " + "x" * rng.randint(0, 60)] + [rng.choice(["", "more é", "12 - no: header", "01/02/2024 no"]) for _ in range(rng.choice([0, 0, 1, 3, 30]))]
        want.append((f"msg_{n + 1}", f"P{n % 7}", "\n".join([body[0].strip(), *body[1:]]), len(lines) + 1, len(lines) + len(body)))
        lines += [f"01/02/2024, 10:{n % 60:02d} - P{n % 7}: {body[0]}", *body[1:]]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n", newline=rng.choice(["\n", "\r\n"]))
    read = chats.read_export(spark, str(tmp_path / "a.txt"))
    assert scan.lines(spark, str(tmp_path / "a.txt")).select("block").distinct().count() > 20
    got = [(r.source_record_id, r.sender, r.text, r.line_start, r.line_end) for r in read.orderBy("line_start").collect()]
    assert got == want


def test_csv_in_blocks(spark, tmp_path, blocks):
    rng = random.Random(4)
    rows = [{"a": str(n), "b": rng.choice(["", "x", 'q "quoted"', "two\nlines\n\nand, more", "é" * 200]), "c": rng.choice(["", "1,2", "\n"])} for n in range(300)]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        writer = csv.DictWriter(f, ["a", "b", "c"], lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
    got = raw.csv_rows(spark, str(tmp_path / "t.csv")).orderBy("place").collect()
    assert [r.fields for r in got] == rows
    line = 2
    for r, row in zip(got, rows, strict=True):
        assert r.place == line
        line += 1 + row["b"].count("\n") + row["c"].count("\n")
    (tmp_path / "odd.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="isn't closed"):
        raw.csv_rows(spark, str(tmp_path / "odd.csv")).collect()
    (tmp_path / "few.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="1 cells, the header has 2"):
        raw.csv_rows(spark, str(tmp_path / "few.csv")).collect()
    (tmp_path / "bytes.txt").write_bytes(b"a\xe9b\n")
    with pytest.raises(Exception, match="not UTF-8"):
        scan.lines(spark, str(tmp_path / "bytes.txt")).collect()


def test_sniffing():
    assert [sniff.charset(x) for x in (b"", b"abc", "é".encode() + b"\xc3", b"\xef\xbb\xbfx", "é".encode("utf-16"), "abcd".encode("utf-16le"), b"caf\xe9", b"\x93x\x94", b"a\x81\xe9", b"\x00\x01\x02", b"\x01\x02\x03ab")] == [
        "utf-8", "utf-8", "latin-1", "utf-8-sig", "utf-16", "utf-16le", "latin-1", "cp1252", "latin-1", None, None,
    ]
    assert sniff.charset(b"x" * 65_535 + "é".encode()[:1]) == "utf-8"
    rows = lambda d: "\n".join(d.join(f"{c}{n}" for c in "abcd") for n in range(9))
    assert [sniff.delimiter(rows(d)) for d in ",;\t|"] == list(",;\t|") and sniff.delimiter("one") == ","
    assert sniff.text_kind(b'[ {"chat_id":1,"sender":2,"timestamp":3,"type":4},') == "report_json" and sniff.text_kind(b"[]") is None and sniff.text_kind(b"[3") is None
    assert sniff.text_kind(b'<x:DumpFile xmlns:x="u" type="UFDR"><x:InstantMessages>') == "report_xml" and sniff.text_kind(b"<a><b/>") is None and sniff.text_kind(b"\xff\xfe") is None
