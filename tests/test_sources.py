import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.repetition import degenerate
from colloquy.operators import records as R
from colloquy.operators.search import SearchQuery
from colloquy.sources import chats


def test_export(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("noise\n01/02/2024, 10:00 - Ann: hello\nsecond line\n[01/02/2024, 10:01:02] Bob: see <attached: a.jpg>\n01/02/2024, 10:02 - Messages are end-to-end encrypted\n")
    rows = chats.read(spark, "export", str(tmp_path)).orderBy("line_start").collect()
    assert [r.sender for r in rows] == ["Ann", "Bob", None]
    assert rows[0].text == "hello\nsecond line" and rows[1].attachment_name == "a.jpg" and rows[2].is_system
    assert [r.source_record_id for r in rows] == ["msg_1", "msg_2", "msg_3"]


def test_report_json(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"id": "a", "chat_id": "c", "sender": "+39", "timestamp": "2024-01-01T00:00:00Z", "type": "text", "content": {"text": "hi", "media_path": " "}}, {"chat_id": "c"}]))
    rows = chats.read(spark, "report_json", str(tmp_path)).orderBy("source_record_id").collect()
    assert [r.source_record_id for r in rows] == ["a", "item:1"] and rows[0].media_reference is None


def test_report_xml_and_csv(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<DumpFile type="UFDR"><InstantMessages><Message id="m1"><Timestamp>t</Timestamp><Sender>s</Sender><Body>b</Body></Message></InstantMessages></DumpFile>')
    assert chats.read(spark, "report_xml", str(tmp_path / "r.xml")).collect()[0].source_record_id == "m1"
    (tmp_path / "r.csv").write_text('Source,Body\nx,"two\nlines"\n')
    assert chats.read(spark, "report_csv", str(tmp_path / "r.csv")).collect()[0].Body == "two\nlines"
    with pytest.raises(ValueError):
        chats.read(spark, "other", "x")


def test_functions(spark):
    rows = spark.createDataFrame([("+39 333 (12)34",), ("++391",), ("0039",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.canonical_phone(F.col("x"))).collect()] == ["+393331234", None, None, None]
    one = spark.createDataFrame([("ab " * 7, "x" * 15, "C:\\Users\\me\\f /home/me/g")], "a string, b string, c string")
    got = one.select(degenerate(F.col("a")), degenerate(F.col("b")), T.redacted_paths(F.col("c")), T.fully_normalized("a")).head()
    assert got[0] and got[1] and got[2] == "<USER_HOME>\\f <USER_HOME>/g" and got[3].startswith("ab ")


def test_actor(spark):
    rows = spark.createDataFrame([("1@s.net",), ("LOCAL_USER",), ("group_participant_1",), ("+39123456",), (" ",)], "x string")
    got = [r[0] for r in rows.select(R.actor(F.col("x"))).collect()]
    assert [g and g.kind for g in got] == ["jid", "local_user", "alias", "phone", None] and got[0].jid_domain == "s.net"


def test_query_object():
    with pytest.raises(ValueError):
        SearchQuery(" ")
    with pytest.raises(ValueError):
        SearchQuery("a", limit=0)
