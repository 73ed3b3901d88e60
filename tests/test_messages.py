"""Titles, names, aliases and per-source rules of messages on small fixtures."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import messages, provenance, search, topics


def test_titles_and_names(spark):
    sent = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, None)], "id int, raw_chat_id string")
    chats = spark.createDataFrame([("c1", " ", 0), ("c1", "later", 2), ("c1", "first", 1)], "raw_chat_id string, title string, seq int")
    assert {r.id: r.title for r in messages.with_titles(sent, chats).collect()} == {1: "first", 2: None, 3: None}
    known = spark.createDataFrame([("+1", "a@s", "Bo"), (None, "a@s", "Al"), ("+1", None, " "), ("+1", None, "Bo ")], "phone string, jid string, display_name string")
    entities = spark.createDataFrame([("+1",), ("a@s",), ("x",)], "identifier string")
    assert {r.identifier: r.names for r in messages.contact_names(entities, known).collect()} == {"+1": ["Bo"], "a@s": ["Al", "Bo"], "x": None}


def test_aliases(spark):
    cited = spark.createDataFrame([("d", 0, "E001"), ("d", 1, "id1"), ("d", 2, "E009"), ("o", 0, "E001")], "document_id string, position int, evidence_id string")
    aliases = spark.createDataFrame([("d", "E001", "id1")], "document_id string, alias string, real_id string")
    assert sorted((r.document_id, r.evidence_id) for r in topics.with_real_ids(cited, aliases).collect()) == [("d", "E009"), ("d", "id1"), ("o", "E001")]


def test_rules_by_source(spark):
    rows = [("report_csv", " ", " "), ("report_xml", "x", "t"), ("export", None, ""), ("store", " g@g.us ", " ")]
    df = spark.createDataFrame(rows, "source string, chat string, text string")
    got = df.select(messages.chat_identifier(F.col("source"), F.col("chat")).alias("c"), messages.text_content(F.col("source"), F.col("text")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, "t"), ("chat_1", ""), ("g@g.us", " ")]


def test_members_stay_inside(spark):
    names = ["a/b.txt", "../x", "a/./b", "C:x", "/etc", "~x", "a..b", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [bool(r[0]) for r in df.select(messages.safe_member(F.col("n"))).collect()] == [True, False, False, False, False, False, True, False, False]


def test_image_states(spark):
    cases = [("IMAGE", None, None, None, None, "IMAGE_NOT_FOUND"), ("IMAGE", "a.jpg", None, None, None, "OCR_NOT_RUN"), ("TEXT", "b.PNG", None, None, None, "OCR_NOT_RUN"), ("TEXT", None, "SUCCESS", None, "words", "OCR_TEXT_EXTRACTED"),
             ("IMAGE", "a", "SUCCESS", None, " ", "OCR_NO_TEXT"), ("IMAGE", "a", "NO_TEXT", None, None, "OCR_NO_TEXT"), ("IMAGE", "a", "FAILED", "OCR_UNAVAILABLE", None, "OCR_UNAVAILABLE"), ("IMAGE", "a", "FAILED", None, None, "OCR_FAILED"), ("TEXT", "a.mp3", None, None, None, None)]
    df = spark.createDataFrame(cases, "kind string, reference string, status string, reason string, text string, want string")
    assert all(r.got == r.want for r in df.select("want", messages.image_state(*[F.col(c) for c in df.columns[:5]]).alias("got")).collect())


def test_invariants(spark):
    topics = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "document_id string, n int")
    assert {r.n for r in provenance.provenance_errors(topics, topics.where("n = 1").select("document_id")).collect()} == {2, 3}
    told = spark.createDataFrame([("t1", "PRESENT"), ("t2", "ABSENT")], "topic string, actual string")
    truth = spark.createDataFrame([("t1", "ABSENT"), ("t3", "ABSENT")], "topic string, expected string")
    assert [tuple(r) for r in provenance.with_truth(told, truth, ["topic"]).collect()] == [("t1", "PRESENT", "ABSENT")]
    sections = search.evidence_sections(spark.createDataFrame([(1, "Ciao a tutti", "it", "s"), (2, "hello", "en", "s"), (2, "again", "IT", "t")], "doc_id long, text string, lang string, source string"))
    assert search.integrity_errors(sections.where("source_name = 's'")).count() == 0 and search.checked_index(sections.where("source_name = 's'")).count() == 2
    twice = sections.unionByName(sections)
    with pytest.raises(ValueError, match="isn't unique"):
        search.checked_index(twice)
    assert {r.seq for r in search.search_form(sections, " ciao ", language="it").collect()} == {1} and search.search_form(sections, "  ").count() == 0
    assert search.search_form(sections, "a", source_type="TUTTI", language="tutte", source_name="t").count() == 1 and search.form_filter(sections, language="IT").count() == 1
    with pytest.raises(ValueError):
        search.search_form(sections, "x", mode="OTHER")


def test_sizes(spark):
    df = spark.createDataFrame([("x" * 301, "y" * 200), ("x" * 300, None)], "a string, b string")
    got = df.select(T.shortened(F.col("a")).alias("s"), T.framing_tokens(F.col("a"), F.col("b")).alias("f")).collect()
    assert [len(r.s) for r in got] == [300, 300] and got[0].s.endswith("x...") and [r.f for r in got] == [245, 164]
    assert df.select(T.framing_tokens(F.lit("abc"))).head()[0] == 85
