"""Serialized conversations, answers, chunks, verdicts and provenance on fixtures."""

import hashlib
import json

from pyspark.sql import functions as F

from colloquy.operators import chunks, exports, provenance, serialization, topics, verdicts


def column(spark, values, f):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, x string").select("n", f(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["n"])]


def test_serialized_texts_are_json_and_savings_are_their_lengths(spark):
    schema = "doc string, seq long, message_id string, alias string, evidence_id string, sender string, source_type string, source_name string, source_record_id string, language string, ordinal int, text string"
    said = 'a "quote", a \\ and\na line é 😀'
    rows = spark.createDataFrame(
        [
            ("d", 2, "m2", "E002", "m2::O", " ", "AUDIO_TRANSCRIPT", "s", "2", None, 0, "<Media omessi>"), ("d", 1, "m1", "E001", "m1::O", "Ann", "ORIGINAL_TEXT", "s", "1", "it", 0, said),
            ("d", 3, "m3", "E003", "m3::O", None, "ORIGINAL_TEXT", "s", "3", None, 0, "<Media omessi>"), ("empty", 1, "m9", None, None, None, None, "s", "9", None, 0, None),
        ],
        schema,
    )
    got = {r["doc"]: r for r in serialization.serialized(rows, ["doc"], F.col("doc")).collect()}
    full = json.loads("\n".join(got["d"]["full"].split("\n")[1:-1]))
    assert (full["document_id"], full["total_bundles"], full["total_evidence_sections"]) == ("d", 3, 3)
    assert [s["text"] for s in full["evidence_sections"]] == [said, "<Media omessi>", "<Media omessi>"]
    assert "\n".join(got["d"]["full"].split("\n")[1:-1]) == json.dumps(full, ensure_ascii=False, indent=2)
    lines = [json.loads(line) for line in got["d"]["compact"].split("\n")[1:-1]]
    assert lines[0] == {"id": "E001", "msg_id": "m1", "sender": "Ann", "text": said}
    assert lines[1] == {"id": "E002", "msg_id": "m2", "source_type": "AUDIO_TRANSCRIPT", "text": "<Media omessi>"}
    assert lines[2] == {"id": "E003", "msg_id": "m3", "media_placeholder": True, "text": "<Media omessi>"}
    assert json.loads("\n".join(got["empty"]["full"].split("\n")[1:-1]))["evidence_sections"] == []
    for r in serialization.savings(rows, ["doc"], F.col("doc")).collect():
        # characters beyond the basic plane count as one in both
        assert (r["full_chars"], r["compact_chars"]) == (len(got[r["doc"]]["full"]), len(got[r["doc"]]["compact"]))
    assert serialization.serialized(rows.limit(0), ["doc"], F.col("doc")).collect() == []


def test_answers_are_mended_outside_strings_only(spark):
    values = ['{"a": ""}', '{""a"": 1}', '{"a": "x"",\n "b": "",}', '{" a ": [1,],}', '{"a": "x,]",}', '{"a": "say \\"hi\\"",}', '{"a": ', None]
    assert column(spark, values, topics.repaired) == ['{"a": ""}', '{"a": 1}', '{"a": "x",\n "b": ""}', '{"a": [1]}', '{"a": "x,]"}', '{"a": "say \\"hi\\""}', None, None]


def test_discovery_answers(spark):
    topic = lambda **k: json.dumps({"topics": [{"label": "l", "short_description": "d", "evidence_ids": ["E1"]} | k]})
    values = [
        topic(), topic(extra=1), topic(label=" "), topic(short_description=None), topic(evidence_ids="E1"), topic(evidence_ids=[]), topic(evidence_ids=["E1", " "]), topic(evidence_ids=["E1", "E1"]),
        '{"topics": []}', '{"topics": [1]}', '{"topics": {}}', '{"other": []}', "[]", "no", None, json.dumps({"topics": [{}] * 11}), topic(evidence_ids=None),
    ]
    assert column(spark, values, lambda c: topics.discovery_answer(c)["error"]) == [
        None, "TOPIC_KEYS_MISMATCH", "LABEL_INVALID", "DESCRIPTION_INVALID", "EVIDENCE_IDS_NOT_LIST", "EVIDENCE_IDS_EMPTY", "EVIDENCE_ID_NOT_STRING", "EVIDENCE_IDS_DUPLICATED",
        None, "TOPIC_NOT_OBJECT", "TOPICS_NOT_LIST", "TOP_KEYS_MISMATCH", "NOT_AN_OBJECT", "INVALID_JSON", "INVALID_JSON", "TOPIC_COUNT_EXCEEDS_LIMIT", "EVIDENCE_IDS_NOT_LIST",
    ]


def test_chunks_stream_over_conversations(spark):
    texts = [("a", n, "x" * size) for n, size in enumerate((5, 5, 40, 1, 1, 1, 1, 9, 2))] + [("b", 0, None), (None, 0, "x"), (None, 1, "x" * 50)]
    got = chunks.chunks(spark.createDataFrame(texts, "conv_id string, seq int, text string"), 10, 3, 10**6).collect()
    of = lambda k: [r["chunk"] for r in sorted((r for r in got if r["conv_id"] == k), key=lambda r: r["seq"])]
    assert (of("a"), of("b"), of(None)) == ([0, 0, 1, 2, 2, 2, 3, 3, 4], [0], [0, 1])
    assert chunks.chunks(spark.createDataFrame([], "conv_id string, seq int, text string")).collect() == []


def test_verdicts_and_their_evidence(spark):
    rows = [("p", "PRESENT", "e2", 2), ("p", "PRESENT", "e1", 1), ("p", "PRESENT", "e2", 3), ("p", "ABSENT", "e0", 0), ("f", None, "e1", 1), ("f", "UNCERTAIN", "e2", 2), (None, "UNCERTAIN", "e3", 1), ("a", "ABSENT", "e4", 1)]
    df = spark.createDataFrame(rows, "k string, decision string, evidence_id string, seq int")
    assert {r["k"]: (r["n_parts"], r["n_failed"], r["decision"]) for r in verdicts.aggregated(df, ["k"]).collect()} == {"p": (4, 0, "PRESENT"), "f": (2, 1, "UNCERTAIN"), None: (1, 0, "UNCERTAIN"), "a": (1, 0, "ABSENT")}
    assert {tuple(r) for r in verdicts.verdict_evidence(df, ["k"]).collect()} == {("p", "e1", 1), ("p", "e2", 2), (None, "e3", 1)}


def test_translations(spark):
    sections = spark.createDataFrame([("d", "e1", "m", "x"), ("d", "e2", "m", " "), ("d", "e3", "m", None)], "document_id string, evidence_id string, message_id string, text string")
    given = spark.createDataFrame([("d", "e1", "tradotto"), ("d", "e2", ""), ("d", "e3", None)], "document_id string, evidence_id string, translated_text string")
    assert [tuple(r) for r in provenance.translation_errors(sections, given).collect()] == [("d", "e3", "MISSING")]
    assert [tuple(r) for r in provenance.translated_size_errors(sections, given).collect()] == [("d", "m", "MISSING", 8)]
    some = sections.where("evidence_id < 'e3'")
    assert {r["text"] for r in provenance.translated(some, given).collect()} == {"tradotto", ""}
    assert {tuple(r)[2] for r in provenance.translated_size_errors(some, given, 7).collect()} == {"SECTION_TOO_LONG"}


def test_exported_values(spark):
    of = lambda text: "ev_" + hashlib.sha256(text.encode()).hexdigest()[:12]
    assert column(spark, [" E12 ", "E1234567", "+39 333", "", None], exports.shown_evidence_id) == ["E12", of("E1234567"), of("+39 333"), "E_UNKNOWN", "E_UNKNOWN"]
    assert column(spark, ["Disk_Backed", "elsewhere", None], lambda c: exports.shown(c, "loading_mode")) == ["DISK_BACKED", "IN_MEMORY_EXECUTION", "IN_MEMORY_EXECUTION"]
    bodies = ['{"error": {"message": "n_ctx is 4096"}}', '{"error": "llama_decode"}', '{"message": "?"}', "", None]
    assert column(spark, bodies, lambda c: exports.http_error(F.lit(400), c)) == ["CONTEXT_OVERFLOW", "INFERENCE_BACKEND_ERROR", "UNCLASSIFIED_HTTP_ERROR", "UNCLASSIFIED_HTTP_ERROR", "UNCLASSIFIED_HTTP_ERROR"]
    assert column(spark, bodies[:2], lambda c: exports.http_error(F.lit(500), c)) == ["SERVER_ERROR", "INFERENCE_BACKEND_ERROR"]
