"""Texts that repeat themselves, and answers that aren't JSON, against the rules told by back references and by the JSON parser."""

import json
import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions import jsonfail, repetition
from colloquy.operators import exports


def plain(text):
    """The first repetition by the rules, matched backwards."""
    for kind, pattern in (("CHAR_RUN", r"(\S)\1{14,}"), ("TAB_RUN", r"(\t)\1{11,}")):
        if m := re.search(pattern, text):
            return kind, 1, len(m[0]), len(m[0])
    for m in re.finditer(r"(.{2,25})\1{5,}", re.sub(r"""(?:["']E\d{3,4}["']\s*,\s*){2,}""", "", text)):
        if m[1].strip():
            return "PATTERN_LOOP", len(m[1]), len(m[0]) // len(m[1]), len(m[0])
    return None


def some_text(rng):
    piece = lambda: rng.choice([
        rng.choice("ab \t\nE€\r") * rng.randint(1, 30), "".join(rng.choice("ab \n.") for _ in range(rng.randint(1, 8))) * rng.randint(1, 9), '"E001", ' * rng.randint(1, 9),
        "".join(rng.choice("ab c") for _ in range(rng.randint(10, 27))) * rng.randint(4, 8), "".join(rng.choice("abcdefgh \n") for _ in range(rng.randint(1, 40))),
    ])
    return "".join(piece() for _ in range(rng.randint(0, 9)))


def test_scan_equals_the_rules():
    rng = random.Random(11)
    for _ in range(20):
        texts = [some_text(rng) for _ in range(150)]
        assert repetition.scan(texts) == [plain(t) for t in texts]
    assert repetition.scan([None, "", " " * 40, "ab" * 5, "|    |    |    |\n" * 9]) == [None, None, None, None, None]
    assert repetition.scan(["x" * 15, "x" * 14, "\t" * 12, "ab" * 6, "ab " * 6, "é€" * 7])[0] == ("CHAR_RUN", 1, 15, 15)


def test_memory_is_that_of_a_piece():
    """A batch of many texts takes little more than one piece does; results are those of all texts at once."""
    rng = random.Random(5)
    texts = [None, "", "€" * 400_000, *("".join(rng.choices("abcdefgh €\n", k=20_000)) + rng.choice(["", "ab" * 9]) for _ in range(400)), None]
    batch = pa.array(texts)
    tracemalloc.start()
    try:
        got = repetition.told(repetition.scan, batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 * repetition.PIECE_BYTES < 4 * batch.nbytes
    assert [tuple(r.values()) if r["kind"] else None for r in got.to_pylist()] == repetition.scan(texts)
    assert repetition.told(repetition.scan_answers, pa.array([], pa.string())).to_pylist() == []


def test_answers(spark):
    loop = "spam " * 20
    cases = {
        json.dumps({"topics": [{"label": "ha" * 20}]}): None, json.dumps({"topics": [{"label": loop}]}): "PATTERN_LOOP", json.dumps({"evidence_ids": ["ab" * 8]}): "PATTERN_LOOP",
        json.dumps({"rationale": "\t" * 12}): "TAB_RUN", json.dumps({"a": {"rationale": "x" * 70}}): "CHAR_RUN", '{"a": ' + "[" * 16: "CHAR_RUN", "```json\n{\"label\": \"" + "ha" * 20 + '"}\n```': None,
        json.dumps(["ab" * 9]): "PATTERN_LOOP", "": None, '{"evidence_ids": [' + '"E001", ' * 30 + '"E002"]}': None,
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert {r.a: r.kind for r in df.select("a", repetition.answer_repetition(F.col("a"))["kind"].alias("kind")).collect()} == cases


def test_json_failures(spark):
    rng = random.Random(2)
    whole = json.dumps({"topics": [{"label": "a\\b é", "evidence_ids": ["E001", "x"], "n": -1.5e3}], "t": None, "u": True}, ensure_ascii=False)
    texts = ["", "  \n", None, "[1]", "3", whole] + [whole[:i] + rng.choice(["", "\n", '"', "\\", ",", "}", "\\u12", "1"]) + whole[i + rng.randint(0, 2) :] for i in range(len(whole))]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", jsonfail.json_failure(F.col("t")).alias("f")).select("n", "f.*")
    for r in df.collect():
        text = texts[r.n] or ""
        try:
            value = json.loads(text)
            want = (None if isinstance(value, dict) else "NOT_AN_OBJECT", None, None, None)
        except json.JSONDecodeError as e:
            want = ("EMPTY_RESPONSE", None, None, None) if not text.strip() else (r.kind, e.pos, e.lineno, e.colno)
            assert r.kind in {k for _, k in jsonfail.KINDS} | {"EMPTY_RESPONSE", "OTHER_SYNTAX"}
        assert (r.kind, r.at, r.line, r.column) == want and r.chars == len(text)
    reasons = spark.createDataFrame([(" Stop",), ("length",), ("tool",), (None,)], "x string").select(jsonfail.finish_kind(F.col("x"))).collect()
    assert [r[0] for r in reasons] == ["STOP", "LENGTH", "OTHER", "MISSING"]


def test_http_errors(spark):
    cases = [
        (400, '{"error": {}, "message": "context too long"}', "CONTEXT_OVERFLOW"), (400, '{"error": "no model loaded"}', "MODEL_NOT_LOADED"), (400, '{"message": "bad schema"}', "UNSUPPORTED_STRUCTURED_OUTPUT"),
        (400, "y" * 200 + " context", "UNCLASSIFIED_HTTP_ERROR"), (400, "seed?", "INVALID_PARAMETER"), (503, "llama_decode", "INFERENCE_BACKEND_ERROR"), (500, None, "SERVER_ERROR"), (404, "context", "HTTP_ERROR"),
        (400, '["context"]', "CONTEXT_OVERFLOW"), (429, "", "RATE_LIMIT_EXCEEDED"),
    ]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, status int, body string, want string")
    assert all(r.got == r.want for r in df.select("want", exports.http_error(F.col("status"), F.col("body")).alias("got")).collect())
