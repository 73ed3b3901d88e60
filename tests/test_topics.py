"""Topics, greetings, phrases and labels on small fixtures."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import search, topics


def values(spark, fold, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t"))).collect()]


def test_text_functions(spark):
    assert values(spark, T.is_media_placeholder, ["<Media omessi>", " IMG-20250101-WA0001.jpg (file allegato)", "a.pdf (allegato)", "", None, "hello"]) == [True, True, True, True, True, False]
    assert values(spark, T.is_greeting, ["Ciao, come stai?", "Ehilà!", "come stai bene", "ciao mario", "bene", "", None]) == [True, True, True, False, False, False, False]
    assert values(spark, T.domain_stems, ["Acquisto del laptop 2", "Treni ferroviari", ""]) == [["portatil"], ["tren"], []]
    assert values(spark, T.bare_label, ["Label: 'Viaggio'", "topic=", "Tema"]) == ["Viaggio", "topic=", "Tema"]
    assert values(spark, T.safe_int, ["3.9", "NaN", "inf", "x", None, "-2"]) == [3, None, None, None, None, -2]
    assert values(spark, T.iso_timestamp, ["2025-01-02T03:04:05+02:00", "1", "0", "N/D", None]) == ["2025-01-02T01:04:05Z", "1970-01-01T00:00:01Z", None, None, None]


@pytest.mark.parametrize("widths", [(9, 6, 4, 2, 1), (2,)])
def test_phrases_equal_a_plain_scan(spark, widths):
    base = "Der schnelle Zug, die fünf Kühe und l'été a commencé".split()
    texts = [" ".join(base[i:] + base[:i]) for i in range(len(base))] + ["x" + " ".join(base) + "y", "", None, "zz"]
    phrases = [" ".join(base[i : i + n]) for n in widths for i in range(0, len(base) - n)] + ["ug, d", "é", "zz", " ", None, "12"]
    sections = search.evidence_sections(spark.createDataFrame([(n, t, "de", "s") for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))
    wanted = spark.createDataFrame(list(enumerate(phrases)), "id long, phrase string")
    got = sorted((r.seq, r.id) for r in search.phrase_matches(sections, wanted, "id").collect())
    assert got == sorted((n, m) for n, t in enumerate(texts) if t for m, p in enumerate(phrases) if p and p.strip() and p.lower() in t.lower())


def test_accepted(spark):
    said = {"e1": "Il mutuo è stato chiesto", "e2": "<Media omessi>", "e3": "Ciao come stai", "e4": "Non abbiamo aperto pratiche"}
    sections = spark.createDataFrame([(k, "ORIGINAL_TEXT", v) for k, v in said.items()], "evidence_id string, source_type string, text string")
    rows = [("Mutuo", ["e1", "e2", "nope"]), ("Saluti", ["e1"]), ("Assenza di mutui", ["e1"]), ("Media", ["e2"]), ("Auguri", ["e3"]), ("Pratica", ["e4"]), ("Rinuncia", ["e4"]), ("", ["e1"])]
    df = spark.createDataFrame([("d", n, *r) for n, r in enumerate(rows)], "document_id string, topic_no int, label string, evidence_ids array<string>")
    assert sorted((r.label, r.evidence_ids) for r in topics.accepted(df, sections).collect()) == [("Mutuo", ["e1"]), ("Rinuncia", ["e4"])]
