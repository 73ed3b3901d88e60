"""Topics: search over detections and discoveries, citations, model answers as JSON, acceptance and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, citation_shape, is_greeting, is_media_placeholder, latin_folded, strict_json

#: Labels that are no topics, their beginnings, and what speaks of an action not taken or undone.
BANNED_LABELS = (
    "saluto", "saluti", "saluto e benvenuto", "saluti iniziali", "saluti finali", "saluti e ringraziamenti", "ringraziamenti", "conclusione della conversazione",
    "chiusura della conversazione", "chiusura conversazione", "apertura della conversazione", "apertura conversazione", "comunicazione personale", "conversazione generale",
    "general discussion", "problems and solutions", "file allegato", "media allegato", "allegato multimediale", "omissione media", "media omessi",
)
ABSENCE = r"^(assenza di |mancanza di |nessun |nessuna )"
NEGATION = (
    r"(?iU)\bnon\s+abbiamo\s+mai\s+(?:chiesto|fatto|aperto|comprato|acquistato)\b|\bnon\s+ho\s+pi[uù]\s+(?:acquistato|comprato|prenotato|fatto|chiesto)\b"
    r"|\bnon\s+abbiamo\s+(?:aperto|fatto|chiesto|pratiche)\b|\bnon\s+ho\s+alcuna\s+intenzione\s+di\b|\bho\s+annullato\s+tutto\b"
)
CANCELLATION = r"annullament|cancellazion|rinunci|disdett|dinieg|revoc|rifiut|restituzion|rimbors|\b(reso|resi)\b"
DECISIONS = ("PRESENT", "ABSENT", "UNCERTAIN")


# -- search and citations ---------------------------------------------------------------------------


def search_topics(rows: DataFrame, kind: str, label: str | None = None, topic_id: str | None = None, decision: str | None = None) -> DataFrame:
    """Rows (document_id, topic_id, label, description, decision, evidence_ids) of one kind that pass the filters."""
    text = F.lower(F.concat_ws("\n", "label", "description"))
    out = rows.withColumn("kind", F.lit(kind))
    if label is not None:
        out = out.where(F.contains(text, F.lit(label.lower())))
    if topic_id is not None:
        out = out.where(F.col("topic_id") == topic_id)
    if decision is not None:
        out = out.where(F.col("decision") == decision)
    return out


def cited(topics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, evidence_id) of every citation."""
    return topics.select(*keys, F.posexplode("evidence_ids").alias("position", "evidence_id"))


def resolved(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations with their section; those without one are left out (see hallucinated())."""
    return citations.join(sections, "evidence_id")


def hallucinated(citations: DataFrame, sections: DataFrame) -> DataFrame:
    """Citations of no section; must be empty in a valid answer."""
    return citations.join(sections.select("evidence_id").distinct(), "evidence_id", "left_anti")


def citation_failures(citations: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and shape the number of invalid citations, beside the number of all."""
    known = sections.select("evidence_id", F.lit(True).alias("known")).distinct()
    rows = citations.join(known, "evidence_id", "left").withColumn("shape", F.when(F.col("known").isNull(), citation_shape(F.col("evidence_id"))).otherwise("VALID"))
    return rows.groupBy(*keys, "shape").agg(F.count("*").alias("n"))


def evidence_types(citations: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of citations by source type; NOT_IN_DOCUMENT for those of no section."""
    rows = citations.join(sections.select("evidence_id", "source_type"), "evidence_id", "left")
    return rows.groupBy(*keys, F.coalesce("source_type", F.lit("NOT_IN_DOCUMENT")).alias("source_type")).agg(F.count("*").alias("n"))


def with_real_ids(citations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Citations with aliases (document_id, alias, real_id) replaced; other identifiers stay. Repeats count once."""
    rows = citations.join(aliases.select("document_id", F.col("alias").alias("evidence_id"), "real_id"), ["document_id", "evidence_id"], "left")
    return rows.withColumn("evidence_id", F.coalesce("real_id", "evidence_id")).drop("real_id", "position").distinct()


# -- model answers ----------------------------------------------------------------------------------


def unfenced(raw: Column) -> Column:
    """The JSON text of an answer without a code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[^\n]*\n", ""), r"\n```\s*$", ""))


#: Stuttered quotes: two or more that follow content, or that content follows; those of an empty value stay.
STUTTER = r'(?<=[^\s:,\[{\\])"{2,}|(?<!\\)"{2,}(?=\s*[^\s,}\]])'
#: A text taken apart: strings, and what stands between them.
PIECES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def repaired(text: Column) -> Column:
    """The text if it is JSON, else with stuttered quotes made one, names trimmed and needless commas left out, if that is; else null.

    The text is taken apart into strings and what stands between them, so commas and brackets within strings stay as they are.
    """
    is_string = lambda p: F.startswith(p, F.lit('"')) & (F.length(p) > 1)
    name = lambda p: F.concat(F.lit('"'), F.trim(F.substr(p, F.lit(2), F.length(p) - 2)), F.lit('"'))

    def mended(pieces):
        is_name = lambda i: F.coalesce(F.startswith(F.ltrim(F.get(pieces, i + 1)), F.lit(":")), F.lit(False))
        each = lambda p, i: F.when(is_string(p) & is_name(i), name(p)).when(is_string(p), p).otherwise(F.regexp_replace(p, r",(?=\s*[\]}])", ""))
        return F.array_join(F.transform(pieces, each), "")

    def checked(t):
        again = bound(mended_of(t), lambda out: F.when(strict_json(out).isNotNull(), out))
        return F.when(strict_json(t).isNotNull(), t).otherwise(again)

    mended_of = lambda t: bound(F.regexp_extract_all(F.regexp_replace(t, STUTTER, '"'), F.lit(PIECES), F.lit(0)), mended)
    return bound(text, checked)


def detection_answer(raw: Column, aliased: bool = False) -> Column:
    """{error, decision, evidence_ids, rationale} of an answer; error is null or the first rule that it breaks.

    Exactly the keys decision, evidence_ids and rationale; a known decision; a list of strings, without repeats unless
    aliases are in use; a rationale that isn't blank; evidence for PRESENT and none for ABSENT.
    """
    return bound(repaired(unfenced(raw)), lambda text: bound(strict_json(text), lambda value: _detection(text, value, aliased)))


def _detection(text: Column, value: Column, aliased: bool) -> Column:
    kind = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    decision, rationale = F.trim(F.try_variant_get(value, "$.decision", "string")), F.trim(F.try_variant_get(value, "$.rationale", "string"))
    ids = F.try_variant_get(value, "$.evidence_ids", "array<string>")
    keys = F.array_sort(F.json_object_keys(text))
    error = (
        F.when(value.isNull(), "INVALID_JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "NOT_AN_OBJECT")
        .when(keys != F.array(F.lit("decision"), F.lit("evidence_ids"), F.lit("rationale")), "KEYS").when(F.coalesce(kind("$.decision") != "STRING", F.lit(True)) | ~decision.isin(*DECISIONS), "DECISION")
        .when(F.coalesce(~kind("$.evidence_ids").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True)), "EVIDENCE_IDS").when((F.size(ids) != F.size(F.array_distinct(ids))) & F.lit(not aliased), "REPEATED_IDS")
        .when(F.coalesce(kind("$.rationale") != "STRING", F.lit(True)) | (rationale == ""), "RATIONALE").when((decision == "PRESENT") & (F.size(ids) == 0), "PRESENT_WITHOUT_EVIDENCE")
        .when((decision == "ABSENT") & (F.size(ids) > 0), "ABSENT_WITH_EVIDENCE")
    )
    return F.struct(error.alias("error"), decision.alias("decision"), F.array_distinct(ids).alias("evidence_ids"), rationale.alias("rationale"))


def discovery_answer(raw: Column, max_topics: int = 10) -> Column:
    """{error, topics: [{label, description, evidence_ids}]} of an answer; error is null or the first rule that it breaks, by the first topic that does.

    Exactly the key topics, a list of at most max_topics objects with exactly the keys evidence_ids, label and short_description; label and description are
    strings that aren't blank, evidence_ids a list of such strings, not empty and without repeats. Nothing is cut off to fit. Whether the identifiers
    exist is told by hallucinated().
    """
    return bound(repaired(unfenced(raw)), lambda text: bound(strict_json(text), lambda value: _discovery(text, value, max_topics)))


def _discovery(text: Column, value: Column, max_topics: int) -> Column:
    part = lambda v, name, kind="variant": F.try_variant_get(v, f"$.{name}", kind)
    is_a = lambda v, kind: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))
    filled = lambda v: is_a(v, "STRING") & F.coalesce(F.trim(F.try_variant_get(v, "$", "string")) != "", F.lit(False))
    keys = lambda json, *names: F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(n) for n in names]), F.lit(False))

    def broken(t):
        ids = part(t, "evidence_ids", "array<variant>")
        plain = F.transform(ids, lambda x: F.try_variant_get(x, "$", "string"))
        return (
            F.when(~is_a(t, "OBJECT"), "TOPIC_NOT_OBJECT").when(~keys(F.to_json(t), "evidence_ids", "label", "short_description"), "TOPIC_KEYS_MISMATCH")
            .when(~filled(part(t, "label")), "LABEL_INVALID").when(~filled(part(t, "short_description")), "DESCRIPTION_INVALID")
            .when(~is_a(part(t, "evidence_ids"), "ARRAY"), "EVIDENCE_IDS_NOT_LIST").when(F.size(ids) == 0, "EVIDENCE_IDS_EMPTY")
            .when(F.exists(ids, lambda x: ~filled(x)), "EVIDENCE_ID_NOT_STRING").when(F.size(F.array_distinct(plain)) < F.size(ids), "EVIDENCE_IDS_DUPLICATED")
        )

    def judged(topics):
        found = F.get(F.filter(F.transform(topics, broken), lambda e: e.isNotNull()), F.lit(0))
        error = (
            F.when(value.isNull(), "INVALID_JSON").when(~is_a(value, "OBJECT"), "NOT_AN_OBJECT").when(~keys(text, "topics"), "TOP_KEYS_MISMATCH").when(~is_a(part(value, "topics"), "ARRAY"), "TOPICS_NOT_LIST")
            .when(F.size(topics) > max_topics, "TOPIC_COUNT_EXCEEDS_LIMIT").otherwise(found)
        )
        read = lambda t: F.struct(F.trim(part(t, "label", "string")).alias("label"), F.trim(part(t, "short_description", "string")).alias("description"), part(t, "evidence_ids", "array<string>").alias("evidence_ids"))
        return bound(error, lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.transform(topics, read)).alias("topics")))

    return bound(part(value, "topics", "array<variant>"), judged)


# -- acceptance -------------------------------------------------------------------


def accepted(topics: DataFrame, sections: DataFrame) -> DataFrame:
    """The topics (document_id, topic_no, label, evidence_ids) worth keeping, their citations reduced to sections that say something.

    Left out: banned labels and labels of absence, topics without evidence that says anything, those with greetings only, and
    those whose evidence all denies the action unless the label is about calling something off.
    """
    plain = F.trim(F.regexp_replace(latin_folded(F.col("label")), "[^a-z0-9]+", " "))
    real = topics.withColumn("_l", plain).where((F.col("_l") != "") & ~F.col("_l").isin(*BANNED_LABELS) & ~F.concat("_l", F.lit(" ")).rlike(ABSENCE))
    text, source = F.col("text"), F.col("source_type")
    said = sections.where(~((source == "ORIGINAL_TEXT") & is_media_placeholder(text))).select("evidence_id", is_greeting(text).alias("_g"), F.coalesce(text.rlike(NEGATION), F.lit(False)).alias("_n"))
    rows = cited(real, ["document_id", "topic_no"]).join(said, "evidence_id")
    kept = rows.groupBy("document_id", "topic_no").agg(F.array_sort(F.collect_list(F.struct("position", "evidence_id"))).alias("_e"), F.bool_and("_g").alias("_g"), F.bool_and("_n").alias("_n"))
    out = real.drop("evidence_ids").join(kept, ["document_id", "topic_no"]).where(~F.col("_g") & (~F.col("_n") | F.col("_l").rlike(CANCELLATION)))
    return out.withColumn("evidence_ids", F.transform("_e", lambda e: e["evidence_id"])).drop("_e", "_g", "_n", "_l")
