"""Evidence sections and lexical search over them: phrase, exact, all terms, any term."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, normalized, normalized_query, tokens, words_of

MODES = ("PHRASE", "EXACT", "ALL_TERMS", "ANY_TERM")


@dataclass(frozen=True)
class SearchQuery:
    text: str
    mode: str = "PHRASE"
    source_types: tuple[str, ...] = ()
    language: str | None = None
    source_name: str | None = None
    limit: int | None = None

    def __post_init__(self):
        if not self.text.strip():
            raise ValueError("the query text is blank")
        if self.mode not in MODES:
            raise ValueError(f"the mode is none of {MODES}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("the limit is not positive")


def evidence_sections(messages: DataFrame, id: str = "doc_id", language: str | None = "lang", source: str = "source") -> DataFrame:
    """One row per text that isn't blank, with stable identifiers; seq orders them."""
    source_name = F.col(source)
    message = F.concat(F.lit("unified:"), source_name, F.lit(":"), F.col(id).cast("string"))
    return messages.where(has_text(F.col("text"))).select(
        F.col(id).alias("seq"), message.alias("message_id"), F.concat(message, F.lit("::ORIGINAL_TEXT")).alias("evidence_id"),
        F.lit("ORIGINAL_TEXT").alias("source_type"), (F.col(language) if language else F.lit(None).cast("string")).alias("language"),
        source_name.alias("source_name"), "text",
    )


def search(sections: DataFrame, query: SearchQuery) -> DataFrame:
    """Sections that match, with the matched terms; in order of seq and with the number of all matches if a limit is given."""
    text = normalized(F.col("text"))
    wanted = normalized_query(query.text)
    terms = re.findall(r"[^\W]+", wanted)
    rows = sections
    if query.source_types:
        rows = rows.where(F.col("source_type").isin(*query.source_types))
    if query.source_name is not None:
        rows = rows.where(F.col("source_name") == query.source_name)
    if query.language is not None:
        rows = rows.where(F.lower(F.trim("language")) == query.language.strip().lower())
    if query.mode == "PHRASE":
        found = rows.where(F.contains(text, F.lit(wanted))).withColumn("matched", F.lit(query.text.strip()))
    elif query.mode == "EXACT":
        found = rows.where(text == wanted).withColumn("matched", F.lit(query.text.strip()))
    elif not terms:
        found = rows.where("false").withColumn("matched", F.lit(""))
    else:
        listed = F.array(*[F.lit(t) for t in terms])
        # a text without the letters of a term needn't be taken apart
        some = [F.contains(text, F.lit(t)) for t in terms]
        near = F.lit(query.mode == "ALL_TERMS")
        for x in some:
            near = near & x if query.mode == "ALL_TERMS" else near | x
        hits = rows.where(near).withColumn("_t", tokens(F.col("text"))).withColumn("_m", F.filter(listed, lambda t: F.array_contains(F.col("_t"), t)))
        least = len(terms) if query.mode == "ALL_TERMS" else 1
        found = hits.where(F.size("_m") >= least).withColumn("matched", F.array_join("_m", ",")).drop("_t", "_m")
    found = found.select("seq", "evidence_id", "source_name", "language", "matched")
    if query.limit is None:
        return found
    # counted beside, not over a window: a global window would gather all matches in one task
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("seq").limit(query.limit).join(F.broadcast(total), how="cross")


#: Keys of short phrases that are looked for one by one, at most.
FEW_KEYS = 200


def phrase_matches(sections: DataFrame, phrases: DataFrame, id: str) -> DataFrame:
    """Sections with each phrase (columns id and phrase) they contain, one row per pair; blank and null phrases match nothing.

    The words between a phrase's first and last are whole words of any section that contains it, so three of them
    in a row (or one, in a phrase of three or four words) are a key for an equi-join; shorter phrases are keyed by
    their first three characters. Candidates are then compared in full.
    """
    wanted = phrases.where(has_text(F.col("phrase"))).select(id, normalized(F.col("phrase")).alias("phrase")).distinct()
    words = tokens(F.col("phrase"))
    triple = F.array_join(F.slice(words, 2, 3), " ")
    key = F.when(F.size(words) >= 5, F.concat(F.lit("3:"), triple)).when(F.size(words) >= 3, F.concat(F.lit("1:"), words[1])).otherwise(F.concat(F.lit("c:"), F.substring("phrase", 1, 3)))
    keyed = wanted.withColumn("key", key)
    kinds = {r[0] for r in keyed.select(F.substring("key", 1, 2).alias("k")).distinct().collect()}
    low, t = F.col("low"), F.col("t")
    grams = []
    if "3:" in kinds:
        n = F.greatest(F.size(t) - 2, F.lit(0))
        grams.append(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("3:"), F.array_join(F.slice(t, i, 3), " "))))
    if "1:" in kinds:
        grams.append(F.transform(t, lambda w: F.concat(F.lit("1:"), w)))
    if "c:" in kinds:
        # few short phrases: a text has the keys of those that it contains; many: all pieces of their lengths
        short = keyed.where(F.startswith("key", F.lit("c:"))).select("key").distinct()
        few = [r[0] for r in short.limit(FEW_KEYS + 1).collect()]
        if len(few) <= FEW_KEYS:
            grams.append(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k[2:])), F.lit(k)) for k in few])))
        else:
            cut = lambda width: lambda i: F.concat(F.lit("c:"), F.substring(low, i, F.lit(width)))
            grams += [F.transform(F.sequence(F.lit(1), F.length(low)), cut(width)) for width in (1, 2, 3)]
    if not grams:
        return sections.where("false").withColumn(id, F.lit(None).cast(phrases.schema[id].dataType))
    found = sections.select("evidence_id", normalized(F.col("text")).alias("low")).select("evidence_id", "low", words_of(F.col("low")).alias("t")).select("evidence_id", F.explode(F.array_distinct(F.concat(*grams))).alias("key"))
    pairs = found.join(keyed, "key").select("evidence_id", id, "phrase").distinct()
    return sections.join(pairs, "evidence_id").where(F.contains(normalized(F.col("text")), F.col("phrase"))).drop("phrase")


def summary(sections: DataFrame) -> DataFrame:
    return sections.groupBy("source_name").agg(
        F.count("*").alias("n_sections"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.sum(F.length("text")).alias("n_chars")
    )


def filter_options(sections: DataFrame) -> DataFrame:
    """The distinct values of each filter, in rows (field, value)."""
    return sections.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("source_type", "language", "source_name")])).alias("o")).select("o.*").where("value is not null").distinct()


def duplicate_groups(sections: DataFrame) -> DataFrame:
    """Trimmed texts of one language that occur twice or more."""
    rows = sections.select("language", F.md5(F.trim("text")).alias("fingerprint"), "seq")
    return rows.groupBy("language", "fingerprint").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n > 1")


def integrity_errors(sections: DataFrame) -> DataFrame:
    """Evidence identifiers that aren't unique; must be empty."""
    return sections.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1")


#: What stands for any value of a filter in a form.
WILDCARDS = ("TUTTI", "TUTTE")


def form_filter(sections: DataFrame, source_type: str | None = None, language: str | None = None, source_name: str | None = None) -> DataFrame:
    """Sections by the exact values of a form's fields; blanks, null and the wildcards stand for any."""
    for column, value in (("source_type", source_type), ("language", language), ("source_name", source_name)):
        wanted = (value or "").strip()
        if wanted and wanted.upper() not in WILDCARDS:
            sections = sections.where(F.col(column) == wanted)
    return sections


def search_form(sections: DataFrame, text: str | None, mode: str = "PHRASE", limit: int | None = None, **fields: str | None) -> DataFrame:
    """search() of what was typed into a form, within form_filter(); a blank text finds nothing, and a mode that isn't known is an error."""
    typed = (text or "").strip()
    found = search(form_filter(sections, **fields), SearchQuery(typed or "-", mode, limit=limit))
    return found if typed else found.where("false")


def checked_index(sections: DataFrame) -> DataFrame:
    """sections, after their identifiers have been found to be unique; one that isn't is an error that names it."""
    twice = integrity_errors(sections).select("evidence_id").orderBy("evidence_id").limit(3).collect()
    if twice:
        raise ValueError(f"evidence_id isn't unique: {[r[0] for r in twice]}")
    return sections
