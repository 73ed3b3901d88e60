"""Queries over topics brought together, runs of a model that is told in advance, and where media lies."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import consolidation, containment, provenance, runs, search, verdicts
from ..operators import serialization as Z
from ..registry import query, table

_STOPS = ", ".join(f"'{w}'" for w in T.LABEL_STOP_WORDS)


@query(
    rf"""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\[-`{{-~]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS all_words FROM part),
k AS (SELECT p_partkey, all_words, list_filter(all_words, lambda x: x NOT IN ({_STOPS})) AS kept FROM w),
l AS (SELECT p_partkey, array_to_string(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE all_words END, lambda x: CASE WHEN length(x) > 3 AND (x LIKE '%i' OR (length(x) > 4 AND regexp_matches(x, '[eoa]$'))) THEN left(x, length(x) - 1) ELSE x END), ' ') AS key FROM k),
t AS (SELECT p_type, p_size, p_partkey, p_name, 'of ' || p_brand AS d, key, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS pos FROM part JOIN l USING (p_partkey)),
g AS (SELECT p_type, key, arg_min(p_name, pos) AS label, arg_max(d, (length(d), -pos)) AS description, array_to_string(list(p_partkey::VARCHAR ORDER BY pos), ',') AS evidence, count(*) AS n, count(DISTINCT p_size) AS support, min(pos) AS first FROM t GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY p_type) AS n_topics, (sum(n) OVER (PARTITION BY p_type))::BIGINT AS n_found, row_number() OVER (PARTITION BY p_type ORDER BY support DESC, n DESC, first, key) AS ranked, row_number() OVER (PARTITION BY p_type ORDER BY first) AS met FROM g)
SELECT p_type AS document_id, CASE WHEN n_topics > 10 THEN ranked ELSE met END AS place, label, description, evidence, support, n_found, n_topics FROM r WHERE n_topics <= 10 OR ranked <= 10"""
)
def consolidated_topics(spark, d):
    """Names of parts as topics, types as documents, sizes as their chunks: names with equal canonical labels are brought together, ten a type at most."""
    topics = table(spark, d, "part").select(
        F.col("p_type").alias("document_id"), F.col("p_size").alias("chunk"), F.col("p_partkey").alias("topic_no"), F.col("p_name").alias("label"), F.concat(F.lit("of "), "p_brand").alias("description"),
        F.array(F.col("p_partkey").cast("string")).alias("evidence_ids"),
    )
    found = consolidation.consolidated(topics)
    return found.withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids")


def finds_words(prompts: list[str]) -> list[runs.Reply]:
    """A model told in advance: it cites the sections that hold the topic's label, and gives broken answers to requests of several sections of which one has a length divisible by seven."""
    out = []
    for prompt in prompts:
        _, topic, _, *lines = prompt.split("\n")
        sections = [json.loads(x) for x in lines]
        hits = [s["id"] for s in sections if topic in s["text"]]
        answer = json.dumps({"decision": "PRESENT" if hits else "ABSENT", "evidence_ids": hits, "rationale": "by words"})
        out.append(runs.Reply(answer[: len(answer) // 2] if len(sections) > 1 and any(len(s["text"]) % 7 == 0 for s in sections) else answer))
    return out


@query(
    """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), t AS (SELECT unnest(['the ', 'zz', 'ing']) AS topic_id)
SELECT conv_id::VARCHAR AS document_id, topic_id, CASE WHEN bool_or(contains(text, topic_id)) THEN 'PRESENT' ELSE 'ABSENT' END AS decision, count(*) FILTER (contains(text, topic_id)) AS n_evidence, 0 AS n_failed FROM c, t GROUP BY ALL"""
)
def topic_verdicts_by_model(spark, d):
    """Conversations asked for three topics, five turns a chunk; requests that come back broken are halved until all have an answer."""
    from pyspark.sql import Window

    c = F.col
    rows = table(spark, d, "conversations").select(c("conv_id").cast("string").alias("document_id"), F.floor(c("turn") / 5).cast("int").alias("chunk"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("document_id", "chunk").orderBy("turn", "role", "text")) - 1
    sections = rows.withColumn("n", n).withColumn("evidence_id", F.concat_ws("-", "document_id", "chunk", "n")).select("document_id", "chunk", "n", "evidence_id", "text")
    topics = spark.createDataFrame([(w, w, "") for w in ("the ", "zz", "ing")], "topic_id string, label string, description string")
    verdicts, evidence, _ = runs.detection_run(sections, topics, finds_words, attempts=1)
    cited = evidence.groupBy("document_id", "topic_id").agg(F.count("*").alias("n_evidence"))
    return verdicts.join(cited, ["document_id", "topic_id"], "left").select("document_id", "topic_id", "decision", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "n_failed")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS k, 'c' || o_custkey || '.jpg' AS f, o_orderkey % 14 = 6 AS ambiguous FROM orders), c AS (SELECT 'c' || c_custkey || '.jpg' AS f, c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, CASE WHEN ambiguous THEN 'AMBIGUOUS' WHEN k = 2 OR k = 5 THEN 'OUTSIDE_ALLOWED_ROOT' WHEN k = 3 THEN 'REMOTE_REFERENCE' WHEN k = 4 THEN 'NO_REFERENCE' WHEN c.f IS NULL THEN 'MISSING' ELSE 'RESOLVED' END AS state,
CASE WHEN NOT ambiguous AND k IN (0, 1, 6) AND c.f IS NOT NULL THEN '/data/media/' || c.f END AS path, CASE WHEN NOT ambiguous AND k IN (0, 1, 6) THEN c_acctbal END AS size FROM r LEFT JOIN c USING (f)"""
)
def media_containment(spark, d):
    """Orders refer to a picture of their customer in seven ways; every other customer has one below an allowed folder."""
    k, name = F.col("o_orderkey") % 7, F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".jpg"))
    way = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    reference = (
        F.when(k == 0, way("/data/in/../media/./", name)).when(k == 1, name).when(k == 2, way("../../etc/", name)).when(k == 3, way("HTTPS://x/", name)).when(k == 5, way("/data/media2/", name)).when(k == 6, way("./x/..//", name))
    )
    rows = table(spark, d, "orders").select("o_orderkey", reference.alias("reference"), F.when(k.isin(1, 2), "/data/in/chat.txt").alias("source_path"), (F.col("o_orderkey") % 14 == 6).alias("is_ambiguous"))
    files = table(spark, d, "customer").where("c_custkey % 2 = 0").select(way("/data/media/c", F.col("c_custkey").cast("string"), ".jpg").alias("path"), F.col("c_acctbal").alias("size"))
    return containment.media_states(rows, ["/data/in", "/data/media/"], files).select("o_orderkey", "state", "path", "size")


@query(
    """WITH s AS (SELECT source, lang, doc_id, length(coalesce(text, '')) AS n, greatest(85, ceil((length(doc_id::VARCHAR) + 13 + length(lang) + length(source) + 110) / 2.5::DOUBLE))::BIGINT AS f FROM documents)
SELECT source, lang, (ceil(sum(n) / 2.8::DOUBLE) + sum(f))::BIGINT AS chunk_tokens, (ceil(sum(n) / 2.8::DOUBLE) + 20 * count(*))::BIGINT AS micro_tokens FROM s GROUP BY ALL"""
)
def bundle_tokens(spark, d):
    """Documents of a source and language as the sections of one message."""
    rows = table(spark, d, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("evidence_id"), F.lit("ORIGINAL_TEXT").alias("source_type"))
    names = [F.col(c) for c in ("evidence_id", "source_type", "lang", "source")]
    return Z.bundle_tokens(rows, ["source", "lang"], names)


@query("SELECT evidence_id, n FROM (SELECT lang || '-' || n_chars AS evidence_id, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def index_errors(spark, d):
    """Identifiers of languages and lengths, of which many aren't unique."""
    return search.integrity_errors(table(spark, d, "documents").select(F.concat_ws("-", "lang", F.col("n_chars").cast("string")).alias("evidence_id")))


@query("SELECT doc_id AS document_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 300)")
def provenance_errors(spark, d):
    """Labels as topics of long documents."""
    return provenance.provenance_errors(table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), "quality"), table(spark, d, "documents").where("n_chars >= 300").select(F.col("doc_id").alias("document_id")))


@query(
    """WITH p AS (SELECT doc_id, lang, CASE WHEN n_chars >= 1200 THEN 'PRESENT' WHEN n_chars >= 400 THEN 'UNCERTAIN' ELSE 'ABSENT' END AS a FROM documents WHERE doc_id % 3 > 0),
x AS (SELECT lang, a, CASE quality WHEN 1 THEN 'PRESENT' ELSE 'ABSENT' END AS e FROM p JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (e = 'PRESENT' AND a = 'PRESENT') AS tp, count(*) FILTER (e <> 'PRESENT' AND a <> 'ABSENT') AS fp, count(*) FILTER (e <> 'PRESENT' AND a = 'ABSENT') AS tn, count(*) FILTER (e = 'PRESENT' AND a <> 'PRESENT') AS fn FROM x GROUP BY lang),
r AS (SELECT *, round((tp + tn) / n, 4) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0.0 END AS f1 FROM r"""
)
def truth_against_lengths(spark, d):
    """Quality labels as the truth, and what lengths say as the prediction, for two thirds of the documents, by language."""
    n = F.col("n_chars")
    told = table(spark, d, "documents").where("doc_id % 3 > 0").select("doc_id", "lang", F.when(n >= 1200, "PRESENT").when(n >= 400, "UNCERTAIN").otherwise("ABSENT").alias("actual"))
    truth = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "PRESENT").otherwise("ABSENT").alias("expected"))
    return verdicts.confusion(provenance.with_truth(told, truth, ["doc_id"]).join(told.select("doc_id", "lang"), "doc_id"), ["lang"])


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 297) || '...' ELSE text END AS text FROM documents")
def shortened_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shortened(F.col("text")).alias("text"))


@query(
    r"""WITH m AS (SELECT p_partkey, p_size, ['deepseek-r1-qwen', 'meta-Llama-3', 'Qwen2.5-Instruct', 'qwen3', 'qwen', 'mistral'][p_partkey % 6 + 1] AS n, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'DEEPSEEK' WHEN 1 THEN 'LLAMA' WHEN 2 THEN 'QWEN2.5' WHEN 3 THEN 'QWEN3' WHEN 4 THEN CASE WHEN contains(p_size::VARCHAR, '3') THEN 'QWEN3' ELSE 'QWEN_OTHER' END END AS family,
array_to_string(list_filter([CASE WHEN k = 1 THEN 'quantization' END, CASE WHEN k = 2 THEN 'parameter_size' END, CASE WHEN k = 3 THEN 'max_context_length' END], lambda x: x IS NOT NULL), ',') AS differ FROM m"""
)
def model_metadata(spark, d):
    """Families of model names, and what is declared against what is observed in other spellings, different for some."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("deepseek-r1-qwen", "meta-Llama-3", "Qwen2.5-Instruct", "qwen3", "qwen", "mistral"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.lit("-x"), size)
    declared = {"quantization": F.lit(" q4_k_m"), "parameter_size": F.concat(size, F.lit("B")), "max_context_length": F.concat(size, F.lit("000.0")), "runtime_context_length": F.lit(None).cast("string")}
    observed = {
        "quantization": F.when(k == 1, "Q8_0").otherwise("Q4_K_M "), "parameter_size": F.concat(F.when(k == 2, F.lit("1")).otherwise(F.lit("")), size, F.lit(".0 b")),
        "max_context_length": F.concat(size, F.when(k == 3, F.lit("001")).otherwise(F.lit("000"))), "runtime_context_length": F.lit("4096"),
    }
    return table(spark, d, "part").select("p_partkey", models.model_family(name).alias("family"), F.array_join(models.discrepancies(declared, observed), ",").alias("differ"))
