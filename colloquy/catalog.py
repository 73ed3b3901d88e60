"""Every registered query of the engine by name, with its SQL counterpart where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunks as K
from .operators import profiles as P
from .operators import records as R
from .operators import search as S
from .operators import verdicts as V
from .plans import analysis, answers, ingestion, messages, records, runs, structure, topics  # noqa: F401  registers queries
from .registry import QUERIES as _QUERIES
from .registry import SQL as _SQL
from .registry import query as _query
from .registry import table as _table


def _sections(spark, d) -> DataFrame:
    return S.evidence_sections(_table(spark, d, "documents"))


def _messages(spark, d) -> DataFrame:
    return K.unified_messages(_table(spark, d, "conversations"))


_SECTIONS = r"""WITH s AS (SELECT doc_id AS seq, 'unified:' || source || ':' || doc_id || '::ORIGINAL_TEXT' AS evidence_id, source AS source_name, lang AS language, text
FROM documents WHERE regexp_matches(text, '\S')), t AS (SELECT *, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS terms FROM s) """
_MESSAGES = r"""m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS seq,
'unified:conversations:' || conv_id || '-' || turn AS message_id, 'chat:conversations:' || conv_id AS chat_id,
CASE WHEN role = 'user' THEN 'participant:local_user:LOCAL_USER' ELSE 'participant:alias:' || role END AS participant_id FROM conversations)"""


# -- search -----------------------------------------------------------------------------------------


@_query(_SECTIONS + "SELECT seq, evidence_id, source_name, language, 'de la' AS matched FROM s WHERE contains(replace(lower(text), 'ß', 'ss'), 'de la')")
def search_phrase(spark, d):
    return S.search(_sections(spark, d), S.SearchQuery("de la", "PHRASE"))


@_query(_SECTIONS + "SELECT s.seq, s.evidence_id, s.source_name, s.language, b.item_id FROM s JOIN benchmark b ON contains(replace(lower(s.text), 'ß', 'ss'), replace(lower(b.text), 'ß', 'ss'))")
def search_benchmark_passages(spark, d):
    """PHRASE search for every text of a table at once, joined by keys of words."""
    phrases = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return S.phrase_matches(_sections(spark, d), phrases, "item_id").select("seq", "evidence_id", "source_name", "language", "item_id")


@_query(_SECTIONS + "SELECT seq, evidence_id, source_name, language, trim((SELECT text FROM documents WHERE doc_id = 0)) AS matched FROM s WHERE lower(text) = lower((SELECT text FROM documents WHERE doc_id = 0))")
def search_exact(spark, d):
    first = _table(spark, d, "documents").where("doc_id = 0 and trim(text) <> ''").select("text").head()
    found = _sections(spark, d) if first else _sections(spark, d).where("false")
    return S.search(found, S.SearchQuery(first[0] if first else "none", "EXACT"))


@_query(_SECTIONS + "SELECT seq, evidence_id, source_name, language, 'de,la' AS matched FROM t WHERE list_contains(terms, 'de') AND list_contains(terms, 'la')")
def search_all_terms(spark, d):
    return S.search(_sections(spark, d), S.SearchQuery("de la", "ALL_TERMS"))


@_query(_SECTIONS + "SELECT seq, evidence_id, source_name, language, array_to_string(list_filter(['der', 'les', 'nope'], lambda x: list_contains(terms, x)), ',') AS matched FROM t WHERE list_has_any(terms, ['der', 'les', 'nope'])")
def search_any_term(spark, d):
    return S.search(_sections(spark, d), S.SearchQuery("der les nope", "ANY_TERM"))


@_query(
    _SECTIONS + "SELECT seq, evidence_id, source_name, language, 'e' AS matched, (SELECT count(*) FROM s WHERE lower(trim(language)) = 'de' AND contains(lower(text), 'e')) AS total "
    "FROM s WHERE lower(trim(language)) = 'de' AND contains(lower(text), 'e') ORDER BY seq LIMIT 10"
)
def search_filtered_limit(spark, d):
    return S.search(_sections(spark, d), S.SearchQuery("e", "PHRASE", language="DE", limit=10))


@_query(_SECTIONS + "SELECT source_name, count(*) AS n_sections, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, sum(length(text))::BIGINT AS n_chars FROM s GROUP BY source_name")
def evidence_summary(spark, d):
    return S.summary(_sections(spark, d))


@_query(
    _SECTIONS + "SELECT DISTINCT 'source_type' AS field, 'ORIGINAL_TEXT' AS value FROM s UNION ALL SELECT DISTINCT 'language', language FROM s WHERE language IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'source_name', source_name FROM s"
)
def filter_options(spark, d):
    return S.filter_options(_sections(spark, d))


@_query(_SECTIONS + "SELECT language, md5(trim(text)) AS fingerprint, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return S.duplicate_groups(_sections(spark, d))


# -- profiles ---------------------------------------------------------------------------------------


@_query("SELECT count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS copies FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce(lang, '') || '|' || coalesce(text, ''))")
def duplicate_fingerprints(spark, d):
    return P.duplicate_fingerprints(_table(spark, d, "documents"), ["lang", "text"])


def _text_profile_sql(table: str, key: str) -> str:
    return rf"""SELECT {key}, count(*) AS total, count(*) FILTER (NOT ok) AS empty, min(n) AS min_length, max(n) AS max_length, round(avg(n), 1) AS avg_length,
count(*) FILTER (ok AND regexp_matches(text, 'https?://\S+|www\.\S+')) AS with_url, count(*) FILTER (ok AND regexp_matches(text, '\+?\d[\d\s\-]{{7,}}\d')) AS with_phone,
count(*) FILTER (ok AND regexp_matches(text, '[\n\r]')) AS with_newline, count(*) FILTER (ok AND regexp_matches(text, '{P.EMOJI}')) AS with_emoji, count(*) FILTER (ok AND regexp_matches(text, '{P.PLACEHOLDER}')) AS placeholders,
count(*) FILTER (ok AND contains(text, chr(65533))) AS undecoded, count(*) FILTER (n BETWEEN 1 AND 50) AS length_1_50, count(*) FILTER (n BETWEEN 51 AND 200) AS length_51_200,
count(*) FILTER (n BETWEEN 201 AND 500) AS length_201_500, count(*) FILTER (n BETWEEN 501 AND 1000) AS length_501_1000, count(*) FILTER (n BETWEEN 1001 AND 5000) AS length_1001_5000,
count(*) FILTER (n > 5000) AS length_over_5000
FROM (SELECT *, coalesce(regexp_matches(text, '\S'), false) AS ok, CASE WHEN regexp_matches(text, '\S') THEN length(text) END AS n FROM {table}) GROUP BY {key}"""


@_query(_text_profile_sql("documents", "source"))
def text_profile(spark, d):
    return P.texts(_table(spark, d, "documents"), ["source"])


@_query(_text_profile_sql("conversations", "role"))
def text_profile_conversations(spark, d):
    return P.texts(_table(spark, d, "conversations"), ["role"])


def _columns_sql(table: str, roles: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{role}' AS role, count(*) AS n_rows, round((count(*) - count({c})) / count(*), 4) AS null_rate, "
        f"coalesce(round(count(DISTINCT {c}) / count({c}), 4), 0) AS unique_rate, coalesce(round(avg(length({c}::VARCHAR)), 1), 0) AS avg_length FROM (SELECT CASE WHEN regexp_matches({c}::VARCHAR, '\\S') THEN {c} END AS {c} FROM {table})"
        for c, role in roles.items()
    )


_CUSTOMER = {"c_custkey": "unknown", "c_name": "unknown", "c_nationkey": "unknown", "c_acctbal": "unknown", "c_mktsegment": "unknown"}
_DOCUMENTS = {"doc_id": "unknown", "text": "body", "lang": "unknown", "source": "sender", "n_chars": "unknown"}


@_query(_columns_sql("customer", _CUSTOMER))
def column_profile(spark, d):
    return P.columns(_table(spark, d, "customer"))


@_query(_columns_sql("documents", _DOCUMENTS))
def column_profile_documents(spark, d):
    return P.columns(_table(spark, d, "documents"))


@_query(
    "SELECT event_type, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (v = 0) AS zeros, count(*) FILTER (v < 0) AS negatives, count(*) FILTER (v > 1000000000000) AS milliseconds, "
    "count(*) FILTER (v > 0 AND v <= 1000000000000) AS seconds, 0 AS iso, 0 AS unread, min(v) AS min_ms, max(v) AS max_ms, count(*) FILTER (v >= 1924992000000) AS future "
    "FROM (SELECT event_type, epoch_us(ts) // 1000 AS v FROM events) GROUP BY event_type"
)
def timestamp_profile(spark, d):
    rows = _table(spark, d, "events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("v"))
    return P.timestamps(rows, "v", ["event_type"])


@_query("SELECT key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY key ORDER BY n DESC, key LIMIT 50")
def event_json_keys(spark, d):
    return P.json_keys(_table(spark, d, "events"), "props")


# -- text functions ---------------------------------------------------------------------------------


@_query(
    r"""SELECT doc_id, place, raw, CASE WHEN regexp_matches(trim(raw), '^\+[0-9 ()-]+$') AND length(regexp_replace(trim(raw), '[^0-9]', '', 'g')) >= 5
THEN '+' || regexp_replace(trim(raw), '[^0-9]', '', 'g') END AS phone FROM (SELECT doc_id, unnest(range(len(found))) AS place, unnest(found) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '\+?\d[\d ()-]{7,}\d') AS found FROM documents))"""
)
def phones(spark, d):
    """All numbers of each text, in order."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"\+?\d[\d ()-]{7,}\d"), F.lit(0)))
    rows = _table(spark, d, "documents").select("doc_id", found.alias("place", "raw"))
    return rows.withColumn("phone", T.canonical_phone(F.col("raw")))


@_query(
    r"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(ceil(length(text) / 2.8::DOUBLE), ceil(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35::DOUBLE)) + 4 END::BIGINT AS tokens
FROM documents"""
)
def token_estimates(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


_STOPS = ", ".join(f"'{w}'" for w in T.LABEL_STOP_WORDS)


@_query(
    rf"""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\[-`{{-~]', ' ', 'g'), ' +', ' ', 'g')), ' ') AS all_words FROM part),
k AS (SELECT p_partkey, all_words, list_filter(all_words, lambda x: x NOT IN ({_STOPS})) AS kept FROM w)
SELECT p_partkey, array_to_string(list_transform(CASE WHEN len(kept) > 0 THEN kept ELSE all_words END, lambda x: CASE WHEN length(x) > 3 AND (x LIKE '%i' OR (length(x) > 4 AND regexp_matches(x, '[eoa]$')))
THEN left(x, length(x) - 1) ELSE x END), ' ') AS label FROM k"""
)
def canonical_labels(spark, d):
    return _table(spark, d, "part").select("p_partkey", T.canonical_label(F.col("p_name")).alias("label"))


@_query("SELECT c_custkey, 'user_' || left(sha256(trim(c_name)), 12) AS pseudonym FROM customer")
def pseudonymize(spark, d):
    return _table(spark, d, "customer").select("c_custkey", T.pseudonym("user", F.col("c_name")).alias("pseudonym"))


# -- conversations ----------------------------------------------------------------------------------


@_query(f"WITH {_MESSAGES} SELECT * FROM m")
def unified_messages(spark, d):
    return _messages(spark, d)


@_query(f"WITH {_MESSAGES} " + r"SELECT conv_id, turn, 'E' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS alias FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n FROM m WHERE regexp_matches(text, '\S'))")
def aliases(spark, d):
    return K.with_aliases(_messages(spark, d)).select("conv_id", "turn", "alias")


@_query(r"SELECT conv_id, count(*) AS n_messages, count(*) FILTER (regexp_matches(text, '\S')) AS n_sections, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id")
def conversation_list(spark, d):
    return K.conversation_list(_messages(spark, d))


@_query(f"WITH {_MESSAGES} SELECT conv_id, sha256(string_agg(message_id || chr(31) || role || chr(31) || coalesce(text, ''), chr(30) ORDER BY seq)) AS fingerprint FROM m GROUP BY conv_id")
def conversation_fingerprints(spark, d):
    return K.fingerprints(_messages(spark, d))


@_query(
    f"""WITH RECURSIVE {_MESSAGES}, x AS (SELECT conv_id, seq, length(coalesce(text, '')) AS c, (ceil(length(coalesce(text, '')) / 2.8::DOUBLE) + 85)::BIGINT AS t FROM m),
f AS (SELECT conv_id, seq, c, 1 AS n, t, 0 AS chunk FROM x WHERE seq = 1 UNION ALL
SELECT conv_id, seq, CASE WHEN full_ THEN c ELSE c + c0 END, CASE WHEN full_ THEN 1 ELSE n0 + 1 END, CASE WHEN full_ THEN t ELSE t + t0 END, chunk + full_::INT FROM
(SELECT x.conv_id, x.seq, x.c, x.t, f.c AS c0, f.n AS n0, f.t AS t0, f.chunk, (f.c + x.c > 2000 OR f.n >= 4 OR f.t + x.t > 900) AS full_ FROM f JOIN x ON x.conv_id = f.conv_id AND x.seq = f.seq + 1))
SELECT conv_id, seq, chunk::BIGINT AS chunk FROM f"""
)
def chunk_greedy(spark, d):
    return K.chunks(_messages(spark, d), 2000, 4, 900)


@_query(
    rf"""WITH RECURSIVE {_MESSAGES}, x AS (SELECT conv_id, seq, coalesce(regexp_matches(text, '\S'), false)::INT AS s, (ceil(length(coalesce(text, '')) / 2.8::DOUBLE) + 20)::BIGINT AS t FROM m),
f AS (SELECT conv_id, seq, s, t, 0 AS chunk FROM x WHERE seq = 1 UNION ALL
SELECT conv_id, seq, CASE WHEN full_ THEN s ELSE s + s0 END, CASE WHEN full_ THEN t ELSE t + t0 END, chunk + full_::INT FROM
(SELECT x.conv_id, x.seq, x.s, x.t, f.s AS s0, f.t AS t0, f.chunk, ((x.s = 1 AND f.s >= 3) OR f.t + x.t > 400) AS full_ FROM f JOIN x ON x.conv_id = f.conv_id AND x.seq = f.seq + 1))
SELECT conv_id, seq, chunk::BIGINT AS chunk FROM f"""
)
def microchunks(spark, d):
    return K.microchunks(_messages(spark, d), 3, 400)


@_query("SELECT conv_id, turn AS seq, NULL::BIGINT AS n FROM conversations WHERE false")
def chunk_coverage_errors(spark, d):
    messages = _messages(spark, d)
    return K.coverage_errors(messages, K.chunks(messages)).select("conv_id", "seq", "n")


# -- verdicts ---------------------------------------------------------------------------------------


def _outcomes(spark, d) -> DataFrame:
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.withColumn("decision", F.expr("CASE WHEN toxic = 1 THEN 'PRESENT' WHEN quality = 0 AND doc_id % 11 = 0 THEN NULL WHEN quality = 0 THEN 'UNCERTAIN' ELSE 'ABSENT' END"))


_OUTCOMES = """o AS (SELECT doc_id, source, lang, quality, toxic, CASE WHEN toxic = 1 THEN 'PRESENT' WHEN quality = 0 AND doc_id % 11 = 0 THEN NULL WHEN quality = 0 THEN 'UNCERTAIN' ELSE 'ABSENT' END AS decision
FROM labels JOIN documents USING (doc_id))"""


_VERDICTS = f"""{_OUTCOMES}, g AS (SELECT source, lang, count(*) AS n_parts, count(*) FILTER (decision IS NULL) AS n_failed, count(*) FILTER (decision = 'PRESENT') AS p, count(*) FILTER (decision = 'UNCERTAIN') AS u FROM o GROUP BY source, lang),
v AS (SELECT source, lang, n_parts, n_failed, CASE WHEN p > 0 THEN 'PRESENT' WHEN n_failed > 0 OR u > 0 THEN 'UNCERTAIN' ELSE 'ABSENT' END AS decision FROM g)"""


@_query(f"WITH {_VERDICTS} SELECT * FROM v")
def verdicts(spark, d):
    return V.aggregated(_outcomes(spark, d), ["source", "lang"])


@_query(
    f"""WITH {_VERDICTS} SELECT o.source, o.lang, doc_id FROM o JOIN v ON v.source IS NOT DISTINCT FROM o.source AND v.lang IS NOT DISTINCT FROM o.lang AND v.decision = o.decision
WHERE v.decision = 'PRESENT' OR (v.decision = 'UNCERTAIN' AND n_failed = 0)"""
)
def verdict_evidence(spark, d):
    rows = _outcomes(spark, d).withColumn("seq", F.col("doc_id"))
    return V.verdict_evidence(rows, ["source", "lang"], evidence="doc_id").drop("seq")


@_query(
    f"""WITH {_OUTCOMES}, e AS (SELECT lang, CASE WHEN quality = 1 THEN 'PRESENT' ELSE 'ABSENT' END AS expected, coalesce(decision, 'UNCERTAIN') AS actual FROM o),
n AS (SELECT lang, count(*) AS n, count(*) FILTER (expected = 'PRESENT' AND actual = 'PRESENT') AS tp, count(*) FILTER (expected = 'ABSENT' AND actual <> 'ABSENT') AS fp,
count(*) FILTER (expected = 'ABSENT' AND actual = 'ABSENT') AS tn, count(*) FILTER (expected = 'PRESENT' AND actual <> 'PRESENT') AS fn FROM e GROUP BY lang),
r AS (SELECT *, round((tp + tn) / n, 4) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END::DOUBLE AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END::DOUBLE AS recall FROM n)
SELECT *, CASE WHEN "precision" + recall > 0 THEN round(2 * "precision" * recall / ("precision" + recall), 4) ELSE 0.0 END::DOUBLE AS f1 FROM r"""
)
def confusion_metrics(spark, d):
    rows = _outcomes(spark, d).select("lang", F.when(F.col("quality") == 1, "PRESENT").otherwise("ABSENT").alias("expected"), F.coalesce("decision", F.lit("UNCERTAIN")).alias("actual"))
    return V.confusion(rows, ["lang"])


@_query(
    r"""WITH l AS (SELECT doc_id, string_split(replace(lower(coalesce(text, '')), 'ß', 'ss'), chr(10)) AS l FROM documents),
t AS (SELECT doc_id, regexp_extract_all(array_to_string(list_filter(l, lambda x, i: i % 2 = 1), ' '), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(array_to_string(list_filter(l, lambda x, i: i % 2 = 0), ' '), '[\p{L}\p{N}_]+') AS b FROM l),
o AS (SELECT doc_id, len(list_intersect(a, b)) AS n_overlap, len(list_distinct(list_concat(a, b))) AS n_union, CASE doc_id % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' ELSE 'UNCERTAIN' END AS decision FROM t)
SELECT doc_id, n_overlap, CASE WHEN n_union > 0 THEN round(n_overlap / n_union, 4) ELSE 0.0 END::DOUBLE AS jaccard, CASE WHEN decision = 'PRESENT' AND n_overlap > 0 THEN 'CONSISTENT' WHEN decision = 'PRESENT' THEN 'PARTIALLY_CONSISTENT'
WHEN decision = 'ABSENT' THEN 'INCONSISTENT_ABSENT' ELSE 'INCONSISTENT_UNCERTAIN' END AS status FROM o"""
)
def consistency(spark, d):
    """The words of a text's odd lines against those of its even lines."""
    part = lambda k: T.tokens(F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: i % 2 == k), " "))
    rows = _table(spark, d, "documents").select(
        "doc_id", part(0).alias("a"), part(1).alias("b"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'ABSENT' ELSE 'UNCERTAIN' END AS decision")
    )
    return V.consistency(rows, "a", "b", "decision").select("doc_id", "n_overlap", "jaccard", "status")


@_query(
    r"""WITH c AS (SELECT lang, source AS part, doc_id AS seq, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+')) AS topic FROM documents),
g AS (SELECT lang, topic, count(DISTINCT part) AS support, count(*) AS citations, min(seq) AS first_seen FROM c GROUP BY lang, topic)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY support DESC, citations DESC, first_seen, topic) AS rank FROM g) WHERE rank <= 10"""
)
def topic_top_k(spark, d):
    words = _table(spark, d, "documents").select("lang", F.col("source").alias("part"), F.col("doc_id").alias("seq"), F.explode(T.tokens(F.col("text"))).alias("topic"))
    return V.top_topics(words, 10, keys=["lang"])


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_missing(spark, d):
    done = _table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.missing_parts(_table(spark, d, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"])


@_query("SELECT h::BIGINT AS hour, coalesce(status, 'NOT_RECORDED') AS status, n FROM range(0, 30) r(h) LEFT JOIN (SELECT hour(ts) AS hour, 'COMPLETED' AS status, count(*) AS n FROM events GROUP BY 1) e ON e.hour = h")
def plan_filled(spark, d):
    seen = _table(spark, d, "events").groupBy(F.hour(F.col("ts").cast("timestamp")).cast("long").alias("hour")).agg(F.lit("COMPLETED").alias("status"), F.count("*").alias("n"))
    return V.filled(seen, spark.range(30).withColumnRenamed("id", "hour"), "hour").select("hour", "status", "n")


@_query("SELECT lang AS value, 'documents' AS side FROM documents INTERSECT SELECT lang, 'documents' FROM documents WHERE doc_id % 2 = 0 UNION ALL (SELECT DISTINCT role, 'conversations' FROM conversations)")
def set_operations(spark, d):
    docs = _table(spark, d, "documents")
    langs = docs.select(F.col("lang").alias("value"), F.lit("documents").alias("side"))
    both = langs.intersect(docs.where("doc_id % 2 = 0").select(F.col("lang").alias("value"), F.lit("documents").alias("side")))
    return both.unionByName(_table(spark, d, "conversations").select(F.col("role").alias("value"), F.lit("conversations").alias("side")).distinct())


# -- records ----------------------------------------------------------------------------------------


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'ABSENT' WHEN o_orderkey % 4 = 0 THEN 'KNOWN_UTC' ELSE 'NAIVE_UNKNOWN' END AS status,
CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 0 THEN epoch_ms(date_trunc('second', o_orderdate)) - 7200000 ELSE epoch_ms(date_trunc('minute', o_orderdate)) END AS ms FROM orders"""
)
def parsed_timestamps(spark, d):
    """Order dates written in several layouts and read back."""
    when = F.col("o_orderdate").cast("timestamp")
    case = F.col("o_orderkey") % 4
    raw = (
        F.when(case == 0, F.concat(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(case == 1, F.date_format(when, "d/M/yyyy, H:mm"))
        .when(case == 2, F.date_format(when, "yyyy-MM-dd H:mm")).otherwise(F.lit("not a date"))
    )
    rows = _table(spark, d, "orders").select("o_orderkey", R.parsed_timestamp(raw).alias("p"))
    return rows.select("o_orderkey", "p.status", F.unix_millis(F.coalesce("p.utc", F.col("p.naive").cast("timestamp"))).alias("ms"))


@_query(
    r"""SELECT page_id, array_to_string(list_filter([CASE WHEN NOT coalesce(regexp_matches(url, '\S'), false) THEN 'EMPTY_URL' END, CASE WHEN NOT contains(coalesce(html, ''), '<title>') THEN 'MISSING_TITLE' END,
CASE WHEN length(coalesce(html, '')) < 500 THEN 'SHORT_BODY' END], lambda x: x IS NOT NULL), ',') AS codes, coalesce(regexp_matches(url, '\S'), false) AS is_valid FROM pages"""
)
def validation_issues(spark, d):
    rules = {
        "EMPTY_URL": ("ERROR", ~T.has_text(F.col("url"))), "MISSING_TITLE": ("WARNING", ~F.contains(F.coalesce("html", F.lit("")), F.lit("<title>"))),
        "SHORT_BODY": ("INFO", F.length(F.coalesce("html", F.lit(""))) < 500),
    }
    rows = _table(spark, d, "pages").withColumn("issues", R.issues(rules))
    return rows.select("page_id", F.array_join(F.transform("issues", lambda x: x["code"]), ",").alias("codes"), R.is_valid(F.col("issues")).alias("is_valid"))


_REFERENCES = """r AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN '+' || (390000000 + o_custkey) WHEN o_orderkey % 5 = 1 THEN 'LOCAL_USER' ELSE '+' || (390000000 + o_custkey) || '@s.whatsapp.net' END AS identifier,
CASE WHEN o_orderkey % 5 = 0 THEN 'phone' WHEN o_orderkey % 5 = 1 THEN 'local_user' ELSE 'jid' END AS kind FROM orders)"""


@_query(
    f"""WITH {_REFERENCES}, j AS (SELECT DISTINCT split_part(identifier, '@', 1) AS phone, identifier AS jid FROM r WHERE kind = 'jid'),
x AS (SELECT coalesce(CASE WHEN kind = 'phone' THEN jid END, identifier) AS identifier, CASE WHEN kind = 'phone' AND jid IS NOT NULL THEN 'jid' ELSE kind END AS k, kind = 'phone' AS by_phone FROM r LEFT JOIN j ON j.phone = r.identifier),
g AS (SELECT k AS kind, identifier, count(*) AS n_references, bool_or(by_phone) AS by_phone FROM x GROUP BY 1, 2)
SELECT kind, identifier, n_references, CASE WHEN kind = 'jid' AND by_phone THEN 'STRONG' WHEN n_references = 1 THEN 'WEAK' WHEN kind = 'jid' THEN 'EXACT' WHEN kind = 'phone' THEN 'STRONG' ELSE 'EXACT' END AS level,
'entity:' || kind || ':' || identifier AS candidate_id FROM g"""
)
def candidate_entities(spark, d):
    case, phone = F.col("o_orderkey") % 5, F.concat(F.lit("+"), (F.lit(390000000) + F.col("o_custkey")).cast("string"))
    raw = F.when(case == 0, phone).when(case == 1, "LOCAL_USER").otherwise(F.concat(phone, F.lit("@s.whatsapp.net")))
    rows = _table(spark, d, "orders").select(R.actor(raw).alias("a"), F.col("o_orderkey").alias("seq"))
    return R.candidate_entities(rows.select(F.coalesce("a.phone", "a.raw").alias("identifier"), F.col("a.kind").alias("kind"), "seq"))


@_query(
    r"""WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 3 > 0 THEN lang END AS actor, doc_id // 500 AS stamp, md5(trim(text)) AS fingerprint FROM documents WHERE regexp_matches(text, '\S')),
l AS (SELECT stamp, fingerprint, arg_min(actor, doc_id) AS lead FROM k WHERE actor IS NOT NULL GROUP BY 1, 2)
SELECT k.stamp, k.fingerprint, coalesce(actor, lead, '') AS sender, count(*) AS n_records, min(doc_id) AS first_record, count(DISTINCT source) AS n_sources,
CASE WHEN count(DISTINCT source) > 1 AND bool_and(actor IS NOT NULL) THEN 'STRONG' ELSE 'WEAK' END AS confidence FROM k LEFT JOIN l USING (stamp, fingerprint) GROUP BY 1, 2, 3 HAVING count(*) > 1"""
)
def possible_duplicates(spark, d):
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_name"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("actor"), F.expr("doc_id div 500").alias("stamp"), "text")
    return R.possible_duplicates(rows)


@_query("SELECT c_custkey, (row_number() OVER (ORDER BY c_name, c_custkey) - 1)::BIGINT AS seq FROM customer")
def acquisition_sequence(spark, d):
    return R.numbered(_table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "seq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with all terms of a query, beside their source's summary."""
    return search_all_terms(spark, sf_dir).join(evidence_summary(spark, sf_dir), "source_name")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
