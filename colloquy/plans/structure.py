"""Queries over the structure of JSON, XML and tables, and emoji."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..operators import structure as X
from ..registry import query, table

_EVENT = """x AS (SELECT event_type, event_id % 13 = 0 AS broken, CASE WHEN event_id % 13 = 0 THEN '{' ELSE '{"event": ' || props || ', "users": [' || array_to_string([('{"id": ' || user_id || ', "a.b": [[' || i || ']]}') FOR i IN range(user_id % 4)], ', ') || '], "value": {"of": {"type": "' || event_type || '"}}}' END AS j FROM events),
n AS (SELECT event_type, t.key, t.type, t.fullkey FROM (SELECT event_type, j::JSON AS j FROM x WHERE NOT broken) y, json_tree(y.j) t),
p AS (SELECT event_type, regexp_replace(regexp_replace(regexp_replace(fullkey, '\\[[0-9]+\\]', '', 'g'), '^\\$\\.?', ''), '"', '', 'g') AS path, fullkey, type, regexp_matches(fullkey, '\\]$') AS element FROM n),
c AS (SELECT event_type, path, count(*) AS n FROM p WHERE path <> '' AND NOT element GROUP BY ALL),
f AS (SELECT event_type, count(*) FILTER (NOT broken) AS n_records, count(*) FILTER (broken) AS n_invalid FROM x GROUP BY ALL),
d AS (SELECT event_type, max(CASE WHEN user_id % 4 > 0 AND event_id % 13 <> 0 THEN 5 WHEN event_id % 13 <> 0 THEN 3 END) AS depth FROM events GROUP BY ALL)"""


@query(rf"""WITH {_EVENT} SELECT event_type, n_records, n_invalid, depth, path, n FROM f JOIN d USING (event_type) JOIN c USING (event_type)""")
def json_structure(spark, d):
    """Events as nested JSON, some of it broken: paths of keys with their numbers, and the depth."""
    each = F.transform(F.sequence(F.lit(0), F.col("user_id") % 4), lambda i: F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit(', "a.b": [['), i.cast("string"), F.lit("]]}")))
    users = F.array_join(F.slice(each, 1, (F.col("user_id") % 4).cast("int")), ", ")
    text = F.concat(F.lit('{"event": '), "props", F.lit(', "users": ['), users, F.lit('], "value": {"of": {"type": "'), "event_type", F.lit('"}}}'))
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 13 == 0, "{").otherwise(text).alias("j"))
    return X.json_structure(rows, ["event_type"], "j")


@query(
    r"""WITH x AS (SELECT page_id % 3 AS part, page_id, page_id % 11 = 0 AS broken, 1 + page_id % 5 AS items, length(url) AS n FROM pages WHERE page_id % 11 <> 7), g AS (SELECT * FROM x WHERE NOT broken),
t AS (SELECT part, 'tag' AS kind, name, count(*) AS n FROM (SELECT part, unnest(['page', 'url', 'items']) AS name FROM g) GROUP BY ALL UNION ALL SELECT part, 'tag', 'item', sum(items)::BIGINT FROM g GROUP BY ALL UNION ALL SELECT part, 'tag', 'deep', coalesce(sum(items) FILTER (page_id % 2 = 0), 0)::BIGINT FROM g GROUP BY ALL)
SELECT part, kind, name, n FROM t WHERE n > 0 UNION ALL SELECT part, 'elements', '', sum(n)::BIGINT FROM t GROUP BY part
UNION ALL SELECT part, 'attribute', 'id', count(*) FROM g GROUP BY part UNION ALL SELECT part, 'attribute', 'n', sum(items)::BIGINT FROM g GROUP BY part UNION ALL SELECT part, 'root', 'page', count(*) FROM g GROUP BY part
UNION ALL SELECT part, 'depth', '', max(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END) FROM g GROUP BY part UNION ALL SELECT part, 'invalid', '', count(*) FROM x WHERE broken GROUP BY part"""
)
def xml_structure(spark, d):
    """Pages told as XML by their columns, some of it broken: tags, attributes, depth."""
    item = lambda i: F.concat(F.lit('<item n="'), i.cast("string"), F.lit('">'), F.when(F.col("page_id") % 2 == 0, "<deep/>").otherwise("x"), F.lit("</item>"))
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.col("page_id") % 5), item), "")
    whole = F.concat(F.lit('<page id="'), F.col("page_id").cast("string"), F.lit('"><url><![CDATA['), "url", F.lit("]]></url><items>"), items, F.lit("</items></page>"))
    rows = table(spark, d, "pages").where("page_id % 11 <> 7").select((F.col("page_id") % 3).alias("part"), F.when(F.col("page_id") % 11 == 0, "<page><url></page>").otherwise(whole).alias("x"))
    return X.xml_structure(rows, ["part"], "x")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (v IS NULL OR v = '') AS n_null, count(nullif(v, '')) AS n_values, count(DISTINCT nullif(v, '')) AS n_unique, coalesce(round(avg(length(nullif(v, ''))), 1), 0) AS avg_length, '{role}' AS role, true AS is_likely_messages FROM (SELECT {c}::VARCHAR AS v FROM conversations)"
        for c, role in {"conv_id": "unknown", "turn": "unknown", "role": "unknown", "text": "body"}.items()
    )
)
def table_structure(spark, d):
    """The columns of a table given as maps, as rows of databases are, with their roles."""
    rows = table(spark, d, "conversations")
    fields = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))])
    columns = X.table_columns(rows.select(F.lit("conversations").alias("table"), fields.alias("fields")), ["table"], "fields").withColumn("role", P.role_of(F.col("column"), "sqlite"))
    return columns.join(P.likely_messages(columns, ["table"]), "table").drop("table")


_FACES = "😀🚀✈☀🇮"


@query(
    f"""WITH x AS (SELECT source, unnest(string_split(translate(text, 'aeiou', '{_FACES}'), '')) AS c FROM documents), g AS (SELECT source, c AS emoji, count(*) AS n FROM x WHERE contains('{_FACES}', c) GROUP BY ALL)
SELECT source, emoji, n FROM g"""
)
def top_emoji(spark, d):
    """Emoji in place of vowels, counted by source."""
    return P.top_emoji(table(spark, d, "documents").select("source", F.translate("text", "aeiou", _FACES).alias("text")), ["source"])
