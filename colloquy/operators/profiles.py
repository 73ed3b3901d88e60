"""Data profiles: columns, texts, timestamps, duplicate fingerprints, JSON keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text

#: What a column's name ends in, by its role, and names of identifiers, in CSV files and in databases. The first role that matches counts.
ROLES = {
    "csv": (
        ("timestamp", ("timestamp", "time", "date", "created", "sent", "received", "_at")), ("sender", ("sender", "from", "author", "source", "participant", "jid", "phone")),
        ("body", ("body", "text", "message", "content", "msg", "chat", "caption")), ("media", ("media", "attach", "file", "path", "url", "thumb")),
    ),
    "sqlite": (
        ("timestamp", ("timestamp", "time", "date", "created", "modified", "sent", "received", "_at")), ("sender", ("sender", "from", "author", "source", "participant", "jid", "phone")),
        ("body", ("body", "text", "message", "content", "msg", "chat", "caption")), ("media", ("media", "attach", "file", "path", "url", "thumb", "key", "name")),
    ),
}
ID_NAMES = {"csv": ("id", "_id", "uuid"), "sqlite": ("id", "_id", "rowid", "uuid", "z_pk")}
#: Emoji by their ranges, and texts that stand for media.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2700}-\x{27BF}\x{1F900}-\x{1F9FF}\x{2600}-\x{26FF}]"
PLACEHOLDER = r"(?i)^\s*(<media omitted>|<immagine omessa>|<audio omesso>|\[image\]|\[audio\]|\[video\]|null|none)\s*$"
URL, PHONE = r"https?://\S+|www\.\S+", r"\+?\d[\d\s\-]{7,}\d"
BUCKETS = ((50, "1-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000"))


def role_of(name: Column, kind: str = "csv") -> Column:
    """The role of a column by its name, in a CSV file or in a database (kind: sqlite)."""
    low = F.lower(name)
    out = F.when(low.isin(*ID_NAMES[kind]), "id").otherwise("unknown")
    for role, ends in reversed(ROLES[kind]):
        out = F.when(low.rlike(f"({'|'.join(ends)})$"), role).otherwise(out)
    return out


def likely_messages(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, is_likely_messages) of columns (keys, role): whether a table has a sender or a body."""
    return columns.groupBy(*keys).agg(F.bool_or(F.col("role").isin("body", "sender")).alias("is_likely_messages"))


def columns(df: DataFrame) -> DataFrame:
    """(column, role, n_rows, null_rate, unique_rate of values, average length), a row per column, in one pass of grouped counts; blanks count as null."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("x")).select("x.*")
    values = each.groupBy("column", F.when(has_text(F.col("value")), F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    length = F.length("value")
    real = F.col("value").isNotNull()
    got = values.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(real).alias("distinct"), F.sum(F.when(real, F.col("n") * length).otherwise(0)).alias("chars")
    )
    filled = F.col("n_rows") - F.col("nulls")
    return got.select(
        "column", role_of(F.col("column")).alias("role"), "n_rows", F.round(F.col("nulls") / F.col("n_rows"), 4).alias("null_rate"),
        F.when(filled > 0, F.round(F.col("distinct") / filled, 4)).otherwise(0.0).alias("unique_rate"), F.when(filled > 0, F.round(F.col("chars") / filled, 1)).otherwise(0.0).alias("avg_length"),
    )


def texts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Counts and lengths per key; empties are blank texts and take no part in the other figures."""
    t = F.col(text)
    full = has_text(t)
    n = F.when(full, F.length(t))
    bucket = {name: (n <= most) & (n > least) for (most, name), least in zip(BUCKETS, (0, *(b[0] for b in BUCKETS)), strict=False)} | {">5000": n > BUCKETS[-1][0]}
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~full).alias("empty"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"),
        F.round(F.avg(n), 1).alias("avg_length"), F.count_if(full & t.rlike(URL)).alias("with_url"), F.count_if(full & t.rlike(PHONE)).alias("with_phone"),
        F.count_if(full & t.rlike("[\n\r]")).alias("with_newline"), F.count_if(full & t.rlike(EMOJI)).alias("with_emoji"), F.count_if(full & t.rlike(PLACEHOLDER)).alias("placeholders"),
        F.count_if(full & F.contains(t, F.lit("\ufffd"))).alias("undecoded"), *[F.count_if(b).alias(f"length_{name.replace('-', '_').replace('>', 'over_')}") for name, b in bucket.items()],
    )


def top_emoji(df: DataFrame, keys: list[str], text: str = "text", k: int = 10) -> DataFrame:
    """(keys, emoji, n): the k most frequent emoji of each key, ties by code point."""
    from pyspark.sql import Window

    each = df.where(F.col(text).rlike(EMOJI)).select(*keys, F.explode(F.regexp_extract_all(text, F.lit(EMOJI), F.lit(0))).alias("emoji"))
    counts = each.groupBy(*keys, "emoji").agg(F.count("*").alias("n"))
    return counts.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "emoji"))).where(F.col("_k") <= k).drop("_k")


def duplicate_fingerprints(df: DataFrame, fields: list[str], fold_case: bool = False) -> DataFrame:
    """How many fingerprints of the fields occur more than once, and how many rows are copies."""
    value = [F.coalesce(F.lower(F.col(f).cast("string")) if fold_case else F.col(f).cast("string"), F.lit("")) for f in fields]
    groups = df.groupBy(F.md5(F.concat_ws("|", *value)).alias("fingerprint")).agg(F.count("*").alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"))


def timestamps(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Kinds of times per key, given as numbers or as texts: null or blank, zero, negative, milliseconds, seconds, ISO texts, and what is none of these; the range of all times as milliseconds; those after 2030."""
    from .records import iso_parsed

    raw = F.col(value).cast("string")
    number = raw.try_cast("double")
    iso = F.when(number.isNull(), F.coalesce(iso_parsed(raw)["utc"], iso_parsed(raw)["naive"].cast("timestamp")))
    rows = df.select(*keys, raw.alias("_raw"), number.alias("_v"), F.unix_millis(iso).alias("_iso"))
    v, filled = F.col("_v"), has_text(F.col("_raw"))
    ms = F.when(v > 10**12, v.cast("long")).when(v > 0, (v * 1000).cast("long")).otherwise(F.col("_iso"))
    return rows.withColumn("_ms", ms).groupBy(*keys).agg(
        F.count_if(~filled).alias("nulls"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.count_if(v > 10**12).alias("milliseconds"),
        F.count_if((v > 0) & (v <= 10**12)).alias("seconds"), F.count_if(F.col("_iso").isNotNull()).alias("iso"), F.count_if(filled & v.isNull() & F.col("_iso").isNull()).alias("unread"),
        F.min("_ms").alias("min_ms"), F.max("_ms").alias("max_ms"), F.count_if(F.col("_ms") >= 1_924_992_000_000).alias("future"),
    )


def json_keys(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """The most frequent keys of JSON objects with their number and the number of distinct values."""
    keys = F.explode(F.json_object_keys(column)).alias("key")
    rows = df.select(column, keys).selectExpr("key", f"get_json_object(`{column}`, concat('$.', key)) AS value")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values")).orderBy(F.desc("n"), "key").limit(k)
