"""Where a message's media lies: references resolved to paths, and whether these stay below the folders that are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text

#: Beginnings of remote references, and states of a reference.
REMOTE = ("http://", "https://", "ftp://", "ftps://")
STATES = ("AMBIGUOUS", "NO_REFERENCE", "REMOTE_REFERENCE", "OUTSIDE_ALLOWED_ROOT", "MISSING", "RESOLVED")


def resolved_path(path: Column) -> Column:
    """An absolute path without empty parts, . and ..; .. at the root stays at the root. Links aren't followed."""
    step = lambda done, part: (
        F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """A resolved path and all folders above it."""
    parts = F.split(path, "/")
    return F.array_distinct(F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def media_states(references: DataFrame, roots: list[str], files: DataFrame) -> DataFrame:
    """references (message_id, reference, source_path, is_ambiguous, more) with state, path and the file's other columns.

    An absolute reference is looked up where it is; a relative one below the folder of its source, if that is allowed, then below each root in order; the first file found counts.
    roots are the folders allowed, a list of a configuration's size; files (path, more) those that exist, a row each. OUTSIDE_ALLOWED_ROOT: nothing was found, and a place to look was not below a root.
    Blank and null references are NO_REFERENCE. Rows with one message_id are told each.
    """
    allowed = [r[0] for r in references.sparkSession.createDataFrame([(r,) for r in roots], "r string").select(resolved_path(F.col("r"))).collect()] if roots else []
    inside = lambda p: F.arrays_overlap(ancestors(p), F.array(*[F.lit(r) for r in allowed])) if allowed else F.lit(False)
    raw = F.trim("reference")
    absolute = F.startswith(raw, F.lit("/"))
    source = resolved_path(parent(F.col("source_path")))
    below = lambda folder: resolved_path(F.concat(folder, F.lit("/"), raw))
    near = F.when(F.startswith("source_path", F.lit("/")) & inside(source), below(source))
    places = F.when(absolute, F.array(resolved_path(raw))).otherwise(F.array_distinct(F.array_compact(F.array(near, *[below(F.lit(r)) for r in allowed]))))
    local = has_text(F.col("reference")) & ~F.lower(raw).rlike("^(" + "|".join(REMOTE) + ")") & ~F.coalesce("is_ambiguous", F.lit(False))
    rows = references.withColumn("_row", F.monotonically_increasing_id()).withColumn("_places", F.when(local, F.transform(places, lambda p: F.struct(p.alias("p"), inside(p).alias("ok")))))
    rows = rows.withColumn("_out", F.exists("_places", lambda x: ~x["ok"]))
    looked = rows.select("_row", F.posexplode("_places").alias("_at", "x")).where("x.ok").select("_row", "_at", F.col("x.p").alias("path"))
    own = [c for c in files.columns if c != "path"]
    found = looked.join(files.select("path", F.struct(F.lit(1).alias("_there"), *own).alias("_file")), "path").groupBy("_row").agg(F.min_by(F.struct("path", "_file"), "_at").alias("_f"))
    out = rows.join(found, "_row", "left")
    state = (
        F.when(F.coalesce("is_ambiguous", F.lit(False)), "AMBIGUOUS").when(~has_text(F.col("reference")), "NO_REFERENCE").when(~local, "REMOTE_REFERENCE").when(F.col("_f").isNotNull(), "RESOLVED")
        .when(F.col("_out") | (F.size("_places") == 0) & absolute, "OUTSIDE_ALLOWED_ROOT").otherwise("MISSING")
    )
    return out.select(*references.columns, state.alias("state"), F.col("_f.path").alias("path"), *[F.col(f"_f._file.`{c}`").alias(c) for c in own])
