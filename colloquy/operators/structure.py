"""Structure profiles of JSON and XML: depth, keys with their paths, tags and attributes; columns of tables; and whole files of all these kinds."""

from __future__ import annotations

import csv
import io
import json
import xml.parsers.expat
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strict_json
from .staging import kept

#: Names that a profile lists: keys of JSON, tags and attributes of XML.
TOP_KEYS, TOP_TAGS, TOP_ATTRIBUTES = 50, 30, 20
#: Characters of paths, about, that a task counts before it sends what it has.
HELD_CHARACTERS = 20_000_000


# -- JSON -------------------------------------------------------------------------------------------


def _json_walked(n_keys: int):
    """Batches (keys, text of a JSON value or null) as counts (keys, path, n, n_invalid, depth): a row for each path of keys, and with a null path the values, the nulls and the deepest level."""

    def counted(batches):
        held: dict[str, list] = {}  # by what the keys look like, as they may be of any type: keys, values, nulls, depth, paths
        size, types = 0, []

        def told():
            rows = [(*own, path, n, 0, None) for own, *_, paths in held.values() for path, n in paths.items()]
            rows += [(*own, None, values, nulls, depth) for own, values, nulls, depth, _ in held.values()]
            held.clear()
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f"c{n}" for n in range(len(types))])

        for batch in batches:
            types = [*(batch.schema.field(n).type for n in range(n_keys)), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = repr(own)
                of = held.get(name) or held.setdefault(name, [own, 0, 0, None, {}])
                if text is None:
                    of[2] += 1
                    continue
                value = json.loads(text)
                paths, deepest = of[4], 0
                todo = [(None, value, 1)] if isinstance(value, (dict, list)) else []
                while todo:
                    path, node, depth = todo.pop()
                    if node and depth > deepest:
                        deepest = depth
                    if isinstance(node, list):
                        todo += [(path, x, depth + 1) for x in node if isinstance(x, (dict, list))]
                        continue
                    for key, x in node.items():
                        full = key if path is None else f"{path}.{key}"
                        if full not in paths:
                            paths[full] = 0
                            size += len(full) + 100
                        paths[full] += 1
                        if isinstance(x, (dict, list)):
                            todo.append((full, x, depth + 1))
                    if size > HELD_CHARACTERS:
                        yield told()
                        held[name] = of = [own, 0, 0, None, paths := {}]
                        size = 0
                of[1] += 1
                of[3] = deepest if of[3] is None else max(of[3], deepest)
                size += 1 if of[1] > 1 else len(name) + 100
                if size > HELD_CHARACTERS:
                    yield told()
                    size = 0
        if held:
            yield told()

    return counted


def json_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(c0, c1.. for keys, path, n, n_invalid, depth) of the variants in rows, in one pass over them: a task sends its counts, not its values, so the same path comes from several tasks.

    A row with a path is a key of objects, by its path, with points between; elements of an array have the array's path. One without a path is all of the values: n of them, n_invalid nulls,
    and the deepest level, 0 for a value that isn't an object or array, null for none.
    """
    names = [f"c{n}" for n in range(len(keys))]
    made = [f"{c} {rows.schema[k].dataType.simpleString()}" for c, k in zip(names, keys, strict=True)]
    found = rows.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], F.to_json(F.col(value)).alias("text"))
    total = len(keys)
    return found.mapInArrow(_json_walked(total), ", ".join([*made, f"c{total} string, c{total + 1} long, c{total + 2} long, c{total + 3} int"])).toDF(*keys, "path", "n", "n_invalid", "depth")


def json_nodes(rows: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(paths, figures) of the variants in rows: paths (keys, path, n) counts every key of every object by its path; figures (keys, n_records, n_invalid, depth) has the numbers of values and of
    nulls, and the deepest level of each keys' values, null if there are none. See json_counts()."""
    seen = kept(json_counts(rows, keys, value))
    paths = seen.where("path IS NOT NULL").groupBy(*keys, "path").agg(F.sum("n").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return paths, seen.where("path IS NULL").groupBy(*keys).agg(total("n").alias("n_records"), total("n_invalid").alias("n_invalid"), F.max("depth").alias("depth"))


def json_structure(rows: DataFrame, keys: list[str], text: str, k: int = TOP_KEYS) -> DataFrame:
    """(keys, n_records, n_invalid, depth, path, n): the k most frequent paths of the JSON texts of each key, ties by path, with the number of records, of texts that aren't JSON, and the
    deepest level. Keys without any path have one row with a null path. Null texts count as invalid."""
    from pyspark.sql import Window

    paths, figures = json_nodes(rows.select(*keys, strict_json(F.col(text)).alias("v")), keys, "v")
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "path") if keys else Window.orderBy(F.desc("n"), "path")
    top = paths.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")
    return figures.join(top, keys, "left") if keys else _beside(figures, top)


def _beside(figures: DataFrame, top: DataFrame) -> DataFrame:
    """The only row of figures beside each row of top."""
    one = F.lit(1).alias("_one")
    return figures.select("*", one).join(top.select("*", one), "_one", "left").drop("_one")


# -- XML --------------------------------------------------------------------------------------------


def walked(text: str) -> tuple[Counter, Counter, int, str] | None:
    """(tags, attributes, depth, root) of a document; None of one that isn't well formed or declares a document type."""
    tags, attributes, level, deepest, root = Counter(), Counter(), 0, 0, []

    def begins(tag, found):
        nonlocal level, deepest
        tags[tag] += 1
        attributes.update(found.keys())
        if not root:
            root.append(tag)
        deepest = max(deepest, level)
        level += 1

    def ends(_):
        nonlocal level
        level -= 1

    def refused(*_):
        raise ValueError("a document type is declared")

    parser = xml.parsers.expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = begins, ends, refused
    try:
        parser.Parse(text, True)
    except (xml.parsers.expat.ExpatError, ValueError):
        return None
    return tags, attributes, deepest, root[0]


def xml_names(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, name, n): tags and attributes of the documents of each key by number, the root's tags, and as kinds depth (n the deepest level, the root being 0) and invalid (documents
    that can't be read; null texts too). A task sends its counts, not its documents."""
    found = rows.select(F.to_json(F.struct(*keys)).alias("k"), F.col(text).alias("t"))

    def counted(batches):
        held: dict[tuple[str, str, str], int] = {}

        def told():
            names = list(held)
            return pa.RecordBatch.from_arrays([*(pa.array([n[i] for n in names], pa.string()) for i in range(3)), pa.array(list(held.values()), pa.int64())], names=["k", "kind", "name", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read = walked(t) if t else None
                if read is None:
                    held[k, "invalid", ""] = held.get((k, "invalid", ""), 0) + 1
                    continue
                tags, attributes, depth, root = read
                for kind, names in (("tag", tags), ("attribute", attributes), ("root", {root: 1})):
                    for name, n in names.items():
                        held[k, kind, name] = held.get((k, kind, name), 0) + n
                held[k, "depth", ""] = max(held.get((k, "depth", ""), 0), depth)
            if len(held) > 100_000:
                yield told()
                held.clear()
        if held:
            yield told()

    counts = found.mapInArrow(counted, "k string, kind string, name string, n long").groupBy("k", "kind", "name")
    whole = counts.agg(F.sum("n").alias("sum"), F.max("n").alias("max")).withColumn("n", F.when(F.col("kind") == "depth", F.col("max")).otherwise(F.col("sum")))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    told = whole.select(*([F.from_json("k", schema).alias("k")] if keys else []), "kind", "name", "n")
    return told.select(*[F.col(f"k.`{c}`").alias(c) for c in keys], "kind", "name", "n")


def xml_structure(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """xml_names() with the 30 most frequent tags and the 20 most frequent attributes of each key, ties by name, and as kind elements the number of all elements."""
    from pyspark.sql import Window

    names = kept(xml_names(rows, keys, text))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "name")
    most = F.when(F.col("kind") == "tag", TOP_TAGS).when(F.col("kind") == "attribute", TOP_ATTRIBUTES)
    top = names.withColumn("_k", F.row_number().over(order)).where(most.isNull() | (F.col("_k") <= most)).drop("_k")
    elements = names.where("kind = 'tag'").groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, F.lit("elements").alias("kind"), F.lit("").alias("name"), "n")
    return top.unionByName(elements)


# -- files ------------------------------------------------------------------------------------------


def json_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, format, n_records, n_invalid, depth): JSON files as arrays, objects, scalars, or lines of which those that aren't JSON are counted as invalid."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", strict_json(F.col("value")).alias("v"))
    kind = F.schema_of_variant("v")
    form = F.when(F.col("v").isNull(), "jsonl").when(F.startswith(kind, F.lit("ARRAY")), "json_array").when(F.startswith(kind, F.lit("OBJECT")), "json_object").otherwise("json_scalar")
    told = kept(whole.select("file", form.alias("format"), "value", "v"))
    items = told.where("format = 'json_array'").select("file", "format", F.col("v").alias("a")).lateralJoin(spark.tvf.variant_explode(F.col("a").outer())).select("file", "format", F.col("value").alias("v"))
    lines = told.where("format = 'jsonl'").select("file", "format", F.explode(F.split("value", "\r\n|\r|\n")).alias("line")).where("trim(line) <> ''")
    records = items.unionByName(told.where("format = 'json_object'").select("file", "format", "v")).unionByName(lines.select("file", "format", strict_json(F.col("line")).alias("v")))
    _, figures = json_nodes(records, ["file"], "v")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return told.select("file", "format").join(figures, "file", "left").select("file", "format", zero("n_records"), zero("n_invalid"), zero("depth"))


def table_columns(rows: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """(keys, column, n_null, n_values, n_unique, avg_length): the columns of rows whose values are a map of texts; blank texts count as null, lengths to one digit.

    Values are counted by what they are first, so a column of one value is a row, not a group of all."""
    each = rows.select(*keys, F.explode(fields).alias("column", "value"))
    values = each.groupBy(*keys, "column", F.when(F.col("value") != "", F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    real = F.col("value").isNotNull()
    n_values = F.sum(F.when(real, F.col("n")).otherwise(0))
    return values.groupBy(*keys, "column").agg(
        F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("n_null"), n_values.alias("n_values"), F.count_if(real).alias("n_unique"),
        F.coalesce(F.round(F.sum(F.when(real, F.length("value") * F.col("n"))) / n_values, 1), F.lit(0.0)).alias("avg_length"),
    )


def _cells(text: Column, delimiter: str) -> Column:
    @F.pandas_udf("array<string>")
    def told(texts: pd.Series) -> pd.Series:
        return pd.Series([next(csv.reader(io.StringIO(t, newline=""), delimiter=delimiter), []) for t in texts], dtype=object)

    return told(text)


def csv_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, charset, delimiter, column, n_rows, n_null, n_unique, avg_length) of CSV files, each read by the charset and delimiter that its beginning tells.

    Rows are cut at delimiters outside quotes, over all of a file; a row with too few cells has nulls, cells beyond the header are left out. n_null counts blanks.
    """
    from ..sources import scan
    from ..sources.sniff import sniffed

    files = sniffed(spark, path).where("charset IS NOT NULL").select("file", "charset", "delimiter").collect()
    out = None
    for charset, delimiter in sorted({(r.charset, r.delimiter) for r in files}):

        own = [r.file for r in files if (r.charset, r.delimiter) == (charset, delimiter)]
        found = scan.csv_records(scan.lines(spark, own, charset)).select("file", "n", _cells(F.array_join(F.transform("lines", lambda x: x["value"]), "\n"), delimiter).alias("cells"))
        names = found.where("n = 1").select("file", F.col("cells").alias("names"))
        each = found.where("n > 1").join(names, "file").select("file", F.posexplode("names").alias("at", "column"), "cells")
        value = F.get("cells", F.col("at"))
        values = each.groupBy("file", "at", "column", F.when(F.trim(value) != "", value).alias("value")).agg(F.count("*").alias("n"))
        real = F.col("value").isNotNull()
        n_values = F.sum(F.when(real, F.col("n")).otherwise(0))
        part = values.groupBy("file", "at", "column").agg(
            F.sum("n").alias("n_rows"), F.sum(F.when(real, 0).otherwise(F.col("n"))).alias("n_null"), F.count_if(real).alias("n_unique"),
            F.coalesce(F.round(F.sum(F.when(real, F.length("value") * F.col("n"))) / n_values, 1), F.lit(0.0)).alias("avg_length"),
        ).select("file", F.lit(charset).alias("charset"), F.lit(delimiter).alias("delimiter"), "column", "n_rows", "n_null", "n_unique", "avg_length")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "file string, charset string, delimiter string, column string, n_rows long, n_null long, n_unique long, avg_length double")


def file_statistics(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by kind, by extension) of an inventory (path, name, kind, size): number, bytes, smallest, largest, average to one digit, empty files, and the largest file's name."""
    extension = F.lower(F.concat(F.lit("."), F.nullif(F.regexp_extract("name", r"\.([^.]+)$", 1), F.lit(""))))
    figures = [
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.round(F.avg("size"), 1).alias("average"), F.count_if(F.col("size") == 0).alias("n_empty"),
        F.max_by("name", F.struct("size", "name")).alias("largest_name"),
    ]
    return files.groupBy("kind").agg(*figures), files.groupBy("kind", F.coalesce(extension, F.lit("")).alias("extension")).agg(*figures)


def profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Everything about the files below a folder: files, kinds and extensions; CSV columns with roles, JSON files, XML names; tables of databases, their columns with roles, and which are likely messages.

    The list of files passes the driver, as Spark's own does; what is in them doesn't. A part without files is missing.
    """
    from ..sources.files import inventory, read_sqlite, sqlite_catalog
    from .profiles import likely_messages, role_of

    files = inventory(spark, path)
    kinds, extensions = file_statistics(files)
    out = {"files": files, "kinds": kinds, "extensions": extensions}
    names = [r.path for r in files.select("path").collect()]
    of = lambda *ends: [n for n in names if n.lower().endswith(ends)]
    if own := of(".csv"):
        out["csv"] = csv_files(spark, own).withColumn("role", role_of(F.col("column")))
    if own := of(".json", ".jsonl"):
        out["json"] = json_files(spark, own)
    if own := of(".xml"):
        out["xml"] = xml_structure(spark.read.text(own, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), ["file"], "value")
    if own := of(".db", ".sqlite", ".sqlite3"):
        tables = kept(sqlite_catalog(spark, own))
        out["tables"], columns = tables, None
        for name in sorted({r.name for r in tables.where("type = 'table'").select("name").collect()}):
            having = [r.path for r in tables.where(F.col("name") == name).select("path").distinct().collect()]
            rows = read_sqlite(spark, having, name, "rowid").select(F.col("path").alias("file"), F.lit(name).alias("table"), F.from_json("fields", "map<string,string>").alias("fields"))
            part = table_columns(rows, ["file", "table"], "fields")
            columns = part if columns is None else columns.unionByName(part)
        if columns is not None:
            out["columns"] = columns.withColumn("role", role_of(F.col("column"), "sqlite"))
            out["likely_messages"] = likely_messages(out["columns"], ["file", "table"])
    return out


def markdown(rows: DataFrame, most: int = 200) -> str:
    """The first rows of a small result, in the order of its columns, as a Markdown table; `most` is how many a report shows."""
    found = rows.orderBy(*[c for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith("map")]).limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(rows.columns)} |", f"| {' | '.join('---' for _ in rows.columns)} |", *(f"| {' | '.join(cell(v) for v in r)} |" for r in found)])
