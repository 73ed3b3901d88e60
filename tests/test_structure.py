"""Profiles of JSON, XML, CSV files and tables against plain walks."""

import json
import random
import sqlite3
from collections import Counter

from pyspark.sql import functions as F

from colloquy.operators import profiles, structure


def walk(value, path, depth, paths):
    if isinstance(value, dict):
        for k, v in value.items():
            full = f"{path}.{k}" if path else k
            paths[full] += 1
            walk(v, full, depth, paths)
    elif isinstance(value, list):
        for v in value:
            walk(v, path, depth, paths)


def depth_of(value):
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inner is None else max([1 + depth_of(v) for v in inner], default=0)


def test_json_structure(spark):
    rng = random.Random(1)
    make = lambda d: rng.choice([1, "x", None, True, [], {}]) if d == 0 else {rng.choice("abc") + rng.choice(["", ".d"]): make(d - 1) for _ in range(3)} if rng.random() < 0.6 else [make(d - 1) for _ in range(rng.randint(0, 3))]
    deep = {"z": 1}
    for _ in range(40):
        deep = {"n": deep}
    rows = [(n % 3, json.dumps(make(n % 5))) for n in range(60)] + [(7, json.dumps(deep)), (8, "{"), (8, None), (9, "3")]
    got = structure.json_structure(spark.createDataFrame(rows, "g int, j string"), ["g"], "j", 1000).collect()
    for g in {r[0] for r in rows}:
        texts = [t for k, t in rows if k == g]
        values = [json.loads(t) for t in texts if t and t != "{"]
        paths = Counter()
        for v in values:
            walk(v, "", 0, paths)
        own = [r for r in got if r.g == g]
        assert {r.path: r.n for r in own if r.path is not None} == dict(paths)
        assert {(r.n_records, r.n_invalid, r.depth) for r in own} == {(len(values), len(texts) - len(values), max(map(depth_of, values), default=None))}


def test_json_files(spark, tmp_path):
    for name, text in {"a.json": '[{"a": [1]}, 2]', "o.json": '{"a": {"b": 1}}', "s.json": "3", "l.jsonl": '{"a": 1}\n\nnope\r\n{"b": []}\n'}.items():
        (tmp_path / name).write_text(text)
    got = {r.file.rpartition("/")[2]: (r.format, r.n_records, r.n_invalid, r.depth) for r in structure.json_files(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("json_array", 2, 0, 2), "o.json": ("json_object", 1, 0, 2), "s.json": ("json_scalar", 0, 0, 0), "l.jsonl": ("jsonl", 2, 1, 1)}


def test_xml_structure(spark):
    rows = [("p", '<a x="1"><b/><b y="2" x="3"><c/></b></a>'), ("p", "<a/>"), ("p", "<a>"), ("q", None), ("q", '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')]
    got = {(r.g, r.kind, r.name): r.n for r in structure.xml_structure(spark.createDataFrame(rows, "g string, t string"), ["g"], "t").collect()}
    assert got == {("p", "tag", "a"): 2, ("p", "tag", "b"): 2, ("p", "tag", "c"): 1, ("p", "attribute", "x"): 2, ("p", "attribute", "y"): 1, ("p", "root", "a"): 2, ("p", "depth", ""): 2, ("p", "invalid", ""): 1,
                   ("p", "elements", ""): 5, ("q", "invalid", ""): 2}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;text\n" + "".join(f'{n};"x\n{n % 2}"\n' for n in range(10)) + ";\n")
    (tmp_path / "b.csv").write_bytes("name,when\nñ,1\n".encode("latin-1"))
    got = {(r.file.rpartition("/")[2], r.column): (r.charset, r.delimiter, r.n_rows, r.n_null, r.n_unique, r.avg_length) for r in structure.csv_files(spark, str(tmp_path)).collect()}
    assert got["a.csv", "id"] == ("utf-8", ";", 11, 1, 10, 1.0) and got["a.csv", "text"] == ("utf-8", ";", 11, 1, 2, 3.0) and got["b.csv", "name"] == ("latin-1", ",", 1, 0, 1, 1.0)


def test_roles_and_times(spark):
    names = {"created_at": "timestamp", "Date": "timestamp", "sent": "timestamp", "jid": "sender", "phone": "sender", "chat": "body", "thumb": "media", "url": "media", "uuid": "id", "_id": "id", "from_x": "unknown", "filename": "unknown"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.r for r in df.select("n", profiles.role_of(F.col("n")).alias("r")).collect()} == names
    assert [r[0] for r in df.where("n = 'filename'").select(profiles.role_of(F.col("n"), "sqlite")).collect()] == ["media"]
    values = ["0", "-5", "1704067200", "1704067200000", "2024-01-01T00:00:00Z", "2032-01-01", "", None, "soon"]
    r = profiles.timestamps(spark.createDataFrame([("k", v) for v in values], "k string, v string"), "v", ["k"]).head()
    assert (r.nulls, r.zeros, r.negatives, r.seconds, r.milliseconds, r.iso, r.unread, r.future, r.min_ms) == (2, 1, 1, 1, 1, 2, 1, 1, 1704067200000)
    texts = spark.createDataFrame([("a", "hi 😀😀 🚀"), ("a", "<Media omitted>"), ("a", "x�"), ("a", " ")], "k string, text string")
    t = profiles.texts(texts, ["k"]).head()
    assert (t.with_emoji, t.placeholders, t.undecoded, t.empty) == (1, 1, 1, 1)
    assert [(r.emoji, r.n) for r in profiles.top_emoji(texts, ["k"]).orderBy(F.desc("n")).collect()] == [("😀", 2), ("🚀", 1)]


def test_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body\n1,x\n2,\n")
    (tmp_path / "b.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "c.xml").write_text("<a><b/></a>")
    (tmp_path / "d.JPG").write_bytes(b"12345")
    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("CREATE TABLE messages (_id INTEGER, data TEXT, sender TEXT, sent INTEGER)")
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(1, "a", "x", 0), (2, None, "x", 5), (3, "", "yy", 5)])
        db.execute("CREATE TABLE other (k TEXT)")
    got = structure.profile(spark, str(tmp_path))
    assert {r.kind: (r.n, r.largest_name) for r in got["kinds"].collect()} == {"text": (3, "b.json"), "image": (1, "d.JPG"), "database": (1, "m.db")}
    assert {(r.kind, r.extension) for r in got["extensions"].collect()} == {("text", ".csv"), ("text", ".json"), ("text", ".xml"), ("image", ".jpg"), ("database", ".db")}
    assert {(r.column, r.role, r.n_null) for r in got["csv"].collect()} == {("id", "id", 0), ("body", "body", 1)} and got["json"].head().depth == 2
    assert {(r.kind, r.name): r.n for r in got["xml"].collect()}["elements", ""] == 2 and {(r.name, r.n_rows) for r in got["tables"].collect()} == {("messages", 3), ("other", 0)}
    columns = {r.column: (r.role, r.n_null, r.n_values, r.n_unique, r.avg_length) for r in got["columns"].collect()}
    assert columns == {"_id": ("id", 0, 3, 3, 1.0), "data": ("unknown", 2, 1, 1, 1.0), "sender": ("sender", 0, 3, 2, 1.3), "sent": ("timestamp", 0, 3, 2, 1.0)}
    assert {r.table: r.is_likely_messages for r in got["likely_messages"].collect()} == {"messages": True}
    assert structure.markdown(got["kinds"].select("kind", "n")).split("\n") == ["| kind | n |", "| --- | --- |", "| database | 1 |", "| image | 1 |", "| text | 3 |"]


def test_json_in_one_pass(spark, monkeypatch):
    """The number of jobs doesn't grow with the depth, and counts that are sent early add up."""
    deep = lambda n: "[" * n + '{"a": 1}' + "]" * n
    jobs = []
    for n in (1, 30):
        spark.sparkContext.setJobGroup(f"json{n}", "")
        structure.json_structure(spark.createDataFrame([(deep(n),)], "j string"), [], "j").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"json{n}")))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs[0] == jobs[1]
    texts = ["null", '{"": {"a": 1}}', '{"a": {}, "b": [[], 1e999, "\\ud83d\\ude00 \\"}"]}', "[]", "3", "x", None, deep(900), '{"a": 1, "a": 2}', "[1] 2", '{"k\\"": 123456789012345678901234567890123456789012}'] * 40
    monkeypatch.setattr(structure, "HELD_CHARACTERS", 300)
    got = structure.json_structure(spark.createDataFrame([(t,) for t in texts], "j string"), [], "j").collect()
    first = got[0]
    assert {r.path: r.n for r in got} == {"": 40, ".a": 40, "a": 80, "b": 40, 'k"': 40} and (first.n_records, first.n_invalid, first.depth) == (280, 160, 901)
    keyed = spark.createDataFrame([(None, t) for t in texts[:3]] + [([1], '{"z": 0}')] * 2, "g array<int>, j string")
    assert {(str(r.g), r.path): r.n for r in structure.json_nodes(keyed.select("g", F.parse_json("j").alias("v")), ["g"], "v")[0].collect()} == {("None", ""): 1, ("None", ".a"): 1, ("None", "a"): 1, ("None", "b"): 1, ("[1]", "z"): 2}
