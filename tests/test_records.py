"""Rules of raw records on fixtures, numbering at size, and duplicates against a fold over records."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import records as R
from colloquy.sources import chats


def test_numbered_at_size(spark, tmp_path):
    rows = spark.range(400_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("key"), (F.col("id") % 7).alias("payload"))
    R.numbered(rows, ["key"]).write.parquet(str(tmp_path / "n"))
    got = spark.read.parquet(str(tmp_path / "n"))
    assert got.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).head()[:] == (400_000, 400_000, 0, 399_999)
    order = got.where("seq < 50").orderBy("seq").select("key").collect()
    assert order == rows.orderBy("key").limit(50).select("key").collect()


def test_search_form(spark):
    texts = ["Straße", "ＦＵＬＬ ﬁ", "é", "ŒUVRE Σς", "ÀÉ", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", T.normalized(F.col("t")).alias("x")).orderBy("n").collect()
    assert [r.x for r in rows] == ["strasse", "full fi", "é", "œuvre σσ", "àé", None]


def test_headers_and_attachments(spark):
    lines = ["noise", "[2024-02-01, 10.30.15] Ann: hi", "‎[1/2/24, 9:05:07 PM] Bob: see <attached: a b.jpg>", "01/02/2024, 10:02 – Cy: IMG.JPG (file allegato)", "more", "1.2.24 9:05 a.m. - Di: at x-1.pdf now", "1/2/24, 9:06 - Ann added Bob", "1/2/24, 9:07 - Ann added Bob: x"]
    df = spark.createDataFrame([("f", n, v) for n, v in enumerate(lines)], "file string, line_no int, value string")
    got = chats.export_messages(df).orderBy("line_start").collect()
    assert [r.sender for r in got] == ["Ann", "Bob", "Cy", "Di", None, None]
    assert [r.attachment_name for r in got][:4] == [None, "a b.jpg", "IMG.JPG", "x-1.pdf"] and got[2].text.endswith("\nmore")
    assert got[0].raw_timestamp == "2024-02-01, 10.30.15" and got[5].is_system
    assert chats.looks_like_export(df).head().is_export and not chats.looks_like_export(df.where("line_no < 1")).head().is_export


def test_broken_report_is_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"id": "a", ')
    with pytest.raises(Exception, match="not an array of records"):
        chats.read(spark, "report_json", str(tmp_path / "r.json")).collect()


def test_written_dates(spark):
    cases = {"13/02/2024, 10:00": "2024-02-13 10:00", "02/13/2024, 10:00": "2024-02-13 10:00", "02/13/2024 10:00": None, "1/2/69, 1:00 AM": "1969-02-01 01:00", "1/2/68, 12:00 AM": "2068-02-01 00:00", "1.2.2024, 1:00 PM": None, "31/11/2024, 1:00": None,
             "1/2/2024, 13:00 PM": None, "2024/1/2 10:00": None, "[1-2-24, 10:00]": "2024-02-01 10:00", "x": None}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    got = {r.raw: r for r in df.select("raw", F.date_format(R.written_parsed(F.col("raw"))["naive"].cast("timestamp"), "yyyy-MM-dd HH:mm").alias("x")).collect()}
    assert {k: got[k].x for k in cases} == cases


def same_actor(a: tuple, b: tuple) -> str:
    """MATCH, UNKNOWN or INCOMPATIBLE for two senders (source, kind, raw, phone, jid_local, type), the first rule that applies."""
    (s, k, r, p, j, _), (t, m, q, o, i, _) = a, b
    if k is None or m is None:
        return "UNKNOWN"
    equal = lambda yes: "MATCH" if yes else "INCOMPATIBLE"
    if "local_user" in (k, m):
        known = any(x for x in (p, o, j, i)) or {k, m} & {"phone", "jid", "alias"}
        return "MATCH" if k == m else "INCOMPATIBLE" if known else "UNKNOWN"
    if "unknown" in (k, m):
        return "UNKNOWN"
    if p and o:
        return equal(p == o)
    if k == m == "jid":
        return equal(r == q)
    if (p and i) or (o and j):
        return equal(p == i if p and i else o == j)
    if k == m == "alias":
        return "INCOMPATIBLE" if r != q else "MATCH" if s == t else "UNKNOWN"
    return "UNKNOWN"


def same_type(a: str | None, b: str | None) -> str:
    vague = ("UNKNOWN", "OTHER", None)
    return "UNKNOWN" if a in vague or b in vague else "MATCH" if a == b else "INCOMPATIBLE"


def test_duplicates_against_a_fold_over_records(spark):
    rng = random.Random(4)
    senders = [None, "LOCAL_USER", "+3911111", "+3922222", "+3911111@s.net", "a@s.net", "group_participant_A", "group_participant_B", "Bob", "chat_1", "@s.net", "group_participant_C", "+3922222@s.net"]
    rows = [(str(n), n, rng.choice(["store", "report_csv"]), rng.choice(senders), rng.choice(["TEXT", "IMAGE", "UNKNOWN"]), f"t{rng.randrange(30)}") for n in range(600)]
    df = spark.createDataFrame(rows, "record_id string, seq long, source string, raw string, message_type string, text string").withColumn("sender", R.actor(F.col("raw"))).withColumn("stamp", R.from_milliseconds(F.lit(1000)))
    actors = {r.record_id: r.sender for r in df.collect()}
    tell = lambda r: (r[2], *((lambda a: (a.kind, a.raw, a.phone, a.jid_local) if a else (None,) * 4)(actors[r[0]])), r[4])
    want = []
    for text in sorted({r[5] for r in rows}, key=lambda t: min(r[1] for r in rows if r[5] == t)):
        clusters = []
        for r in (r for r in rows if r[5] == text):
            fits = lambda c, r=r: all("INCOMPATIBLE" not in (same_type(r[4], m[4]), same_actor(tell(r), tell(m))) for m in c)
            home = next((c for c in clusters if fits(c)), None)
            if home is None:
                clusters.append(home := [])
            home.append(r)
        for c in clusters:
            if len(c) > 1:
                sure = all(same_actor(tell(a), tell(b)) == "MATCH" for n, a in enumerate(c) for b in c[n + 1 :]) and all(same_type(c[0][4], m[4]) == "MATCH" for m in c[1:])
                want.append((len(c), "STRONG" if sure and len({m[2] for m in c}) > 1 else "WEAK", {m[0] for m in c}))
    candidates, members = R.duplicate_candidates(df)
    of = {}
    for r in members.collect():
        of.setdefault(r.candidate_id, set()).add(r.record_id)
    got = {r.candidate_id: (r.n_records, r.confidence, of[r.candidate_id]) for r in candidates.collect()}
    assert [got[f"duplicate_candidate:{n + 1}"] for n in range(len(got))] == want
    told = R.with_duplicates(df, members).where("duplicate_ids is not null")
    assert told.count() == sum(len(w[2]) for w in want)


def test_small_groups_are_sent_together():
    """The fold sends many groups in a batch, with the figures of their clusters; a cluster's first profile leads it."""
    from colloquy.operators import duplicates as D

    profile = lambda source, phone: [source, "phone", phone, phone, None, "TEXT"]
    rows = [(g.to_bytes(4, "big"), "KNOWN_UTC", g, *profile(s, p), 1) for g in range(25_000) for s, p in (("store", "+1"), ("report_csv", "+1"), ("store", "+2"))]
    names = ["group", "status", "group_seq", *D.PROFILE, "n"]
    types = [pa.binary(), pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    got = list(D._folded(whole.slice(n, 1000) for n in range(0, len(rows), 1000)))
    assert len(got) <= 1 + len(rows) // D.SENT_ROWS and sum(b.num_rows for b in got) == len(rows)
    told = [tuple(r[c] for c in ("group_seq", "cluster", "leads", "n_records", "n_sources", "matched")) for b in got for r in b.to_pylist()]
    assert told == [(g, *t) for g in range(25_000) for t in ((0, True, 2, 2, True), (0, False, 2, 2, True), (1, True, 1, 1, True))]
