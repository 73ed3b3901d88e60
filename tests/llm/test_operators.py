"""The training-data operators against brute force, exact round trips and edge cases on small tables."""

import base64
import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe_sql, common, fixity, lattice, packing, passages, quality_model, quality_rules, simhash, sstable, suffixes

WORDS = [f"w{n:03d}" for n in range(400)]
DOCS = "doc_id long, text string, lang string, a int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(1, 70)
    near = shared.split()
    near[30] = "changed"
    texts = [
        prose(2, 100) + " " + shared + " " + prose(3, 90), prose(4, 80) + "\n" + shared + " " + prose(5, 50), prose(6, 60) + " " + " ".join(near), prose(7, 120),
        "", None, "one two", "É ça ünï 你好 ''s don't  x\n\n", prose(7, 120), "tab\tsep " * 300, prose(8, 6000), "x <|endoftext|> y <|startoftext|>Z",
    ]
    rows = [(n, t, "en", 1) for n, t in enumerate(texts)] + [(3, texts[3], "en", 1), (None, texts[3], "en", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    vectors = [(n, (base[n % 30] + 0.13 * rng.standard_normal(64) * (n >= 30)).tolist(), n % 30 % 3) for n in range(150)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, base[0].tolist(), None), (904, base[0].tolist(), 0), (905, [None] + [1.0] * 63, 1)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in lattice.near_duplicates(df, largest=16).collect()}
    usable = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in vectors + odd if i not in (900, 901, 902, 903, 905)]
    links = {i: 0 for i, *_ in usable}
    total = found = 0
    for n, (i, x, k) in enumerate(usable):
        for j, y, m in usable[n + 1 :]:
            if k == m and x @ y >= 0.93:
                links[i] += 1
                links[j] += 1
                total += 2
    found = sum(r.n_links for r in got.values())
    assert total and 0.9 * total <= found <= total
    assert all(got[i].n_links <= links[i] for i in links) and len(got) == 156
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 905)) and got[904].component_id == 0


def near_pairs(rng, n, dim, low, high):
    """Unit vectors and others at a cosine between low and high."""
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.standard_normal((n, dim))
    r -= (r * a).sum(1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    c = rng.uniform(low, high, n)[:, None]
    return a, c * a + np.sqrt(1 - c * c) * r


@pytest.mark.parametrize("dim", [64, 768])
def test_lattice_levels_find_near_pairs(dim):
    rng = np.random.default_rng(3)
    a, b = near_pairs(rng, 600, dim, 0.93, 0.95)
    label = np.zeros(600, np.int64)
    for level in lattice.LEVELS:
        x, y = (lattice.cells(v, label, level) for v in (a, b))
        assert x.shape[1] == level.tables * level.keys
        assert np.mean([len(set(p) & set(q)) > 0 for p, q in zip(x.tolist(), y.tolist(), strict=True)]) >= 0.96


def test_meetings_do_not_follow_a_labels_size(spark):
    rng = np.random.default_rng(8)

    def met(n):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        rows = pa.table({"label": np.zeros(n, np.int64), "v": pa.array([v.tobytes() for v in x], pa.binary()), "no": np.arange(n)}).to_pandas()
        sizes = lattice.bucketed(spark.createDataFrame(rows)).groupBy("bucket").count()
        return sizes.select(F.sum(F.col("count") * (F.col("count") - 1))).head()[0] / n

    few, many = met(4000), met(16000)
    assert few < 50 and many < 50 and many < 2 * few


def test_embedding_recall_with_planted_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = near_pairs(rng, 2500, 64, 0.925, 0.95)
    ids = np.arange(5000)
    rows = [(int(i), v.tolist(), int(i % 2500 == 0) + 1) for i, v in zip(ids, np.concatenate([a, b]), strict=True)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    cosine = (a * b).sum(1)
    near = {i for i in range(1, 2500) if cosine[i] >= 0.93}
    linked = {i for i in range(2500) if got[i].n_links}
    assert linked <= near | {0} and len(linked & near) >= 0.95 * len(near) and 500 < len(near) < 2400
    assert all(got[i + 2500].component_id == i and not got[i + 2500].kept and got[i].n_links == 1 for i in linked & near)


def test_embedding_edges(spark):
    v, w = [1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]
    rows = [(1, v, 1), (1, v, 1), (2, w, 1), (3, v, 1), (3, [0.0, 1.0, 0.0], 1), (4, v, 2), (None, v, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1, True), 2: (0, 2, True), 3: (2, 1, False), 4: (0, 4, True), None: (0, None, True)}
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int, LABEL_2 int")).count() == 0


def test_golay_keys_cover_three_bits():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**64, dtype=np.uint64)
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        one, two = (set(simhash.keys(np.array([x]))[1].tolist()) for x in (a, b))
        assert one & two


def test_simhash_classes(spark, docs):
    rows = simhash.near_duplicates(docs, largest=2).collect()
    assert len(rows) == docs.count()
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    for r in rows:
        member = {int(r.fingerprint, 16)}
        while True:
            more = {p for _, p in prints if any((p ^ m).bit_count() <= 3 for m in member)}
            if more == member:
                break
            member = more
        assert r.component_id == min(i for i, p in prints if p in member and i is not None)
    by = dict(prints)
    assert by[4] == by[5] == 0 and by[3] == by[8]
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} >= {0, 1, 3, 4} and simhash.keep_first(docs).columns == docs.columns


def test_token_shards(spark, docs):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    manifest = sstable.write_shards(docs, P.path("word_bpe_49k.json"))
    rows = sstable.read_shards(spark, manifest).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    at = 0
    assert len(rows) == docs.count()
    for r in sorted(rows, key=lambda r: r.start):
        want = [*tokens.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
    first = manifest.head()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(first.path)
    with store.open_input_file(path) as stream:
        reader = sstable.ShardReader(stream, stream.size())
        assert reader.get(10**12) == [] and sum(1 for _ in reader) == first.n_docs
    assert sstable.read_shards(spark, sstable.write_shards(docs.limit(0), P.path("word_bpe_49k.json"))).count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(n, f"http://x/{n}", "WARC/ \r\n\r\nWARC/1.1 " * (n % 3) + "é" * n) for n in range(120)] + [(500, None, None), (None, "u", "x")], "page_id long, url string, html string")
    folder = fixity.write_archives(pages, file_records=40)
    same = fixity.replicate(spark, folder)
    assert fixity.audit(spark, folder, same, 4).count() == 0
    leaves = fixity.build_trees(spark, folder, 4).where("level = 0")
    assert leaves.count() == 122 and leaves.where("record_id is null").count() == 1

    def damage(number, raw):
        return raw.replace(b"Content-Length: ", b"Content-Xength: ") if number == 7 else raw[:-5] + b"#" + raw[-4:] if number in (31, 77) else raw

    found = fixity.audit(spark, folder, fixity.replicate(spark, folder, damage), 4).collect()
    assert sorted(r.left_record_id for r in found if r.left_record_id is not None) == [7, 31, 77] and {r.status for r in found} <= {"changed", "only_right", "only_left"}


def test_classifier(spark):
    good = [(n, prose(n, 120).capitalize() + ". " + prose(n + 1000, 80) + ".") for n in range(300)]
    bad = [(n, "BUY $$$ NOW!!! " * (5 + n % 7) + "".join(chr(35 + (n * 7 + k) % 20) for k in range(60))) for n in range(300, 600)]
    df = spark.createDataFrame([*good, *bad, (900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = quality_model.score(df, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and held
    assert sum(r.predicted == (r.doc_id < 300) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality_model.score(df, labels.limit(0)).collect()} == {0.5}


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    small = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(small, P.path("byte_bpe_50k.json"), window=256, open_windows=3, fan_in=2).collect()
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, parts in by.items():
        parts.sort(key=lambda r: r.start)
        got = [x for r in parts for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert got == [*tokens.encode(texts[i], add_special_tokens=False).ids, 1]
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist() and {r.doc_tokens for r in parts} == {len(got)}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0


def brute_repeats(texts, length=200):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for n, raw in enumerate(raws):
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k : k + length], []).append((n, k))
    marks = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for n, k in places:
                marks[n][k : k + length] = b"\1" * length
    return [(len(r), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(bytes(b for b, x in zip(r, m, strict=True) if not x)).hexdigest()) for r, m in zip(raws, marks, strict=True)]


def test_repeated_bytes(spark, docs):
    rows = docs.withColumn("doc_id", F.monotonically_increasing_id())
    rows = rows.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)
    listed = rows.collect()
    want = dict(zip([r.doc_id for r in listed], brute_repeats([r.text for r in listed]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(rows, largest=2).collect()}
    assert got == want


def test_quality_statistics(spark, docs):
    texts = ["a b c d e f a b c d e g", "x # y *", "l1 w\nl1 w\n \nl2", "", None, prose(3, 30), "p q r s t " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(df, labels).collect()}
    for n, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed)
        r = got[n]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not failed)


def test_decision_list_learns(spark):
    good = [(n, prose(n, 60)) for n in range(200)]
    bad = [(n, prose(n, 30) + " # * % $ | < >" * 6) for n in range(200, 400)]
    df = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, quality int")
    rows = quality_rules.judge(df, labels).where("not base_failed").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.kept == (r.doc_id < 200) for r in held) / len(held) > 0.95


def test_byte_bpe(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe_sql.encode_and_decode(docs, path, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == own.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()


def test_passages(spark, docs):
    rows = passages.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.of_doc_id) for r in rows}
    assert (1, 0) in pairs and {2} <= {a for a, _ in pairs} and (8, 3) in pairs
    assert all((r.doc_id is None or r.of_doc_id < r.doc_id or r.doc_id == 3) and r.n_words >= 50 and r.similarity >= 0.8 for r in rows)
    assert {a for a, _ in pairs} == {1, 2, 3, 8, None}  # the rows of text 7 after the first, one of them without an identifier
    one = next(r for r in rows if (r.doc_id, r.of_doc_id) == (1, 0))
    assert one.start <= 80 and one.start + one.n_words >= 150 and one.n_words <= 80
    every = passages.without_repeats(docs).collect()
    assert len(every) == docs.count() and sorted(len((r.text or "").split()) for r in every if r.doc_id in (3, 8, None)) == [0, 0, 0, 120]
    cut = {r.doc_id: r for r in every}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(cut[1].text.split()) <= 135 and cut[0].text == texts[0] and cut[5].text is None and not cut[8].text.strip()
    assert passages.without_repeats(docs).columns == docs.columns
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def test_passages_whose_parts_are_known_from_others(spark):
    rows = []
    for k in range(20):
        parts = [prose(1000 + 10 * k + n, (30, 20)[k % 2]) for n in range(2 + k % 2)]
        whole = " ".join(parts)
        texts = [*parts, whole, *parts, whole]  # parts before A, A itself, parts between A and D, D
        rows += [(100 * k + n, prose(5000 + 100 * k + n, 40) + " " + t + " " + prose(8000 + 100 * k + n, 40)) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.of_doc_id): r for r in passages.repeated_passages(docs).collect()}
    for k in range(20):
        m = 2 + k % 2
        r = found[100 * k + 2 * m + 1, 100 * k + m]
        assert r.start <= 40 and r.start + r.n_words >= 100
    assert {a for a, _ in found} == {100 * k + 2 * (2 + k % 2) + 1 for k in range(20)}


def test_near_passages_against_planted_ones(spark):
    """Passages of 50 to 100 words with a tenth to a fifth of the words changed, dropped or added: nine tenths or more are found."""
    rng = random.Random(9)
    rows, planted = [], {}
    for k in range(150):
        own = prose(20_000 + k, rng.randint(50, 100)).split()
        near = list(own)
        for _ in range(round(len(own) * rng.uniform(0.1, 0.2))):
            at = rng.randrange(len(near))
            if (kind := rng.random()) < 0.8:
                near[at] = f"x{rng.randrange(10**6)}"
            elif kind < 0.9:
                del near[at]
            else:
                near.insert(at, f"x{rng.randrange(10**6)}")
        same = len(own) - sum(w not in own for w in near)
        rows.append((2 * k, prose(30_000 + k, 60) + " " + " ".join(own) + " " + prose(40_000 + k, 60)))
        rows.append((2 * k + 1, prose(50_000 + k, 60) + " " + " ".join(near) + " " + prose(60_000 + k, 60)))
        if len(near) >= 55 and same >= 0.82 * len(near):  # at the bounds a shorter passage may miss either
            planted[2 * k + 1] = len(near)
    found = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.of_doc_id == r.doc_id - 1
        found.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    caught = sum(len(found.get(i, set()) & set(range(60, 60 + n))) >= 0.7 * n for i, n in planted.items())
    assert len(planted) > 60 and caught >= 0.9 * len(planted), (caught, len(planted))


def test_common_passages(spark):
    """A line of 20 words in many documents joins none of them; a passage of 60 words in many joins each with the first; two common parts in two documents join these."""
    line, whole, parts = prose(70_000, 20), prose(70_001, 60), [prose(70_002 + n, 30) for n in range(2)]
    text = lambda n, *x: " ".join([prose(71_000 + n, 50), *x, prose(72_000 + n, 50)])
    rows = [(n, text(n, line)) for n in range(60)] + [(n, text(n, whole)) for n in range(60, 120)] + [(n, text(n, parts[n % 2])) for n in range(120, 200)]
    rows += [(n, text(n, *parts)) for n in (160_000, 160_001)]
    found = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.of_doc_id)
    assert set(found) == {*range(61, 120), 160_001}
    assert all(60 in found[n] for n in range(61, 120)) and found[160_001] == {160_000}


def test_rows_and_columns_of_stages(spark):
    """Rows that share an identifier or have none are judged one by one; columns may have the names that the stages use inside."""
    a, b = prose(80_000, 120), prose(80_001, 120)
    rows = [(1, a, "s", 1), (1, b, "s", 2), (1, b, "s", 3), (None, a, "s", 4), (None, "!! $$ " * 20, "s", 5), (2, None, "s", 6), (2, "", "s", 7), (3, b + " tail", "s", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, _row int").withColumns({"_text": F.lit("t"), "n_words": F.lit("n"), "_doc": F.lit("d"), "_fp": F.lit(0)})
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id long, quality int")
    cut = {r._row: r for r in passages.without_repeats(docs).collect()}
    assert [len((cut[n].text or "").split()) for n in (1, 2, 3, 4)] == [120, 120, 0, 0] and cut[6].text is None and cut[1].text == a and cut[2]._text == "t"
    assert len((cut[8].text or "").split()) <= 1
    kept = {r._row for r in simhash.keep_first(docs).collect()}
    assert {1, 5, 6, 8} <= kept and len(kept & {2, 3}) == 1 and not kept & {4, 7}
    assert {r._row for r in quality_rules.keep_accepted(docs, labels).collect()} >= {1, 2, 3, 4, 8} and not {r._row for r in quality_rules.keep_accepted(docs, labels).collect()} & {6, 7}
    for stage in (lambda d: quality_rules.keep_accepted(d, labels), lambda d: quality_model.keep_good(d, labels), simhash.keep_first, passages.without_repeats):
        assert stage(docs).columns == docs.columns and stage(docs.limit(0)).count() == 0


def test_every_exact_window_is_covered(spark):
    """Against a brute-force set of windows: repeats of 50 to 70 words cut at random out of earlier documents, near bounds of sort ranges too."""
    rng = random.Random(3)
    texts = [prose(n, 120).split() for n in range(40)]
    for n in range(40, 200):
        a, k = rng.choice([t for t in texts if len(t) > 70]), rng.randint(50, 70)
        at = rng.randrange(len(a) - k)
        texts.append([*prose(n, rng.randint(0, 40)).split(), *a[at : at + k], *prose(-n, rng.randint(0, 40)).split()])
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    covered = {}
    for r in passages.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    seen = set()
    for n, t in enumerate(texts):
        windows = [tuple(t[i : i + 50]) for i in range(len(t) - 49)]
        for i, w in enumerate(windows):
            # where two passages overlap, up to seven words at an end of one may be left to the other
            assert w not in seen or set(range(i + 7, i + 43)) <= covered.get(n, set()), (n, i)
        seen.update(windows)


def test_group_beyond_one_batch_is_not_cut(monkeypatch):
    parts = [pa.RecordBatch.from_arrays([pa.array([1, 1])], names=["k"])] * 2
    assert common._whole(parts, "k")[0].num_rows == 4
    split = SimpleNamespace(combine_chunks=lambda: SimpleNamespace(to_batches=lambda: parts))
    monkeypatch.setattr(common, "pa", SimpleNamespace(Table=SimpleNamespace(from_batches=lambda _: split)))
    with pytest.raises(ValueError):
        common._whole(parts, "k")


def test_chains_and_alignment():
    assert passages.chains([(0, 10, 0, 3), (20, 30, 22, 3), (15, 18, 500, 1)])[0] == [(0, 10, 0, 3), (20, 30, 22, 3)]
    x = np.array([1, 2, 3, 4, 5], np.uint32)
    assert passages.common_words(x, np.array([1, 9, 3, 5], np.uint32)) == ([1, 1, 2, 2], 3)
    assert passages.extension(np.arange(14), np.array([0, 1, 2, 3, 4, *[99] * 9])) == (5, 5)
    assert passages.extension(np.arange(20), np.array([0, 1, 2, 77, *range(3, 19)])) == (20, 19)
    assert passages.align('g', x, x[:0])[0] == 0 and passages.align('d', x, np.array([9, 1, 2, 3, 4], np.uint32)) == (4, 5, 5)
    assert passages.best_runs([5, -9, 6], [60, 10, 70], 50) == [(0, 3)] and passages.best_runs([5, -12, 6, -1], [60, 10, 70, 9], 50) == [(2, 3), (0, 1)]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert simhash.near_duplicates(none).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_model.score(none, labels).count() == 0
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0
    assert suffixes.remove_repeats(none).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
