"""Every query of the training-data operators over the smallest tables against brute force, and the three newest operators on fixtures of their own."""

import base64
import hashlib
import html as references
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import bpe_sql, codes, fixity, queries, whitening, wrappers

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, name):
    return queries.queries()[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def id_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_op1(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = {r.vec_id: r for r in run(spark, "op1_embedding_near_dedup")}
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    assert set(got) == {r.vec_id for r in rows} and all(got[r.vec_id].n_links <= n for r, n in zip(rows, near.sum(1), strict=True))
    assert sum(r.n_links for r in got.values()) >= 0.9 * near.sum() and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_op2(spark, texts):
    def fingerprint(text):
        words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {}
    for i in sorted(prints):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += [k for k, f in prints.items() if k not in root and (f ^ prints[j]).bit_count() <= 3]
    got = run(spark, "op2_simhash_near_dedup")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", root[i]) for i, f in prints.items()} and len(got) == len(texts)


def test_op3(spark, texts):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    at, want = 0, set()
    for i in sorted(texts):
        ids = [*tokens.encode(texts[i], add_special_tokens=False).ids, 1]
        want.add((i, at, len(ids), zlib.crc32(id_bytes(ids))))
        at += len(ids)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op3_token_sstable")} == want


def test_op4(spark):
    pages = {r.page_id for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = run(spark, "op4_warc_fixity")
    assert {r.page_id for r in got} == {i for i in pages if i % 50 == 0} and all(r.status == "changed" and r.left_digest != r.right_digest and r.left_end_offset > r.left_first_offset for r in got)


def test_op4_missing_files_and_other_heights(spark):
    pages = spark.createDataFrame([(n, f"u{n}", "x" * (n % 9)) for n in range(200)] + [(7, "u7", "x" * 7)] * 3, "page_id long, url string, html string")
    folder = fixity.write_archives(pages, file_records=30)
    paths = sorted(r.path for r in fixity.archive_paths(spark, folder).collect())
    assert len(paths) > 2 and fixity.build_trees(spark, folder).where("level = 0").count() == 203

    def gone(number, raw):  # a file whose tree is lower than its counterpart's
        return raw if number is None or number >= 3 else b""

    other = fixity.replicate(spark, folder, gone)
    os.remove(f"{other.removeprefix('file://')}/{paths[-1]}")
    found = fixity.audit(spark, folder, other, 2).collect()
    by = defaultdict(list)
    for r in found:
        by[r.path].append(r)
    whole = fixity.build_trees(spark, folder).where(f"level = 0 and path = '{paths[-1]}'").count()
    assert {r.status for r in by[paths[-1]]} == {"only_left"} and len(by[paths[-1]]) == whole
    assert {r.left_record_id for r in by[paths[0]] if r.status != "only_right"} >= {0, 1, 2} and set(by) == {paths[0], paths[-1]}
    empty = fixity.write_archives(pages.limit(0))
    assert fixity.audit(spark, empty, empty).count() == 0 and fixity.audit(spark, folder, empty).count() == 203


def test_op5(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r.doc_id: r for r in run(spark, "op5_quality_classifier")}
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in got if got[i].held_out and labels.get(i) is not None]
    assert held and np.mean([got[i].predicted == labels[i] for i in held]) >= 0.85


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, lengths = run(spark, "op6_packing"), Counter()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        ids, at = [*tokens.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == zlib.crc32(id_bytes(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s, parts in sequences.items():
        for offset, length in sorted(parts):
            assert offset == lengths[s]
            lengths[s] += length
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in lengths.values())
    assert max(lengths.values()) <= 2048 and padded - sum(lengths.values()) <= 0.02 * sum(lengths.values()) + 2048


def test_op7(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[s : s + 200] for b in raw.values() for s in range(len(b) - 199))
    for r in run(spark, "op7_suffix_array_dedup"):
        b = raw[r.doc_id]
        gone = np.zeros(len(b) + 1, np.int32)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s] += 1
                gone[s + 200] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~mask]) if b else b""
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op8(spark, texts):
    got = run(spark, "op8_quality_rules")
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed,
        )
        assert not (failed and r.kept)


def tiktoken_of():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op9(spark, texts):
    own = tiktoken_of()
    for r in run(spark, "op9_byte_bpe"):
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_op9_long_pieces():
    own, rng = tiktoken_of(), random.Random(5)
    codec = bpe_sql.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    words = ["the", "ing", "ation", "é", "ß", "你", "x", "qz", "error", "ABC", "e" * 9]
    pieces = ["".join(rng.choice(words) for _ in range(n)) for n in (20, 40, 100, 300, 900, 1600)]
    pieces += ["a" * 65, "a" * 128, "ab" * 700, "=" * 5000, "é" * 900, "".join(rng.choice("abcdefghijklmnop") for _ in range(3000)), "\n" * 200, " " * 3000 + "x"]
    found = codec.encode(pieces)
    for piece, ids in zip(pieces, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(piece)
    assert codec.decode(found) == [p.encode() for p in pieces]


def test_op10(spark, texts):
    """Passages of fifty words or more that an earlier document has are covered, and nothing that no other document has is listed."""
    words = {i: WORD.findall(t.lower()) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    got = defaultdict(list)
    for r in run(spark, "op10_substring_dedup"):
        got[r.doc_id].append((r.start, r.start + r.n_words))
        assert r.of_doc_id < r.doc_id and r.similarity >= 0.8 and r.n_words >= 40
    for i, w in words.items():
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                assert any(lo <= s + 7 and s + 43 <= hi for lo, hi in got[i]), (i, s)


# -- codes ------------------------------------------------------------------------------------------


def test_op11_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{DATA}/embeddings.parquet')")
    got = queries.queries()["op11_vector_codes"](spark, DATA)
    want = con.execute(queries.oracle_sql()["op11_vector_codes"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 2**20, 2**27):
        book = rng.integers(-scale, scale, (64, 5))
        book[40:] = book[:24]  # equal entries: the lower index counts
        points = np.concatenate([rng.integers(-scale, scale, (3000, 5)), book, (book[:-1] + book[1:]) // 2])
        index, distance = codes.nearest(points, book)
        every = ((points[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(2)
        assert index.tolist() == [min(range(64), key=row.__getitem__) for row in every.tolist()] and distance.tolist() == [min(row) for row in every.tolist()]


def lloyd(vectors, ids, parts, entries, rounds):
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    order = np.lexsort((*x.T[::-1], ids))
    cuts = codes.bounds(x.shape[1], parts)
    books = [x[order[:entries], a:b].copy() for a, b in cuts]
    near = lambda p: [min(range(len(books[p])), key=lambda e: ((v - books[p][e]) ** 2).sum()) for v in x[:, cuts[p][0] : cuts[p][1]]]  # noqa: B023, E731
    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            own = np.array(near(p))
            books[p] = np.array([x[own == e, a:b].sum(0) // (own == e).sum() if (own == e).any() else books[p][e] for e in range(len(books[p]))])
    code = np.array([near(p) for p in range(parts)]).T
    error = [int(sum(((v[a:b] - books[p][c[p]]) ** 2).sum() for p, (a, b) in enumerate(cuts))) for v, c in zip(x, code, strict=True)]
    return ["".join(f"{c:02x}" for c in row) for row in code], error


def test_op11_edges(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((40, 10)).round(3).tolist() + [[0.5] * 10] * 3
    ids = [int(i) for i in rng.permutation(40)] + [3, 3, 99]
    labels = [None if n % 5 == 0 else n % 3 for n in range(43)]
    odd = [(200, None, 1), (201, [None] + [0.0] * 9, 1), (202, [float("inf")] + [0.0] * 9, 1), (203, [], 1), (204, [1.0, 2.0], 1)]
    df = spark.createDataFrame([*zip(ids, vectors, labels, strict=True), *odd], "vec_id long, embedding array<double>, label int").withColumn("ERROR", F.lit("x"))
    got = codes.compress(df, parts=4, entries=8, rounds=2).collect()
    code, error = lloyd(vectors, ids, 4, 8, 2)
    total = Counter()
    for e, k in zip(error, labels, strict=True):
        total[k] += e
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, total[k]) for i, c, e, k in zip(ids, code, error, labels, strict=True))
    assert codes.compress(df.limit(0)).count() == 0 and len({r.codebooks_sha256 for r in got}) == 1
    few = codes.compress(spark.createDataFrame([(None, [1.0] * 3, None), (1, [2.0] * 3, None)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [r.error for r in few] == [0, 0] and few[0].code == "00" * 5 + "01" + "00" * 4 + "01" + "00" * 4 + "01"
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int"))


# -- whitening --------------------------------------------------------------------------------------


def check_whitening(rows, ids, vectors, k=16):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (z := fit - s / n).T @ z / n
    e, q = (a[..., ::-1] for a in np.linalg.eigh(v))
    wanted = Counter((i, d) for i, d in zip(ids, ((n * x - s) ** 2).sum(1).tolist(), strict=True))
    by = defaultdict(list)
    for r in rows:
        by[r.component].append(r)
        assert r.n == n and r.identity_error <= 1e-9 and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9
    assert sorted(by) == list(range(1, k + 1))
    for c, own in by.items():
        assert Counter((r.vec_id, int(r.deviation)) for r in own) == wanted
        ref = (x - s / n) @ q[:, c - 1] / np.sqrt(e[c - 1])
        told = sorted((r.vec_id if r.vec_id is not None else -1, abs(r.whitened)) for r in own)
        assert np.allclose([w for _, w in told], [w for _, w in sorted((i if i is not None else -1, abs(w)) for i, w in zip(ids, ref, strict=True))], atol=1e-7)


def test_op13(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    check_whitening(run(spark, "op13_embedding_whitening"), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("tile", [3, 7, 32])
def test_op13_tiles_and_edges(spark, tile):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((300, 20)) @ np.diag(np.linspace(3, 0.3, 20)) + 5).tolist()
    vectors += vectors[:30]
    ids = [*range(329), None]
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [1.0]), (904, [])]
    df = spark.createDataFrame([*zip(ids, vectors, strict=True), *odd], "vec_id long, embedding array<double>").repartition(5).withColumn("N", F.lit(1))
    check_whitening(whitening.whiten(df, tile=tile).collect(), ids, vectors)


def test_op13_degenerate(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(make([(n, [float(n), 2.0 * n, 7.0]) for n in range(50)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 50 and all(abs(r.explained - 1) < 1e-12 for r in line)
    big = whitening.whiten(make([(1, [2.0**30, 0.0]), (2, [-(2.0**30), 1.0]), (3, [0.0, 2.0])])).collect()
    x = [[2**36 + 1_000_000, 1_000_000], [-(2**36) + 1_000_000, 1_000_064], [1_000_000, 1_000_128]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in big} == {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}


# -- pages ------------------------------------------------------------------------------------------


def test_op12(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = run(spark, "op12_html_extraction")
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def site(rng, n, style):
    """A page of a site and its main text; styles are templates of unlike making."""
    word = lambda k: " ".join(rng.choice(["alpha", "beta &amp; co", "gamma", "delta<i>x</i>", "caf&eacute;", "zeta"]) for _ in range(k))
    plain = lambda h: " ".join(references.unescape(re.sub("<[^>]*>", "", h)).split())
    title, paragraphs = f"Title {n} " + word(3), [word(rng.randint(8, 30)) + f" {n}.{k}" for k in range(rng.randint(1, 6))]
    comments = "".join(f"<div class='comment'><p>{word(9)}</p></div>" for _ in range(rng.randint(0, 3)))
    if style == "named":
        page = (
            f"<html><body><header><a href=/>Home</a></header><div class='cookie-notice'>We use cookies</div><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div id='content-{n}' class='post'>"
            f"<h1>{title}</h1><div class='share'>Share this</div>{''.join(f'<p class=x>{p}</p>' for p in paragraphs)}<form><label>Mail</label><input><button>Go</button></form>"
            f"<script>var a = '<p>no</p>';</script><style>p {{ color: red }}</style></div><aside>Read more</aside><section id=comments>{comments}</section><footer>&copy; Site</footer></body></html>"
        )
        return page, [plain(title), *map(plain, paragraphs)]
    if style == "plain":  # nothing says what it is but the places
        page = (
            "<table><tr><td><a href=/1>One</a> <a href=/2>Two</a> <a href=/3>Three</a></td></tr><tr><td><div class=c7>The same on all pages of this site, word by word</div>"
            f"<div class=c8>{'<br>'.join([title])}{''.join(f'<P>{p}' for p in paragraphs)}</div></td></tr><tr><td><ul><li><a href=/x>Related {n}</a></li><li><a href=/y>Other {n + 1}</a></li></ul></td></tr></table>"
        )
        return page, [plain(title), *map(plain, paragraphs)]
    rows = "".join(f"<dt>Term {k}</dt><dd>{p}</dd>" for k, p in enumerate(paragraphs))
    page = f"<body><main><article><header><h1>{title}</h1></header><dl>{rows}</dl><blockquote><p>{word(5)}</p></blockquote><footer>By me</footer></article><article class=comment>{word(6)}</article></main><div hidden>secret</div>"
    quote = plain(re.search("<blockquote><p>(.*?)</p>", page)[1])
    return page, [plain(title), *[x for k, p in enumerate(paragraphs) for x in (f"Term {k}", plain(p))], quote]


@pytest.mark.parametrize("style", ["named", "plain", "terms"])
def test_op12_templates(spark, style):
    rng = random.Random(6)
    made = [site(rng, n, style) for n in range(60)]
    rows = [(n, f"https://{style}.example/{n}", page) for n, (page, _) in enumerate(made)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    for n, (_, blocks) in enumerate(made):
        assert got[n] == "\n".join(blocks), n


def test_op12_edges(spark):
    long = "<div>" * 500 + "deep" + "</div>" * 500
    cases = {
        None: "", "": "", "   \n ": "", "just text": "just text", "<p>a<p>b</p>c": "a\nb\nc", "<!-- x": "", "<p>1 < 2 &lt;b&gt; &#x41;&nbsp;B</p>": "1 < 2 <b> A B", "<p title='a > b'>q</p>": "q", "<script>x": "",
        "<p>a<script>b</script>c</p>": "a c", "</div></p>x</b>": "x", "<ul><li>a<li>b<ul><li>c</ul></ul>": "a\nb\nc", long: "deep", "<p>" + "w " * 50_000 + "</p>": ("w " * 50_000).strip(), "<textarea>no</textarea><title>no</title>yes": "yes",
        "<b><p>one</b> two</p>": "one two", "<P CLASS=AD>buy</P><DIV>keep</DIV>": "keep", "<a href=1>x": "x", "<p>😀</p>".encode("utf-16", "surrogatepass").decode("utf-16"): "😀",
    }
    rows = [(n, [None, "", "nowhere", f"http://h{n}/"][n % 4] if n % 5 else f"http://h{n}.x:80/a", page, "x", "y") for n, page in enumerate(cases)]
    rows = [(n, f"http://u{n}/", p, x, y) for n, _, p, x, y in rows] + [(None, None, "<p>n</p>", "x", "y"), (None, None, "<p>n</p>", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, HOST string")
    got = wrappers.extract(df).collect()
    told = {r.page_id: r for r in got if r.page_id is not None}
    for n, want in enumerate(cases.values()):
        assert told[n].text == want and told[n].n_chars == len(want), n
    assert [(r.text, r.url) for r in got if r.page_id is None] == [("n", None)] * 2 and wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_join_in_any_parts(spark):
    """A host's wrapper holds the counts of all its pages, however they are dealt, and reads as a union-free expression."""
    rng = random.Random(9)
    rows = [(n, "http://one.example/", f"<body><h1>{n}</h1>" + ("<div class=x>opt</div>" if n % 3 else "") + "".join(f"<p>{rng.random()}</p>" for _ in range(1 + n % 4)) + "<hr><i>end</i></body>") for n in range(90)]
    for parts in (1, 40):
        found = wrappers.wrappers(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
        assert len(found) == 1 and found[0].host == "one.example" and found[0].pages == 90
        pattern = wrappers.Part.read(json.loads(found[0].wrapper)).pattern()
        assert pattern == "<page><body><h1>#</h1>(<div x>#</div>)?(<p>#</p>)+#</body></page>"
