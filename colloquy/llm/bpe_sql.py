"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark tasks.

A text is cut by the vocabulary's pattern; each distinct piece is merged once per batch and remembered within
bounds. Pieces become rows (piece, position, token). A recursive query joins neighbouring tokens to the
merge table, contracts every piece's leftmost pair of least rank, and goes on until no pair of a piece is in the
table. The identifiers of whole texts are then joined to the vocabulary and gathered in order, which decodes them.

A piece of over SHORT bytes (a run of letters, dashes or ideographs) would need as many steps as it has bytes. It is cut into
overlapping blocks that are merged on their own, and the blocks are joined where both have a token's end. That is exact: a list
of tokens is what the whole text gives if, and only if, each two neighbours give themselves when merged alone, as a first pair
contracted across a token's end would be contracted for those two as well; so it is enough to test the two tokens at each
joint. Where no joint holds, larger blocks are tried, at last the whole piece, by a query that contracts all pairs of the least rank in one
step, unless a pair that this makes has a lesser rank.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import latin_pieces, slices

#: Pieces remembered per worker process (and as many met before those), and pieces and bytes merged by one query.
MEMORY, BATCH, BATCH_BYTES = 400_000, 20_000, 250_000
#: Bytes of a piece that is merged whole, and the blocks tried for longer ones: bytes and overlap on each side.
SHORT, BLOCKS = 64, ((96, 32), (1024, 128))

#: Position numbers stay below this; rank * ROOM + position orders pairs by rank, then from the left.
ROOM = 1 << 32

MERGE_SQL = f"""
WITH RECURSIVE state AS (
    SELECT 0 AS step, piece, pos, token, next FROM start
    UNION ALL
    (
        WITH pairs AS (
            SELECT s.step, s.piece, s.pos, s.token, s.next, n.next AS later, m.rank * {ROOM} + s.pos AS pair
            FROM state s
            LEFT JOIN state n ON n.piece = s.piece AND n.pos = s.next
            LEFT JOIN merges m ON m.a = s.token AND m.b = n.token
        ), best AS (
            SELECT piece, min(pair) AS pair, arg_min(next, pair) AS gone FROM pairs WHERE pair IS NOT NULL GROUP BY piece
        )
        SELECT p.step + 1, p.piece, p.pos,
               CASE WHEN p.pair = b.pair THEN (b.pair // {ROOM})::INTEGER ELSE p.token END,
               CASE WHEN p.pair = b.pair THEN p.later ELSE p.next END
        FROM pairs p JOIN best b ON b.piece = p.piece
        WHERE p.pos <> b.gone
    )
), final AS (
    SELECT piece, max(step) AS step FROM state GROUP BY piece
)
SELECT piece, token FROM state JOIN final USING (piece, step) ORDER BY piece, pos
"""

#: All pairs of the least rank at once; of overlapping ones every second. Only the first where a new pair would have a lesser rank.
MERGE_ALL_SQL = """
WITH RECURSIVE state AS (
    SELECT 0 AS step, piece, pos, token FROM start
    UNION ALL
    (
        WITH near AS (
            SELECT step, piece, pos, token, lag(token) OVER w AS before, lead(token) OVER w AS later, lead(token, 2) OVER w AS beyond, row_number() OVER w AS k
            FROM state WINDOW w AS (PARTITION BY piece ORDER BY pos)
        ), pairs AS (
            SELECT n.*, m.rank, min(m.rank) OVER (PARTITION BY piece) AS least FROM near n LEFT JOIN merges m ON m.a = n.token AND m.b = n.later
        ), hits AS (
            SELECT piece, k, before, beyond, rank, k - row_number() OVER (PARTITION BY piece ORDER BY k) AS island FROM pairs WHERE rank = least
        ), taken AS (
            SELECT *, lag(k) OVER (PARTITION BY piece ORDER BY k) AS last
            FROM (SELECT *, row_number() OVER (PARTITION BY piece, island ORDER BY k) AS nth FROM hits) WHERE nth % 2 = 1
        ), judged AS (
            SELECT t.piece, t.k, t.rank, t.last IS NULL AS leftmost,
                   bool_or(coalesce(l.rank < t.rank, false) OR coalesce(r.rank < t.rank, false)) OVER (PARTITION BY t.piece) AS lesser
            FROM taken t
            LEFT JOIN merges l ON l.a = CASE WHEN t.last = t.k - 2 THEN t.rank ELSE t.before END AND l.b = t.rank
            LEFT JOIN merges r ON r.a = t.rank AND r.b = t.beyond
        ), done AS (
            SELECT piece, k, rank FROM judged WHERE leftmost OR NOT lesser
        )
        SELECT p.step + 1, p.piece, p.pos, coalesce(d.rank, p.token)::INTEGER
        FROM pairs p
        LEFT JOIN done d ON d.piece = p.piece AND d.k = p.k
        LEFT JOIN done gone ON gone.piece = p.piece AND gone.k = p.k - 1
        WHERE p.least IS NOT NULL AND gone.k IS NULL
    )
), final AS (
    SELECT piece, max(step) AS step FROM state GROUP BY piece
)
SELECT piece, token FROM state JOIN final USING (piece, step) ORDER BY piece, pos
"""

DECODE_SQL = "SELECT list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocab USING (id)"


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_open: dict[str, SqlBpe] = {}


class SqlBpe:
    """A connection with the vocabulary and its merge table, and the pieces met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY, batch: int = BATCH):
        import duckdb
        import regex

        self.whole = regex.compile(pattern).findall
        self.memory, self.batch, self.known, self.before, self.joints = memory, batch, {}, {}, {}
        self.octet = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes = {r: t for t, r in ranks.items()}
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        triples = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, rank = (pa.array(x, pa.int32()) for x in zip(*triples, strict=True)) if triples else (pa.array([], pa.int32()),) * 3
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        merges, vocab = pa.table({"a": a, "b": b, "rank": rank.cast(pa.int64())}), pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())})  # noqa: F841
        self.sql.execute("CREATE TABLE merges AS FROM merges")
        self.sql.execute("CREATE TABLE vocab AS FROM vocab")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.sql.register(name, rows)
        found = self.sql.sql(query).to_arrow_table()
        self.sql.unregister(name)
        return found

    def merged(self, pieces: list[bytes], query: str = MERGE_SQL) -> list[np.ndarray]:
        """The identifiers of each piece; none is empty. Pieces go into queries of bounded size, in the order given."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(pieces):
            end, held = at, 0
            while end < len(pieces) and end - at < self.batch and (end == at or held + len(pieces[end]) <= BATCH_BYTES):
                held += len(pieces[end])
                end += 1
            part, at = pieces[at:end], end
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            piece = np.repeat(np.arange(len(part)), sizes)
            pos = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            last = np.zeros(len(piece), bool)
            last[np.cumsum(sizes) - 1] = True
            start = pa.table({"piece": piece.astype(np.int32), "pos": pos, "token": self.octet[np.frombuffer(b"".join(part), np.uint8)], "next": np.where(last, -1, pos + 1)})
            rows = self._run(query, "start", start)
            ends = np.searchsorted(rows["piece"].to_numpy(), np.arange(len(part)), "right").tolist()
            ids = rows["token"].to_numpy().astype("<u4")
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def merged_long(self, raws: list[bytes]) -> list[np.ndarray]:
        """The identifiers of each piece of any length, by blocks joined where that is exact."""
        out: list = [None] * len(raws)
        left = list(range(len(raws)))
        for n, (step, over) in enumerate(BLOCKS):
            cuts = [(i, s) for i in left for s in range(0, len(raws[i]), step)]
            found = self.merged([raws[i][max(0, s - over) : s + step + over] for i, s in cuts], MERGE_ALL_SQL if n else MERGE_SQL)
            blocks: dict[int, list] = {i: [] for i in left}
            for (i, s), ids in zip(cuts, found, strict=True):
                blocks[i].append((max(0, s - over), ids))
            for i, ids in self._joined(blocks, [len(r) for r in raws]).items():
                out[i] = ids
            left = [i for i in left if out[i] is None]
        for i, ids in zip(left, self.merged([raws[i] for i in left], MERGE_ALL_SQL), strict=True):
            out[i] = ids
        return out

    def _joined(self, blocks: dict[int, list], sizes: list[int]) -> dict[int, np.ndarray]:
        """Of pieces given as overlapping blocks (first byte, identifiers), those that could be joined."""
        bounds = {i: [at + np.concatenate(([0], np.cumsum(self.size[ids]))) for at, ids in parts] for i, parts in blocks.items()}
        asked = {}
        for i, parts in blocks.items():
            for k in range(len(parts) - 1):
                one, two = bounds[i][k], bounds[i][k + 1]
                places = np.intersect1d(one[1:], two[:-1])
                asked[i, k] = [(int(p), int(parts[k][1][np.searchsorted(one, p) - 1]), int(parts[k + 1][1][np.searchsorted(two, p)])) for p in places]
        self._learn({(a, b) for found in asked.values() for _, a, b in found})
        out = {}
        for i, parts in blocks.items():
            places = [next((p for p, a, b in asked[i, k] if self.joints[a, b]), None) for k in range(len(parts) - 1)]
            if None not in places:
                edges = [0, *places, sizes[i]]
                out[i] = np.concatenate([ids[np.searchsorted(b, lo) : np.searchsorted(b, hi)] for (_, ids), b, lo, hi in zip(parts, bounds[i], edges, edges[1:], strict=False)])
        return out

    def _learn(self, pairs: set[tuple[int, int]]) -> None:
        """Remember which pairs of tokens give themselves when merged alone."""
        if len(self.joints) > self.memory:
            self.joints = {}
        new = sorted(pairs - self.joints.keys())
        found = self.merged([self.bytes[a] + self.bytes[b] for a, b in new])
        self.joints.update((pair, ids.tolist() == list(pair)) for pair, ids in zip(new, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The identifiers of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
        cut = [latin_pieces(t, False) for t in texts]
        cut = [self.whole(t) if c is None else c for c, t in zip(cut, texts, strict=True)]
        if len(self.known) > self.memory:
            self.known, self.before = {}, self.known
        met: set[str] = set()
        for c in cut:
            met.update(c)
        new = met - self.known.keys()
        self.known.update((p, self.before[p]) for p in new & self.before.keys())
        # pieces of like length together: a query ends when its longest piece does
        fresh = sorted(new - self.before.keys(), key=lambda p: (len(p), p))
        raws = [p.encode("utf-8", "surrogatepass") for p in fresh]
        for part, merge in ((False, self.merged), (True, self.merged_long)):
            at = [n for n, raw in enumerate(raws) if (len(raw) > SHORT) == part]
            self.known.update((fresh[n], ids.tobytes()) for n, ids in zip(at, merge([raws[n] for n in at]), strict=True))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each list of identifiers, by an ordered aggregation."""
        ends = np.cumsum([0, *map(len, rows)]) // 4
        if not ends[-1]:
            return [b""] * len(rows)
        tokens = pa.table({"pos": np.arange(ends[-1]), "id": np.frombuffer(b"".join(rows), np.int32)})
        # the lists lie one behind the other, so they are decoded as one and cut where each ends
        flat = self._run(DECODE_SQL, "tokens", tokens)["parts"].combine_chunks().values
        places = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1, 4 * flat.offset)[ends].tolist()
        data = flat.buffers()[2]
        return [data[a:b].to_pybytes() for a, b in zip(places, places[1:], strict=False)]


def codec(path: str, pattern: str) -> SqlBpe:
    """This process's codec for a rank file."""
    if path not in _open:
        _open[path] = SqlBpe(read_ranks(path), pattern)
    return _open[path]


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row of docs (doc_id, text); decoded comes from ids alone.

    Null texts count as empty and give no identifiers; repeated rows get a row each; texts of any length are encoded whole; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts, 2_000_000):
                found = own.encode(texts[part])
                ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(found)), ids, pa.array(own.decode(found), pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
