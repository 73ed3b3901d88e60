"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are binned at quantiles; cyclic boosting visits one feature after another with a small step
and a shallow tree over its bins, then does the same for the best pairs of features on coarse grids.
The sum of the trees of a feature (or pair) is a lookup table, so a score is a sum of table entries
picked by bin, computed for a whole batch at once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled rows used for fitting, at most; chosen by a hash of the identifier.
SAMPLE_ROWS = 20_000
#: A document counts as good from this score on.
THRESHOLD = 0.3
MAX_BINS, COARSE_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, STEP = 32, 8, 6, 120, 40, 0.15

#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for on with as was be this are or from at it an der die das und von zu den mit ist im nicht "
    "ein eine für auf el la de que y los las por con una para es se del en le les des et un du est pour dans sur par pas".encode().split()
)

FEATURES = [
    "log_bytes", "log_words", "word_len", "longest_word", "upper", "digits", "symbols", "exclaims", "pipes", "brackets", "commas", "stops",
    "non_ascii", "newlines", "distinct_words", "distinct_pairs", "top_word", "repeat_lines", "line_words", "function_words", "marked_words",
    "deflated",
]
_SYMBOLS = np.frombuffer(b"#*$%&|<>@^~_=+\\{}[]", np.uint8)


def text_features(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw) or 1
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = len(words) or 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rows = len(lines) or 1
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(c for w, c in tally.items() if w[-1] in b"#*$%&|<>!")
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(len(w) * c for w, c in tally.items()) / k, float(max(map(len, tally), default=0)),
        count[65:91].sum() / n, count[48:58].sum() / n, count[_SYMBOLS].sum() / n, count[33] / n, count[124] / n, (count[60] + count[62]) / n, count[44] / k, count[46] / k,
        count[128:].sum() / n, count[10] / k, len(tally) / k, pairs / max(1, len(words) - 1), max(tally.values(), default=0) / k,
        1 - len(set(lines)) / rows if lines else 0.0, len(words) / rows, sum(tally.get(w, 0) for w in FUNCTION_WORDS) / k, ends / k,
        len(zlib.compress(raw, 1)) / n,
    ]


def features(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, f array<double>) for every row of docs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text_features(x) for x in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "f"]
            )

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, f array<double>")


@dataclass
class AdditiveModel:
    """Cut points per feature, a table per feature, and a table per pair on coarse bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good class for each row of x."""
        total = np.full(len(x), self.base)
        for j, cut in enumerate(self.cuts):
            total += self.tables[j][np.searchsorted(cut, x[:, j], "right")]
        small = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for p in self.pairs for j in p}
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[small[a], small[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A step function over ordered bins: up to `leaves` leaves by greedy best splits, Newton values."""
    bounds = [(0, len(grad))]
    g, h = np.concatenate(([0], np.cumsum(grad))), np.concatenate(([0], np.cumsum(hess)))
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(bounds) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(bounds):
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = score(a, s) + score(s, b) - score(a, b)
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), k, int(s[i])), key=lambda t: t[0])
        if best[1] is None:
            break
        a, b = bounds[best[1]]
        bounds[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in bounds:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _grid(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best two-level tree over a grid: one cut on each axis, four Newton leaves; and its gain."""
    g, h = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r, c = grad.shape
    best, gain = None, 0.0
    whole = g[r, c] ** 2 / (h[r, c] + 1.0)
    for i in range(1, r):
        for j in range(1, c):
            gs = np.array([g[i, j], g[i, c] - g[i, j], g[r, j] - g[i, j], g[r, c] - g[i, c] - g[r, j] + g[i, j]])
            hs = np.array([h[i, j], h[i, c] - h[i, j], h[r, j] - h[i, j], h[r, c] - h[i, c] - h[r, j] + h[i, j]])
            got = float((gs**2 / (hs + 1.0)).sum() - whole)
            if got > gain:
                best, gain = (i, j, gs / (hs + 1.0)), got
    out = np.zeros_like(grad, dtype=float)
    if best:
        i, j, v = best
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return out, gain


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit by cyclic boosting. Without both classes the score is the constant share of good rows."""
    x = np.nan_to_num(np.asarray(x, float).reshape(len(y), len(FEATURES)))
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], MAX_BINS) if len(y) else np.zeros(0) for j in range(len(FEATURES))]
    coarse = [_cuts(x[:, j], COARSE_BINS) if len(y) else np.zeros(0) for j in range(len(FEATURES))]
    model = AdditiveModel(base, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            n = len(cuts[j]) + 1
            tree = STEP * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n))
            model.tables[j] += tree
            total += tree[b]
    low = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def sums(a, b, p):
        n, m = len(coarse[a]) + 1, len(coarse[b]) + 1
        flat = low[a] * m + low[b]
        return np.bincount(flat, y - p, n * m).reshape(n, m), np.bincount(flat, p * (1 - p), n * m).reshape(n, m)

    p = 1 / (1 + np.exp(-total))
    ranked = sorted(combinations(range(len(FEATURES)), 2), key=lambda t: -_grid(*sums(*t, p))[1])
    model.pairs = ranked[:PAIRS]
    model.grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            tree = STEP * _grid(*sums(a, b, p))[0]
            model.grids[k] += tree
            total += tree[low[a], low[b]]
    return model


def held_out(id) -> F.Column:
    """True for the fifth of the identifiers that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """One row (doc_id, good) per labelled identifier; repeated labels vote, nulls don't."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("good"))


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, good) of at most sample_rows labelled documents of docs that aren't held out, the first by a hash of doc_id.

    Only identifiers are read and shuffled; the bound makes the result fit for a broadcast.
    """
    known = known_labels(labels).where(~held_out("doc_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return stored(ids.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "sample")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the sampled() documents; of rows that share a doc_id one counts, that with the least statistics."""
    chosen = sampled(docs, labels, sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    one = features(texts).groupBy("doc_id").agg(F.min("f").alias("f"))
    rows = one.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("f", "good").collect()
    return fit(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))


def _scorer(model: AdditiveModel):
    """A column function from texts to scores; the model's tables go out with the function."""

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        x = np.nan_to_num(np.array([text_features(t) for t in texts], float).reshape(len(texts), len(FEATURES)))
        return pd.Series(model.scores(x), dtype="float64")

    return run


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; docs has doc_id and text.

    Null or empty texts get the score that the model gives to an empty text; a null doc_id isn't held
    out; repeated rows get a row each; an empty labels table gives 0.5 to all; an empty table gives no rows. Other columns are ignored.
    """
    run = _scorer(learn(docs, labels, sample_rows))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, columns unchanged. Each row is judged by its own text, in a filter without a shuffle.

    Null and empty texts are judged like score() does; rows without or with repeated doc_id are judged like any other; an empty
    table gives no rows. Columns of docs may have any names.
    """
    return docs.where(_scorer(learn(docs, labels))(F.col("text").cast("string")) >= threshold)
