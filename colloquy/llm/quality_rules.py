"""Quality rules as learned decision lists, in DataFrame operations only.

Statistics of whole texts are Spark expressions. Sequential covering learns an ordered list of conjunctions of
thresholds that reject a text: grow a rule condition by condition with the best information gain on
two thirds of the labelled rows, prune it on the rest, set aside what it covers, and go on. Every step is
one grouped count over all labelled rows; the list becomes nested conditional expressions.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, stored
from .quality_model import sampled

WINDOW_WORDS = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_RULES, MAX_CONDITIONS, CUTS = 8, 4, 24
#: Labelled documents that the list is learned from, at most; chosen by a hash of the identifier.
SAMPLE_ROWS = 20_000
#: A pruned rule must reject at least this share of bad rows among the labelled rows it covers.
MIN_PRECISION = 0.8

#: Names of what the rules may look at, as expressions over statistics().
MEASURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


#: What statistics() adds, in order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_bangs"]


def statistics(docs: DataFrame, keep: list[str], named: dict[str, str] | None = None) -> DataFrame:
    """The columns `keep` of docs and the counts of every whole text. Null texts count as empty; a repeated row gets its own row.

    named: other names for the counts.
    """
    name = {c: fresh(docs.columns, c) for c in COUNTS} | (named or {})
    t, w, n, h = (fresh(docs.columns, c) for c in ("_text", "_words", "_lines", "_hashes"))
    text = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t))
    words = text.select(
        "*", F.regexp_extract_all(t, F.lit(f"[^{SPACES}]+"), F.lit(0)).alias(w), F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias(n)
    )
    at = lambda i, k: F.element_at(F.col(w), (i + k).cast("int"))
    windows = F.when(
        F.size(w) >= WINDOW_WORDS,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW_WORDS)])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = words.select("*", windows.alias(h))
    counts = (
        F.size(w), F.length(F.regexp_replace(t, f"[{SPACES}]+", "")), F.regexp_count(t, F.lit("[#*$%&|<>]")), F.size(n) - F.size(F.array_distinct(n)),
        F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(F.col(h))), F.size(n), F.size(F.array_distinct(w)), F.regexp_count(t, F.lit("[A-Z]")), F.regexp_count(t, F.lit("!")),
    )
    return hashed.select(*[F.col(f"`{c}`") for c in keep], *[x.cast("long").alias(name[c]) for c, x in zip(COUNTS, counts, strict=True)])


def _let(value: Column, body) -> Column:
    """body with value bound once, also where lambdas inside use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(h: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, each word once."""
    ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def places(s):
        twin = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda e, i: twin(e, i - 1) | twin(e, i + 1)), lambda e: e["i"]))

    start = F.struct(F.lit(0).alias("t"), F.lit(-WINDOW_WORDS).alias("last"))
    add = lambda a, p: F.struct((a["t"] + F.least(F.lit(WINDOW_WORDS), p - a["last"])).alias("t"), p.alias("last"))
    return _let(ranked, lambda s: F.aggregate(places(s), start, add, lambda a: a["t"]))


def base_failed(named: dict[str, str] | None = None) -> Column:
    """The fixed rule: under ten words, or over a fifth of the words in repeated windows."""
    c = lambda x: F.col((named or {}).get(x, x))
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def column(self, named: dict[str, str] | None = None) -> Column:
        x = F.expr(re.sub(r"\b(?:n|word)_\w+", lambda m: f"`{(named or {}).get(m[0], m[0])}`", MEASURES[self.measure]))
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


def verdict(rules: list[list[Condition]], named: dict[str, str] | None = None) -> Column:
    """kept: an ordered conditional expression that rejects by the first rule that holds."""
    out = F.when(base_failed(named), F.lit(False))
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column(named)
        out = out.when(hit, F.lit(False))
    return out.otherwise(F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """A decision list from at most sample_rows labelled documents that aren't held out, those of them that pass the base rule."""
    names = list(MEASURES)
    chosen = F.broadcast(sampled(docs, labels, sample_rows))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    rows = (
        stored(statistics(known, ["doc_id", "good"]), "statistics").where(~base_failed())
        .select(
            (F.lit(1) - F.col("good")).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(3)) > 0).alias("grow"),
            *[F.expr(e).alias(n) for n, e in MEASURES.items()],
        )
    )
    rows = stored(rows, "labelled")
    marks = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    picked = rows.agg(*[F.percentile_approx(n, marks, 100_000).alias(n) for n in names]).head()
    found = rows.where("bad = 1").agg(*[F.percentile_approx(n, marks, 100_000).alias(n) for n in names]).head()
    cuts = {n: sorted({*(picked[n] or []), *(found[n] or [])}) for n in names}
    if not any(cuts.values()):
        return []
    place = lambda n: F.size(F.filter(F.lit(cuts[n]) if cuts[n] else F.array().cast("array<double>"), lambda c: F.col(n) > c))
    binned = stored(rows.select("bad", "grow", F.array(*[place(n) for n in names]).alias("b")), "binned")

    def holds(rule):
        out = F.lit(True)
        for j, above, t in rule:
            out = out & ((F.get("b", j) > t) if above else (F.get("b", j) <= t))
        return out

    rules, done = [], F.lit(False)
    while len(rules) < MAX_RULES:
        rule: list[tuple[int, bool, int]] = []
        left = binned.where(~done)
        while len(rule) < MAX_CONDITIONS:
            counts = left.where(F.col("grow") & holds(rule)).select("bad", F.posexplode("b")).groupBy("pos", "col").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = _best_condition(counts, {j: len(cuts[n]) for j, n in enumerate(names)})
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        tally = left.agg(
            *[F.sum(F.when(holds(rule[:k]) & (F.lit(True) if whole else ~F.col("grow")), F.col("bad") if bad else 1 - F.col("bad"))).alias(f"c{k}{whole:d}{bad:d}")
              for k in range(1, len(rule) + 1) for whole in (False, True) for bad in (True, False)]
        ).head()
        worth = lambda k: ((tally[f"c{k}01"] or 0) - (tally[f"c{k}00"] or 0)) / max(1, (tally[f"c{k}01"] or 0) + (tally[f"c{k}00"] or 0))
        k = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        bad, good = tally[f"c{k}11"] or 0, tally[f"c{k}10"] or 0
        if bad < 2 or bad / (bad + good) < MIN_PRECISION:
            break
        rule = rule[:k]
        rules.append([Condition(names[j], above, cuts[names[j]][t]) for j, above, t in rule])
        done = done | holds(rule)
    return rules


def _best_condition(counts: list, n_cuts: dict[int, int]) -> tuple[int, bool, int] | None:
    """The threshold with the best FOIL gain, from counts of bad and of all rows by measure and bin."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["pos"], {})[r["col"]] = (r["p"], r["n"])
    if not by:
        return None
    p0, n0 = (sum(v[i] for v in by[min(by)].values()) for i in (0, 1))
    if p0 == 0 or p0 == n0:
        return None
    best, top = None, 1e-6
    for j in sorted(by):
        p = n = 0
        for t in range(n_cuts[j]):
            p, n = p + by[j].get(t, (0, 0))[0], n + by[j].get(t, (0, 0))[1]
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if q and m < n0:
                    gain = q * (math.log2((q + 0.1) / (m + 0.2)) - math.log2((p0 + 0.1) / (n0 + 0.2)))
                    if gain > top:
                        best, top = (j, above, t), gain
    return best


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. Null texts have no
    words and fail the base rule; repeated rows get a row each; without labels the base rule alone decides; an empty table gives no rows.
    """
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return statistics(two, ["doc_id"]).withColumn("base_failed", base_failed()).withColumn("kept", verdict(learn(two, labels)))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the decision list keeps, columns unchanged. Each row is judged by its own text, in a filter without a shuffle.

    Null texts have no words and go; rows without or with repeated doc_id are judged like any other; an empty table gives no
    rows. Columns of docs may have any names: where one has that of a count, the count takes another.
    """
    rules = learn(docs, labels)
    inner = {c: fresh(docs.columns, c) for c in COUNTS}
    # a filter that looks at a row number made beside the verdict isn't moved below it, where each count would be worked out once for each mention
    row, kept = fresh(docs.columns, "_row"), fresh(docs.columns, "_kept")
    judged = statistics(docs, docs.columns, inner).select(*[F.col(f"`{c}`") for c in docs.columns], verdict(rules, inner).alias(kept), F.monotonically_increasing_id().alias(row))
    return judged.where(F.col(kept) & (F.col(row) >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
