"""Topic verdicts: aggregation over chunks, consistency with discovery, confusion metrics, ranking, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregated(outcomes: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """One verdict per key. decision is PRESENT, ABSENT, UNCERTAIN, or null for a part that failed.

    Any PRESENT wins; else a failed part or any UNCERTAIN makes it UNCERTAIN; else ABSENT. Counts only, so a key of any size is combined before the shuffle.
    """
    d = F.col(decision)
    counts = outcomes.groupBy(*keys).agg(
        F.count("*").alias("n_parts"), F.count_if(d.isNull()).alias("n_failed"), F.count_if(d == "PRESENT").alias("n_present"), F.count_if(d == "UNCERTAIN").alias("n_uncertain")
    )
    verdict = F.when(F.col("n_present") > 0, "PRESENT").when((F.col("n_failed") > 0) | (F.col("n_uncertain") > 0), "UNCERTAIN").otherwise("ABSENT")
    return counts.select(*keys, "n_parts", "n_failed", verdict.alias("decision"))


def verdict_evidence(outcomes: DataFrame, keys: list[str], decision: str = "decision", evidence: str = "evidence_id", order: str = "seq") -> DataFrame:
    """(keys, evidence, order) of what each verdict of aggregated() rests on, once and by its first place, a row each; null keys are a key.

    The PRESENT parts of a PRESENT verdict, the UNCERTAIN parts of an UNCERTAIN one without failed parts, else none.
    """
    verdicts = aggregated(outcomes, keys, decision).where("decision = 'PRESENT' or decision = 'UNCERTAIN' and n_failed = 0")
    v = verdicts.select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)], F.col("decision").alias("_decision"))
    same = F.col(decision) == F.col("_decision")
    for n, k in enumerate(keys):
        same = same & F.equal_null(F.col(k), F.col(f"_{n}"))
    return outcomes.join(v, same, "left_semi").groupBy(*keys, evidence).agg(F.min(order).alias(order))


def consistency(rows: DataFrame, discovered: str, detected: str, decision: str) -> DataFrame:
    """status, overlap (in discovery order), jaccard of two evidence arrays and a decision."""
    overlap = F.array_intersect(discovered, detected)
    union = F.size(F.array_union(discovered, detected))
    jaccard = F.when(union > 0, F.round(F.size(overlap) / union, 4)).otherwise(F.lit(0.0))
    status = (
        F.when((F.col(decision) == "PRESENT") & (F.size(overlap) > 0), "CONSISTENT").when(F.col(decision) == "PRESENT", "PARTIALLY_CONSISTENT")
        .when(F.col(decision) == "ABSENT", "INCONSISTENT_ABSENT").otherwise("INCONSISTENT_UNCERTAIN")
    )
    return rows.withColumns({"n_overlap": F.size(overlap).cast("long"), "jaccard": jaccard, "status": status})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, keys: list[str], expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Counts and rates; an UNCERTAIN answer counts against what was expected. F1 is of the rounded rates."""
    present, hit, miss = F.col(expected) == "PRESENT", F.col(actual) == "PRESENT", F.col(actual) == "ABSENT"
    n = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(present & hit).alias("tp"), F.count_if(~present & ~miss).alias("fp"), F.count_if(~present & miss).alias("tn"), F.count_if(present & ~hit).alias("fn")
    )
    c = F.col
    rates = n.withColumns({"accuracy": _ratio(c("tp") + c("tn"), c("n")), "precision": _ratio(c("tp"), c("tp") + c("fp")), "recall": _ratio(c("tp"), c("tp") + c("fn"))})
    return rates.withColumn("f1", _ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def top_topics(citations: DataFrame, k: int, topic: str = "topic", part: str = "part", order: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """The k topics with most parts, then most citations, then first seen, then by name, per key."""
    keys = keys or []
    rows = citations.groupBy(*keys, topic).agg(F.count_distinct(part).alias("support"), F.count("*").alias("citations"), F.min(order).alias("first_seen"))
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("support"), F.desc("citations"), "first_seen", topic))
    return rows.withColumn("rank", ranked.cast("long")).where(F.col("rank") <= k)


def missing_parts(planned: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return planned.join(done.select(*on).distinct(), on, "left_anti")


def filled(diagnostics: DataFrame, plan: DataFrame, on: str, status: str = "status") -> DataFrame:
    """The plan's parts with what is recorded of them; NOT_RECORDED where nothing is."""
    return plan.join(diagnostics, on, "left").withColumn(status, F.coalesce(status, F.lit("NOT_RECORDED")))
