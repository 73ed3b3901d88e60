"""Runs of a model over the parts of conversations: rounds of calls, checks of what comes back, smaller parts for those that fail, results kept.

A request is a topic (or none) and a range of a chunk's messages. A round calls the model for all open requests at once, a batch a call, and checks every answer; valid ones are
results. One that fails is asked again up to `attempts` times, then its range is halved, up to `depth` times; only these go round again. The number of rounds is bounded by both, whatever the size. What a
call needs is gathered per request, whose size is that of a chunk.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.failures import NOT_SMALLER, answer_category, outcome, request_category
from ..functions.repetition import answer_repetition
from .consolidation import consolidated
from .exports import http_error
from .serialization import as_json
from .staging import kept
from .topics import accepted, detection_answer, discovery_answer
from .verdicts import aggregated, consistency, verdict_evidence

#: Calls for one request, and how often it may be halved.
ATTEMPTS, DEPTH = 2, 3


@dataclass(frozen=True)
class Reply:
    """What a model gives for a prompt: its text with why it stopped, or without a text a status and a body (no status: no answer in time)."""

    text: str | None
    finish: str | None = "stop"
    status: int | None = 200
    body: str | None = None


#: A model: replies to prompts, in their order. It runs on executors, so it must be picklable; it may hold what is made anew in each task.
Model = Callable[[list[str]], list[Reply]]


@dataclass(frozen=True)
class Run:
    """results: valid answers by request. leaves: the last outcome of every request that was not halved (category null: valid). attempts: every call with its category and seconds."""

    results: DataFrame
    leaves: DataFrame
    attempts: DataFrame

    def metrics(self, keys: list[str]) -> DataFrame:
        """Per key: calls, requests, repeated calls, halved requests, failures by leaf and by call, the most halvings, and seconds in all and on average."""
        calls = self.attempts.groupBy(*keys).agg(
            F.count("*").alias("n_calls"), F.count_if(F.col("attempt") > 1).alias("n_repeated"), F.count_if(F.col("category").isNotNull()).alias("n_failed_calls"), F.max(F.length("node")).alias("depth"),
            F.count_if(F.col("category") == "DEGENERATE_OUTPUT").alias("n_degenerate"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("average_seconds"),
        )
        halved = self.attempts.where(F.col("halved")).groupBy(*keys).agg(F.count("*").alias("n_halved"))
        leaves = self.leaves.groupBy(*keys).agg(F.count("*").alias("n_leaves"), F.count_if(F.col("category").isNotNull()).alias("n_failed_leaves"))
        return calls.join(halved, keys, "left").join(leaves, keys, "left").fillna(0, ["n_halved", "n_leaves", "n_failed_leaves"])

    def failures(self, keys: list[str]) -> DataFrame:
        """Per key and outcome the number of calls."""
        return self.attempts.groupBy(*keys, outcome(F.col("category")).alias("outcome")).agg(F.count("*").alias("n"))


def prompts(requests: DataFrame, sections: DataFrame, instruction: Column) -> DataFrame:
    """requests (document_id, chunk, low, high, more) with prompt and cited_ids: the instruction and the sections (document_id, chunk, n, evidence_id, text) of the range [low, high) as lines of JSON."""
    line = F.concat(F.lit('{"id": '), as_json(F.col("evidence_id")), F.lit(', "text": '), as_json(F.coalesce("text", F.lit(""))), F.lit("}"))
    lines = sections.select("document_id", "chunk", "n", "evidence_id", line.alias("line"))
    whole = requests.join(lines, ["document_id", "chunk"]).where((F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
    told = whole.groupBy(*requests.columns).agg(F.array_sort(F.collect_list(F.struct("n", "evidence_id", "line"))).alias("l"))
    text = F.concat(instruction, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return told.select(*requests.columns, text.alias("prompt"), F.transform("l", lambda x: x["evidence_id"]).alias("given_ids"))


def called(rows: DataFrame, model: Model, batch: int = 32) -> DataFrame:
    """rows (prompt, more) with the model's reply: text, finish, status, body, and the seconds of a call, shared by its batch."""
    names = rows.columns

    def run(batches):
        for table in batches:
            for s in range(0, table.num_rows, batch):
                part = table.slice(s, batch)
                began = time.perf_counter()
                replies = model(part.column("prompt").to_pylist())
                took = (time.perf_counter() - began) / max(part.num_rows, 1)
                if len(replies) != part.num_rows:
                    raise ValueError(f"the model gave {len(replies)} replies to {part.num_rows} prompts")
                told = [pa.array([getattr(r, f) for r in replies], t) for f, t in (("text", pa.string()), ("finish", pa.string()), ("status", pa.int32()), ("body", pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *told, pa.array([took] * part.num_rows)], names=[*names, "text", "finish", "status", "body", "seconds"])

    return rows.mapInArrow(run, f"{rows.schema.simpleString()[7:-1]}, text string, finish string, status int, body string, seconds double")


def run_requests(requests: DataFrame, sections: DataFrame, model: Model, instruction: Column, read: Callable[[Column], Column], cited: Callable[[Column], Column], attempts: int = ATTEMPTS, depth: int = DEPTH) -> Run:
    """Ask a model for all requests (document_id, chunk, topic_id, more, one row each) over the sections (document_id, chunk, n from 0, evidence_id, text) of their chunks.

    read gives {error, more} of an answer's text, cited the identifiers that such a struct cites. A request without sections has no prompt and no result.
    """
    sizes = sections.groupBy("document_id", "chunk").agg(F.count("*").alias("high"))
    own = requests.columns
    open_ = kept(requests.join(sizes, ["document_id", "chunk"]).select(*own, F.lit("").alias("node"), F.lit(0).cast("long").alias("low"), "high", F.lit(1).alias("attempt")))
    results, leaves, calls = [], [], []
    for _ in range(attempts * (depth + 1)):
        replies = called(prompts(open_, sections, instruction), model)
        told = replies.withColumns({"answer": read(F.col("text")), "loop": answer_repetition("text")["kind"].isNotNull()})
        unknown = F.coalesce(F.size(F.array_except(cited(F.col("answer")), F.col("given_ids"))) > 0, F.lit(False))
        failed = F.when(F.col("text").isNull(), request_category(F.col("status"), http_error(F.col("status"), F.col("body")))).otherwise(answer_category(F.col("answer.error"), F.col("loop"), unknown, F.col("finish")))
        told = kept(told.withColumn("category", failed).drop("prompt", "text", "body", "given_ids", "loop"))
        bad = F.col("category").isNotNull()
        again = bad & (F.col("attempt") < attempts) & F.col("status").isNotNull() & (F.col("status") == 200)
        smaller = bad & ~again & (F.col("high") - F.col("low") > 1) & (F.length("node") < depth) & ~F.col("category").isin(*NOT_SMALLER, "TIMEOUT")
        told = told.withColumns({"again": again, "halved": smaller})
        results.append(told.where(~bad))
        leaves.append(told.where(~(F.col("again") | F.col("halved"))).select(*own, "node", "low", "high", "category"))
        calls.append(told.select(*own, "node", "attempt", "category", "halved", "seconds"))
        mid = F.expr("low + (high - low) div 2")
        halves = F.array(F.struct(F.lit("a").alias("h"), F.col("low").alias("l"), mid.alias("r")), F.struct(F.lit("b").alias("h"), mid.alias("l"), F.col("high").alias("r")))
        two = told.where("halved").withColumn("x", F.explode(halves)).select(*own, F.concat("node", "x.h").alias("node"), F.col("x.l").alias("low"), F.col("x.r").alias("high"), F.lit(1).alias("attempt"))
        open_ = kept(told.where("again").select(*own, "node", "low", "high", (F.col("attempt") + 1).alias("attempt")).unionByName(two))
        if not open_.head(1):
            break
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Run(union(results).select(*own, "node", "low", "high", "answer"), union(leaves), union(calls))


def detection_run(sections: DataFrame, topics: DataFrame, model: Model, instruction: Column | None = None, store=None, **limits) -> tuple[DataFrame, DataFrame, Run | None]:
    """(verdicts, evidence, run) of topics (topic_id, label, description) over the chunks of documents: every chunk is asked for every topic, or for those of its document where topics have a document_id.

    verdicts: document_id, topic_id, n_parts, n_failed, decision; evidence: what they rest on. With a store (sources.store.KeyedStore by document_id, topic_id, chunk) the chunks that it has are not asked
    again, and chunks without a failed part are added to it; its rows and those of this run make up the verdicts. run is None where nothing was left to do.
    """
    chunks = sections.select("document_id", "chunk").distinct()
    if "document_id" in topics.columns:
        plan = chunks.join(topics.select("document_id", "topic_id", "label", "description"), "document_id")
    else:  # a few topics asked for everywhere: the plan itself is every chunk with every topic
        plan = chunks.crossJoin(F.broadcast(topics.select("topic_id", "label", "description")))
    requests = store.missing(plan) if store is not None else plan
    ask = instruction if instruction is not None else F.concat_ws("\n", F.lit("TOPIC"), "label", "description")
    run = None
    parts = None
    if requests.head(1):
        run = run_requests(requests, sections, model, ask, detection_answer, lambda a: a["evidence_ids"], **limits)
        valid = run.results.select("document_id", "topic_id", "chunk", "node", "low", F.col("answer.decision").alias("decision"), F.col("answer.evidence_ids").alias("evidence_ids"))
        failed = run.leaves.where("category IS NOT NULL").select("document_id", "topic_id", "chunk", "node", "low", F.lit(None).cast("string").alias("decision"), F.array().cast("array<string>").alias("evidence_ids"))
        parts = kept(valid.unionByName(failed))
    if store is not None:
        if parts is not None:
            whole = parts.groupBy("document_id", "topic_id", "chunk").agg(F.bool_and(F.col("decision").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("low", "node", "decision", "evidence_ids"))).alias("parts"))
            store.write(whole.where("ok").drop("ok"))
            parts = parts.join(whole.where("NOT ok").select("document_id", "topic_id", "chunk"), ["document_id", "topic_id", "chunk"], "left_semi")
        there = store.read()
        if there is not None:
            mine = there.join(plan.select("document_id", "topic_id", "chunk"), ["document_id", "topic_id", "chunk"], "left_semi")
            old = mine.select("document_id", "topic_id", "chunk", F.explode("parts").alias("p")).select("document_id", "topic_id", "chunk", "p.node", "p.low", "p.decision", "p.evidence_ids")
            parts = old if parts is None else parts.unionByName(old)
    keys = ["document_id", "topic_id"]
    cited = parts.select(*keys, "decision", F.posexplode_outer("evidence_ids").alias("at", "evidence_id"), F.struct("chunk", "low", "node").alias("part"))
    order = cited.withColumn("seq", F.struct("part.chunk", "part.low", "at"))
    verdicts = aggregated(parts, keys)
    return verdicts, verdict_evidence(order, keys).where("evidence_id IS NOT NULL"), run


def discovery_run(sections: DataFrame, model: Model, instruction: Column | None = None, max_topics: int = 10, **limits) -> tuple[DataFrame, Run]:
    """(topics, run): what a model finds in every chunk, reduced to topics worth keeping and brought together per document (consolidation.consolidated)."""
    requests = sections.select("document_id", "chunk").distinct().withColumn("topic_id", F.lit("discovery"))
    ask = instruction if instruction is not None else F.lit("TOPICS")
    cited = lambda a: F.flatten(F.transform(a["topics"], lambda t: t["evidence_ids"]))
    run = run_requests(requests, sections, model, ask, lambda text: discovery_answer(text, max_topics), cited, **limits)
    found = run.results.select("document_id", "chunk", "low", F.posexplode("answer.topics").alias("at", "t")).select(
        "document_id", "chunk", (F.col("low") * 1000 + F.col("at")).alias("topic_no"), "t.label", "t.description", "t.evidence_ids"
    )
    told = sections.withColumn("source_type", F.lit("ORIGINAL_TEXT") if "source_type" not in sections.columns else F.col("source_type"))
    own = found.withColumn("topic_no", F.concat_ws("|", F.col("chunk").cast("string"), F.lpad(F.col("topic_no").cast("string"), 12, "0")))
    kept_topics = accepted(own, told.select("evidence_id", "source_type", "text"))
    return consolidated(kept_topics, max_topics), run


def verification_run(sections: DataFrame, discovered: DataFrame, model: Model, **limits) -> tuple[DataFrame, Run | None]:
    """(verified, run): discovered topics (document_id, topic_id, label, description, evidence_ids) asked for again in their documents by label and description alone, without their evidence.

    verified: discovered with decision, detected_ids (in order), n_overlap, jaccard and status (verdicts.consistency)."""
    verdicts, evidence, run = detection_run(sections, discovered.drop("evidence_ids"), model, **limits)
    keys = ["document_id", "topic_id"]
    cited = evidence.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "evidence_id"))).alias("_e")).select(*keys, F.transform("_e", lambda x: x["evidence_id"]).alias("detected_ids"))
    rows = discovered.join(verdicts.select(*keys, "decision", "n_failed"), keys).join(cited, keys, "left").withColumn("detected_ids", F.coalesce("detected_ids", F.array().cast("array<string>")))
    return consistency(rows, "evidence_ids", "detected_ids", "decision"), run


def authenticated(presented: DataFrame, stored_topics: DataFrame, max_topics: int = 10) -> bool:
    """Whether a presented discovery (columns of consolidation.consolidated) is what the stored topics of its chunks (document_id, chunk, topic_no, label, description, evidence_ids) give."""
    again = consolidated(stored_topics, max_topics).select(*presented.columns)
    return not presented.exceptAll(again).head(1) and not again.exceptAll(presented).head(1)
