"""Ordered operators over conversations: aliases, greedy chunks, coverage, fingerprints, unified messages."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import CHARS_PER_TOKEN, has_text

#: Operational limits of a chunk: characters, messages and estimated tokens; and tokens of framing a message.
MAX_CHARS, MAX_MESSAGES, MAX_TOKENS, FRAMING = 18_000, 100, 4_200, 85
#: Limits of a microchunk: messages with substance, and tokens.
MICRO_MESSAGES, MICRO_TOKENS, SECTION_TOKENS = 8, 1_500, 20


def unified_messages(turns: DataFrame, source: str = "conversations") -> DataFrame:
    """Messages with stable identifiers and their place in the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return turns.select(
        "conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("seq"),
        F.concat(F.lit(f"unified:{source}:"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"),
        F.concat(F.lit(f"chat:{source}:"), F.col("conv_id").cast("string")).alias("chat_id"),
        F.when(F.col("role") == "user", F.lit("participant:local_user:LOCAL_USER")).otherwise(F.concat(F.lit("participant:alias:"), F.col("role"))).alias("participant_id"),
    )


def with_aliases(messages: DataFrame) -> DataFrame:
    """E001, E002 … for the messages with text of each conversation, in order; never cut short from E1000 on."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    n = F.row_number().over(order)
    return messages.where(has_text(F.col("text"))).withColumn("alias", F.concat(F.lit("E"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def conversation_list(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(has_text(F.col("text"))).alias("n_sections"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")
    )


def fingerprints(messages: DataFrame) -> DataFrame:
    """A digest of each conversation's content in order. A conversation streams past its task, which holds a digest and a batch of rows, not the conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")).alias("_place")
    rows = messages.select("conv_id", "seq", F.concat_ws("\x1f", "message_id", "role", F.coalesce("text", F.lit(""))).alias("c")).select("*", place).select("conv_id", "_place", "c")

    def run(batches):
        conversation, digest = None, None
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for name, place, text in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                if place == 1:
                    if digest:
                        done.append((conversation, digest.hexdigest()))
                    conversation, digest = name, hashlib.sha256()
                else:
                    digest.update(b"\x1e")
                digest.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "fingerprint"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conversation], kind), pa.array([digest.hexdigest()])], ["conv_id", "fingerprint"])

    return rows.mapInArrow(run, StructType([rows.schema["conv_id"], StructField("fingerprint", StringType())]))


def _dealt(messages: DataFrame, sizes: dict[str, tuple[Column, int]]) -> DataFrame:
    """(conv_id, seq, chunk): a chunk is closed before a message with which any of its sums would exceed its limit, so a single message may.

    Only numbers are shuffled, and nothing where messages are staged by conversation (staging.stage). A conversation streams past its task in the order of its rows' numbers: the task
    holds a batch of rows and the sums of one chunk.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")).alias("_place")  # deals and sorts, unless that is done
    rows = messages.select("conv_id", "seq", *[size.cast("long").alias(f"_{name}") for name, (size, _) in sizes.items()]).select("*", place)
    limits = [most for _, most in sizes.values()]

    def run(batches):
        conversation, chunk, sums = None, 0, None
        for batch in batches:
            names, out = batch.column("conv_id").to_pylist(), []
            for name, *more in zip(names, *(batch.column(n).to_pylist() for n in range(2, batch.num_columns - 1)), strict=True):
                if sums is None or name != conversation:
                    conversation, chunk, sums = name, 0, more
                else:
                    after = [x + y for x, y in zip(sums, more, strict=True)]
                    full = any(x > most for x, most in zip(after, limits, strict=True))
                    chunk, sums = chunk + full, more if full else after
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), pa.array(out, pa.int64())], ["conv_id", "seq", "chunk"])

    schema = StructType([rows.schema["conv_id"], rows.schema["seq"], StructField("chunk", LongType())])
    return rows.mapInArrow(run, schema)


def chunks(messages: DataFrame, max_chars: int = MAX_CHARS, max_messages: int = MAX_MESSAGES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(conv_id, seq, chunk) by characters, messages and estimated tokens with their framing; null texts are empty."""
    chars = F.length(F.coalesce("text", F.lit("")))
    return _dealt(messages, {"chars": (chars, max_chars), "messages": (F.lit(1), max_messages), "tokens": (F.ceil(chars / CHARS_PER_TOKEN) + FRAMING, max_tokens)})


def microchunks(messages: DataFrame, max_messages: int = MICRO_MESSAGES, max_tokens: int = MICRO_TOKENS) -> DataFrame:
    """Like chunks, by messages with substance and tokens; messages without substance never reach the first limit."""
    text = F.coalesce("text", F.lit(""))
    return _dealt(messages, {"substance": (has_text(text), max_messages), "tokens": (F.ceil(F.length(text) / CHARS_PER_TOKEN) + SECTION_TOKENS, max_tokens)})


def coverage_errors(messages: DataFrame, chunked: DataFrame) -> DataFrame:
    """Messages that are in no chunk or in several; must be empty."""
    seen = chunked.groupBy("conv_id", "seq").agg(F.count("*").alias("n"))
    return messages.select("conv_id", "seq").join(seen, ["conv_id", "seq"], "full_outer").where("n is null or n <> 1")
