"""Resumable generation: a stream of prompts answered once each, the sink being the only state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import chat
from quillspark.sources import readers, sinks


def answer(prompts: DataFrame, teacher: Callable[[Column], Column] = chat.stub_completion, model: str = "stub", cap: int = 16_384) -> DataFrame:
    """(id, category, conversations, reasoning, gen_model, finish_reason) for prompts with a user turn; truncated and
    empty answers are dropped, so that a later run tries them again. teacher maps the last user text to an answer."""
    c = chat.seed_messages(F.col("conversations"))
    rows = prompts.withColumn("c", c).filter("c IS NOT NULL")
    text = teacher(F.get("c", chat.last_index(F.col("c"), "user") - 1)["content"])
    rows = rows.withColumn("a", text)
    reason = F.when(F.length("a") >= cap, "length").otherwise("stop")
    out = rows.select("id", "category", F.concat("c", F.array(chat.message("assistant", F.col("a")))).alias("conversations"), "reasoning", F.lit(model).alias("gen_model"), reason.alias("finish_reason"))
    return out.filter((F.col("finish_reason") != "length") & (F.trim(F.get("conversations", F.size("conversations") - 1)["content"]) != ""))


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, per_trigger: int = 1000, teacher: Callable[[Column], Column] = chat.stub_completion) -> StreamingQuery:
    """Answers all prompts of a JSONL folder that the sink doesn't hold, batch by batch, then stops.

    At least once by the stream's checkpoint, once per id by the sink's ledger; rows without an id are always answered. The
    stream's batch number names the sink's batch, so one repeated after a failure appends nothing new, rows without an id too.
    """
    schema = f"id STRING, category STRING, conversations {readers.CONVERSATION}, reasoning STRING"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(source)

    def write(batch: DataFrame, number: int) -> None:
        sinks.append_new(answer(batch, teacher), sink, batch=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First row of each key within the watermark's delay; state older than it is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def spread(rows: DataFrame, endpoints: list[str]) -> DataFrame:
    """rows with endpoint: partitions take turns at the endpoints, so a worker keeps to one of them."""
    place = F.pmod(F.spark_partition_id(), F.lit(len(endpoints))) + 1
    return rows.withColumn("endpoint", F.element_at(F.array(*map(F.lit, endpoints)), place.cast("int")))


def generate_until(prompts: DataFrame, teacher: Callable[[list[str], list[bool]], list[str]], prompt: str = "prompt") -> DataFrame:
    """prompts with answer: teacher(prompts, whether each takes the reasoning route) in Arrow batches, reasoning stripped from what it
    returns. Null prompts give null."""
    from quillspark.functions import text

    @F.pandas_udf("string")
    def ask(p: pd.Series, think: pd.Series) -> pd.Series:
        out, on = pd.Series([None] * len(p), dtype=object), p.notna().to_numpy()
        out[on] = teacher(p[on].tolist(), think[on].fillna(False).astype(bool).tolist()) if on.any() else []
        return out

    return prompts.withColumn("answer", text.strip_think_eval(ask(F.col(prompt), text.evaluation_route(F.col(prompt)))))
