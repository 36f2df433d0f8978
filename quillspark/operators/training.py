"""Conversations to training rows: sanitised, rendered, tokenised and masked in one projection, and the calibration set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import runtime
from quillspark.functions import chat, text
from quillspark.operators import select, tokens

CALIB_TOKENS = 12_288
#: Rows per bucket of the two mixes, at a total of 1024.
MIXES = {"eval": {"science": 384, "general": 384, "math": 128, "code": 128}, "balanced": {"science": 256, "general": 256, "math": 256, "code": 256}}


def prompt_length(c: Column) -> Column:
    """Tokens of a conversation rendered with the generation prompt; null where the template refuses it."""
    out = chat.render_chatml(c, generation_prompt=True)
    return F.when(out.isNotNull(), F.size(text.words(out)))


def encode(df: DataFrame, rendered: str, header: str, stop: str, vocabulary: int, inside: bool = True, touching: bool = True, last_only: bool = False) -> DataFrame:
    """df with input_ids and loss_mask of a column of rendered texts, with the plain tokenizer: the mask is 1 in the spans from behind
    each header to stop. Each step is a projection of its own, so that no text is rendered or searched twice."""
    t = F.col(rendered)
    sp = text.spans(t, header, stop, inside)
    found = df.withColumns({"_sp": F.slice(sp, F.greatest(F.size(sp), F.lit(1)), F.lit(1)) if last_only else sp, "input_ids": F.transform(text.words(t), lambda w: text.word_id(w, vocabulary))})
    pick = lambda k: F.transform("_sp", lambda x: x[k])
    return found.select(*df.columns, "input_ids", word_mask(touching)(t, pick("a"), pick("b")).alias("loss_mask"))


def word_mask(touching: bool) -> Callable[..., Column]:
    """A function of (text, span begins, span ends): 1 for each word of the plain tokenizer that touches a span (one that begins at
    its end counts), or that lies in one whole, else 0. In Arrow batches: tests of each word against each span are interpreted in the JVM."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(texts, begins, ends):
            at = np.array([m.span() for m in text.WORD.finditer(t or "")], dtype=np.int64).reshape(-1, 2)
            on = np.zeros(len(at), dtype=bool)
            for x, y in zip(a, b):
                on |= (at[:, 1] > x) & (at[:, 0] <= y) if touching else (at[:, 0] >= x) & (at[:, 1] <= y)
            out.append(on.astype(np.int32))
        return pd.Series(out, dtype=object)

    return run


class Parser:
    """How a kind of model's conversations become training rows. Kinds differ in the rendering, and in where answers begin and end."""

    header, stop, inside, touching = "<|im_start|>assistant\n", text.escape_literal("<|im_end|>"), True, True

    def render(self, c: Column) -> Column:
        return chat.render_chatml(c)

    def encode(self, df: DataFrame, conversation: str, vocabulary: int, last_only: bool = False) -> DataFrame:
        """df with input_ids and loss_mask in place of the conversation; rows that the template refuses are left out."""
        rest = [c for c in df.columns if c != conversation]
        rows = df.select(*rest, self.render(F.col(conversation)).alias("_t")).filter(F.col("_t") != "")
        return encode(rows, "_t", self.header, self.stop, vocabulary, self.inside, self.touching, last_only).drop("_t")


class ToolParser(Parser):
    """Messages have tool calls as JSON text, which are sanitised and written out."""

    def render(self, c: Column) -> Column:
        return chat.render_chatml(F.transform(c, lambda m: chat.sanitize_message(m)), full=True)


class ThinkingParser(Parser):
    """Messages have reasoning_content beside tool calls; thinking is on, so what is trained on begins with the trace."""

    enable_thinking = True

    def render(self, c: Column) -> Column:
        return chat.render_chatml(F.transform(c, lambda m: chat.sanitize_message(m, thinking=True)), full=True, reasoning=True)


class HarmonyParser(Parser):
    """The channel format; a token counts only if it lies in the span whole, and a span ends before the next user."""

    header, stop, inside, touching = "<|start|>assistant", text.escape_literal("<|start|>user<|message|>"), False, False

    def render(self, c: Column) -> Column:
        return chat.render_harmony(c)


PARSERS: dict[str, Parser] = {"chatml": Parser(), "tools": ToolParser(), "thinking": ThinkingParser(), "harmony": HarmonyParser()}


def preprocess(df: DataFrame, conversation: str, template: str, vocabulary: int, longest: int | None = None, keep: list[str] | None = None, last_only: bool = False) -> DataFrame:
    """keep columns, input_ids, loss_mask and attention_mask of each conversation that its template renders; empty ones are skipped.

    longest cuts rows (a feature), the last place of a cut mask being 0; source columns are dropped but for keep.
    """
    if template not in PARSERS:
        raise ValueError(f"unknown template {template!r}")
    rows = PARSERS[template].encode(df.filter(F.size(conversation) > 0).select(*(keep or []), conversation), conversation, vocabulary, last_only)
    ids, mask = F.col("input_ids"), F.col("loss_mask")
    if longest is not None:
        ids, mask = tokens.truncate_and_zero_last(ids, mask, longest)
    rows = rows.filter(F.size("input_ids") > 0).select(*(keep or []), ids.alias("input_ids"), mask.alias("loss_mask"))
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def build_dataset(df: DataFrame, conversation: str, id_col: str, template: str, vocabulary: int, longest: int | None = None, least_loss: int = 0, seed: str = "42") -> DataFrame:
    """(position, input_ids, loss_mask, attention_mask): preprocessed rows with enough to learn from, in a seeded order. The order
    is a position by hash, so nothing but the arrays of kept rows is shuffled."""
    rows = runtime.materialize(preprocess(df, conversation, template, vocabulary, longest, [id_col]), "encoded")
    if least_loss:
        rows = rows.filter(F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x) >= least_loss)
    h = F.concat(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), F.col(id_col).cast("string"))
    return select.global_position(rows.withColumn("_h", h), "_h").drop("_h", id_col)


def labelled(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Rows with labels, a copy of the ids."""
    return df.withColumn("labels", F.col(ids))


def calibration_candidates(rows: DataFrame, position: str, conversation: str, cap: int = CALIB_TOKENS, scan: int | None = None) -> DataFrame:
    """(position, bucket, n_tokens, n_assistant_tokens, user_md5, flattened, kept): parsed rows of a corpus. Reasoning is flattened
    into the answer, the bucket told from user and answer, lengths counted on the rendered conversation; kept is true for rows
    up to cap tokens. scan takes the first rows of the order only (a feature). Written once, as a filter on a length would have it
    rendered and counted again."""
    o = select.head(rows.select(position, conversation), [position], scan)
    o = o.select(position, chat.last_turns(chat.normal_roles(F.col(conversation))).alias("o")).filter("o IS NOT NULL")
    raw = F.col("o.assistant")
    o = o.select(position, text.strip(F.col("o.system")).alias("system"), text.strip(F.col("o.user")).alias("user"), text.flatten_think(raw).alias("assistant"), (raw.contains("<think>") | raw.contains("</think>")).alias("flattened"))
    turn = lambda r: chat.message(r, F.col(r))
    full = F.size(text.words(chat.render_chatml(F.array(turn("system"), turn("user"), turn("assistant")))))
    head = F.size(text.words(chat.render_chatml(F.array(turn("system"), turn("user")), generation_prompt=True)))
    got = o.select(position, text.classify_bucket(F.col("user"), F.col("assistant")).alias("bucket"), full.alias("n_tokens"), F.greatest(full - head, F.lit(0)).alias("n_assistant_tokens"), F.md5(text.collapse_space(F.col("user"))).alias("user_md5"), "flattened")
    return runtime.materialize(got.withColumn("kept", F.col("n_tokens") <= cap), "calibration")


def mix_targets(mix: str = "eval", total: int = 1024, floor: int = 128) -> dict[str, int]:
    """Rows per bucket of a mix, scaled to a total, floor at least."""
    base = MIXES[mix]
    return {k: max(floor, round(v * total / sum(base.values()))) for k, v in base.items()}


def calibration_set(candidates: DataFrame, position: str, targets: dict[str, int], over: float = 3.0, seed: str = "0") -> DataFrame:
    """(rank, bucket, position, n_tokens, n_assistant_tokens): of each bucket the target rows of lowest seeded hash among the first
    round(target * over) different users; the whole in an order by hash, so that any prefix keeps the proportions."""
    rows = candidates.filter("kept").groupBy("user_md5").agg(F.min(F.struct(position, "bucket", "n_tokens", "n_assistant_tokens")).alias("s")).select("s.*")
    spark = candidates.sparkSession
    t = spark.createDataFrame([(k, v, round(v * over)) for k, v in targets.items()], "bucket STRING, _want INT, _first INT")
    most = max(round(v * over) for v in targets.values())
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(position))).filter(F.col("_k") <= most)  # a group limit
    first = first.join(F.broadcast(t), "bucket").filter(F.col("_k") <= F.col("_first"))
    h = F.md5(F.concat(F.lit(seed + ":"), F.col(position).cast("string")))
    drawn = first.withColumn("_h", h).withColumn("_d", F.row_number().over(Window.partitionBy("bucket").orderBy("_h", position))).filter(F.col("_d") <= F.col("_want"))
    # the set itself is bounded by its targets
    return drawn.withColumn("rank", F.row_number().over(Window.orderBy("_h", position))).select("rank", "bucket", position, "n_tokens", "n_assistant_tokens")


def calibration_summary(candidates: DataFrame, chosen: DataFrame, targets: dict[str, int]) -> DataFrame:
    """One row per bucket: target, actual, shortfall, and the candidates' counts of it: parsed, flattened, too long."""
    t = candidates.sparkSession.createDataFrame(list(targets.items()), "bucket STRING, target INT")
    a = chosen.groupBy("bucket").agg(F.count(F.lit(1)).alias("actual"), F.max("n_tokens").alias("longest"))
    c = candidates.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_parsed"), F.count_if("flattened").alias("n_flattened"), F.count_if(~F.col("kept")).alias("n_dropped_len"))
    out = t.join(a, "bucket", "left").join(c, "bucket", "left").fillna(0, ["actual", "n_parsed", "n_flattened", "n_dropped_len"])
    return out.withColumn("shortfall", F.greatest(F.col("target") - F.col("actual"), F.lit(0)))


def latency_pool(docs: DataFrame, position: str, col: str, budgets: dict[str, int], n_docs: int) -> DataFrame:
    """(position, category, prompt): slices of the first words of the same documents, one for each budget, of the first n_docs in
    order that hold the largest budget."""
    longest = max(budgets.values())
    rows = select.head(docs.select(position, F.col(col).alias("t"), F.size(text.words(F.col(col))).alias("_n")).filter(F.col("_n") >= longest), [position], n_docs)
    cut = F.array(*(F.struct(F.lit(k).alias("category"), F.array_join(F.slice(text.words(F.col("t")), 1, n), " ").alias("prompt")) for k, n in budgets.items()))
    return rows.select(position, F.explode(cut).alias("v")).select(position, "v.category", "v.prompt")


def long_enough(tokens_: Column, prompt: Column, block: int) -> Column:
    """Whether a conversation leaves room for a block behind its prompt."""
    return (tokens_ > prompt + block + 1) & (tokens_ - block > prompt)


def in_vocabulary_range(token: Column, first: int, end: int) -> Column:
    return (token >= first) & (token < end)


def filler(word: str, n: Column) -> Column:
    """A word repeated n times, once at least."""
    return F.repeat(F.lit(word), F.greatest(F.lit(1), n).cast("int"))


def aux_layers(total: int) -> list[int]:
    """The three layers whose states a drafter takes beside the last."""
    return [1, total // 2 - 1, total - 4]


def decode_rates(df: DataFrame, by: list[str], tpot: str, n_tokens: str, latency: str) -> DataFrame:
    """Per group mean_tpot, throughput (its inverse) and tokens_per_second."""
    return df.groupBy(*by).agg(F.avg(tpot).alias("mean_tpot"), (1 / F.avg(tpot)).alias("throughput"), (F.sum(n_tokens) / F.greatest(F.sum(latency), F.lit(1e-6))).alias("tokens_per_second"))


def decode_speedup(df: DataFrame, by: list[str], kind: str, tpot: str, base: str, block: str) -> DataFrame:
    """Per group the ratio of the mean time per token of the baseline rows to that of the block rows; null without either."""
    m = lambda k: F.avg(F.when(F.col(kind) == k, F.col(tpot)))
    return df.groupBy(*by).agg((m(base) / F.nullif(m(block), F.lit(0.0))).alias("speedup"))
