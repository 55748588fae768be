"""Training examples: views of units, separation from test questions, tokens, masks and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators import terms as X

IGNORED = -100


def training_views(units: DataFrame, title: str) -> DataFrame:
    """unit_id, view, prompt, response: an example view, then two views by term or one continuation, then a blanked
    definition if it has a term."""
    book, chapter, page = F.lit(title), T.link_part("link", 1), T.link_part("link", 2)
    has = F.coalesce(F.col("key_term"), F.lit("")) != ""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    view = lambda n, when, prompt, response: F.when(when, F.struct(F.lit(n).alias("view"), prompt.alias("prompt"), response.alias("response")))
    term = X.longest_term(X.term_candidates("definition"))
    rows = units.withColumn("_term", term)
    views = F.array(
        view("example", F.lit(True), say('Which example follows this statement in "', book, '"?\n"', F.col("fact"), '"'), F.col("example")),
        view("fact", has, say("What does chapter ", chapter, ' of "', book, '" tell about ', F.col("key_term"), "?"), F.col("fact")),
        view("recite", has, say("Quote what \"", book, "\", chapter ", chapter, ", page ", page, ", has on ", F.col("key_term"), "."), F.concat_ws(" ", "definition", "fact", "example")),
        view("continue", ~has, say("How does this passage of \"", book, "\", chapter ", chapter, ', go on?\n"', F.col("definition"), '"'), F.concat_ws(" ", "fact", "example")),
        view("cloze", F.col("_term").isNotNull() & ~F.col("definition").contains(fixed.BLANK), T.question(book, chapter, T.cloze("definition", "_term")), F.col("_term")),
    )
    return rows.select(F.col("id").alias("unit_id"), F.explode(F.filter(views, lambda v: v.isNotNull())).alias("v")).select("unit_id", "v.view", "v.prompt", "v.response")


def without_leaks(views: DataFrame, questions: DataFrame) -> DataFrame:
    """Views whose passage and response are no test question's passage and answer."""
    pairs = questions.select(T.prompt_passage("question").alias("_p"), F.col("answer").alias("_a")).distinct()
    rows = views.withColumn("_passage", T.prompt_passage("prompt"))
    return rows.join(pairs, (F.col("_passage") == F.col("_p")) & (F.col("response") == F.col("_a")), "left_anti").drop("_passage")


def chat_prompt(user: Column, system: Column | None = None, style: str = "roles", default_system: str = "You are a helpful assistant.") -> Column:
    """One user turn, and an optional system text, through a chat template, ready for the answer."""
    return render_chat(F.array(*([F.struct(F.lit("system").alias("role"), system.alias("text"))] if system is not None else []), F.struct(F.lit("user").alias("role"), user.alias("text"))), style, default_system)


def render_chat(turns: Column, style: str = "roles", default_system: str = "You are a helpful assistant.") -> Column:
    """A conversation, array<struct<role,text>>, as one text. roles: marked turns, a default system turn if none begins.
    brackets: user turns in instruction brackets, a system text before the first of them."""
    first = F.get(turns, F.lit(0))["role"] == "system"
    if style == "roles":
        own = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")
        system = F.when(first, "").otherwise(f"<|im_start|>system\n{default_system}<|im_end|>\n")
        return F.concat(system, own, F.lit("<|im_start|>assistant\n"))
    lead = F.when(first, F.concat(F.get(turns, F.lit(0))["text"], F.lit("\n\n"))).otherwise("")
    rest = F.filter(turns, lambda t: t["role"] != "system")
    said = F.transform(
        rest,
        lambda t, i: F.when(t["role"] == "user", F.concat(F.lit("[INST] "), F.when(i == 0, lead).otherwise(""), t["text"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), t["text"], F.lit("</s>"))),
    )
    return F.concat(F.lit("<s>"), F.array_join(said, ""))


def conversations(turns: DataFrame, style: str = "roles") -> DataFrame:
    """conv_id and the rendered text of all its turns in order."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", render_chat(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))), style).alias("rendered"))


def qa_pairs(turns: DataFrame) -> DataFrame:
    """User turns that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.filter("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def mask_labels(examples: DataFrame, prompt_ids: str, answer_ids: str, max_length: int = 512) -> DataFrame:
    """input_ids, attention_mask and labels: prompt and answer ids, cut to max_length, prompt places ignored. Rows all of
    whose labels are ignored go."""
    rows = examples.withColumn("input_ids", F.slice(F.concat(prompt_ids, answer_ids), F.lit(1), F.lit(max_length)))
    n = F.least(F.size(prompt_ids), F.lit(max_length))
    rows = rows.withColumn("labels", F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice("input_ids", n + 1, F.size("input_ids") - n)))
    rows = rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return rows.filter(F.exists("labels", lambda x: x != IGNORED))


def pad_batches(rows: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """All rows of a batch as long as its longest: ids padded on the right, mask 0, labels ignored. A batch is what a training
    step takes, a bounded number of rows."""
    gap = F.max(F.size("input_ids")).over(Window.partitionBy(batch)) - F.size("input_ids")
    rows = rows.withColumn("_gap", gap)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_gap"))).alias(c)
    padded = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED}
    return rows.select(*[c for c in rows.columns if c not in (*padded, "_gap")], *[fill(c, v) for c, v in padded.items()])


def word_ids(c: T.ColumnLike) -> Column:
    """A stand-in for a tokenizer: a number below 50000 for each word."""
    c = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % 50_000).cast("int"))


def schedule(examples: Column, epochs: Column, batch: Column, accumulate: Column, warmup: Column, cap: bool = True) -> tuple[Column, Column]:
    """Optimiser steps in all, and warm-up steps: kept up to half of all steps, else a tenth."""
    per_epoch = F.greatest(F.lit(1), F.floor(F.ceil(examples / batch) / accumulate))
    total = F.ceil(per_epoch * epochs).cast("long")
    if not cap:
        return total, warmup
    return total, F.when(warmup <= F.floor(total / 2), warmup).otherwise(F.greatest(F.lit(1), F.floor(total / 10))).cast("long")
