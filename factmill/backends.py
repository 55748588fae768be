"""Where models plug in: answers and Y/N scores per batch. A deterministic stub stands in for a model."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from factmill import fixed


class Backend(Protocol):
    """A model as an executor sees it."""

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[tuple[str, int]]:
        """Text and number of new tokens of each answer."""

    def score(self, prompts: list[str]) -> list[float]:
        """Probability of yes of each prompt."""


class Stub:
    """Answers with the prompt's longest word, and scores by its hash."""

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[tuple[str, int]]:
        out = []
        for p in prompts:
            words = p.split()[:max_new_tokens]
            out.append((max(words, key=len, default=""), len(words)))
        return out

    def score(self, prompts: list[str]) -> list[float]:
        return [zlib.crc32(p.encode()) % 1000 / 999 for p in prompts]


def generate(questions: DataFrame, backend: Callable[[], Backend], batch_rows: int = 32, time_limit: float = fixed.TIME_LIMIT_S) -> DataFrame:
    """id, set, type, question, reference_answer, model_answer, timed_out, seconds and error of each question. backend() makes
    the model once per task; a batch that fails is an error of its rows and not of the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for frame in batches:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows].copy()
                limit = fixed.MAX_ANSWER_TOKENS.get(part["set"].iloc[0], 48)
                began = time.monotonic()
                try:
                    got, error = model.generate(list(part["question"]), limit), None
                except Exception as e:  # noqa: BLE001 - what a model raises is a result
                    got, error = [("", 0)] * len(part), f"{type(e).__name__}: {e}"
                took = (time.monotonic() - began) / len(part)
                yield part.assign(
                    model_answer=[t for t, _ in got], timed_out=[took >= time_limit and n < limit for _, n in got], seconds=took, error=error
                )

    columns = "id string, set string, type string, question string, reference_answer string"
    rows = questions.select("id", "set", "type", "question", "reference_answer")
    return rows.mapInPandas(run, columns + ", model_answer string, timed_out boolean, seconds double, error string")


def score(prompts: DataFrame, backend: Callable[[], Backend]) -> DataFrame:
    """id, criterion and p_yes of each prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for frame in batches:
            yield frame[["id", "criterion"]].assign(p_yes=model.score(list(frame["prompt"])))

    return prompts.select("id", "criterion", "prompt").mapInPandas(run, "id string, criterion string, p_yes double")


def check_family(evaluator: str, evaluated_family: str) -> None:
    """A judge must not be of the family that it judges."""
    if evaluated_family.lower() in evaluator.lower():
        raise ValueError(f"{evaluator} is of the evaluated family {evaluated_family}")
