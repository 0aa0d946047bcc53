"""Hooks for outside models, and the interface that memory methods share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as X
from memjobs.operators import baselines, hierarchy


def call_model(rows: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str]], fallback: str = "", retries: int = 1, batch: int = 64) -> DataFrame:
    """``rows`` with ``response`` and ``error``. Each distinct prompt is sent once; no row is lost.

    A batch that fails is tried again and then prompt by prompt; what still fails gets ``fallback`` and the error.
    """

    def tried(prompts: list[str]) -> tuple[list[str] | None, str]:
        error = ""
        for _ in range(retries + 1):
            try:
                out = list(model(prompts))
                if len(out) == len(prompts):
                    return out, ""
                error = f"{len(out)} responses for {len(prompts)} prompts"
            except Exception as e:  # noqa: BLE001  a model may raise anything
                error = str(e) or type(e).__name__
        return None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, found = frame["prompt"].tolist(), []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                out, _ = tried(part)
                if out is not None:
                    found += [(p, r, None) for p, r in zip(part, out, strict=True)]
                    continue
                for p in part:
                    out, error = tried([p])
                    found.append((p, out[0], None) if out else (p, fallback, error))
            yield pd.DataFrame(found, columns=["prompt", "response", "error"])

    sent = rows.select(F.col(prompt_col).alias("prompt")).where("prompt is not null").distinct()
    said = sent.mapInPandas(run, "prompt string, response string, error string")
    return rows.join(said, rows[prompt_col] == said["prompt"], "left").drop("prompt") if prompt_col != "prompt" else rows.join(said, "prompt", "left")


class MemoryMethod(Protocol):
    """A way to remember: builds from turns, answers questions with (query_id, retrieved_ids, context)."""

    name: str

    def build(self, turns: DataFrame) -> None: ...

    def retrieve(self, questions: DataFrame) -> DataFrame: ...


class FullContext:
    """Remembers whole conversations: every question gets all turns of its own."""

    name = "full_context"

    def build(self, turns: DataFrame) -> None:
        self.memory = baselines.full_context(turns)

    def retrieve(self, questions: DataFrame) -> DataFrame:
        found = questions.select("query_id", "conv_id").join(self.memory, "conv_id")
        return found.select("query_id", F.col("dia_ids").alias("retrieved_ids"), "context")


class FlatRetrieval:
    """Remembers turns by their vectors: a question gets the ``k`` nearest of its conversation."""

    name = "flat_retrieval"

    def __init__(self, k: int = 5):
        self.k = k

    def build(self, turns: DataFrame) -> None:
        self.turns = turns

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return baselines.flat_retrieval(self.turns, questions, self.k)


class RecentTurns:
    """Remembers the order of a conversation: a question that is asked at a turn gets that turn and those before it, ``n`` in all.

    Questions carry ``turn_ord``, the turn at which they are asked.
    """

    name = "recent_turns"

    def __init__(self, n: int = 5):
        self.n = n

    def build(self, turns: DataFrame) -> None:
        w = Window.partitionBy("conv_id").orderBy("session_num", "turn_ord").rowsBetween(1 - self.n, 0)
        line = X.turn_text(F.col("speaker"), F.col("text"))
        self.memory = turns.select("conv_id", "turn_ord", F.collect_list(F.struct("dia_id", line.alias("line"))).over(w).alias("r"))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        newest = questions.select("query_id", "conv_id", "turn_ord").join(self.memory, ["conv_id", "turn_ord"]).withColumn("r", F.reverse("r"))
        return newest.select("query_id", F.col("r.dia_id").alias("retrieved_ids"), F.array_join("r.line", "\n").alias("context"))


class NoteSearch:
    """Remembers turns as linked notes: a question gets the best of a blend of keywords and vectors."""

    name = "note_search"

    def __init__(self, k: int = 5):
        self.k = k

    def build(self, turns: DataFrame) -> None:
        self.turns = turns

    def retrieve(self, questions: DataFrame) -> DataFrame:
        found = baselines.note_search_of_turns(self.turns, questions, self.k)
        notes = self.turns.select(F.concat_ws("/", "conv_id", "dia_id").alias("id"), "dia_id", "text")
        ranked = F.array_sort(F.collect_list(F.struct("rank", "dia_id", "text")))
        rows = found.join(notes, "id").groupBy("query_id").agg(ranked.alias("r"))
        return rows.select("query_id", F.col("r.dia_id").alias("retrieved_ids"), F.array_join("r.text", "\n").alias("context"))


class Layers:
    """Remembers exchanges and, if asked for, the segments above them; only exchanges count as retrieved.

    ``extract`` makes topic records of turns.
    """

    def __init__(self, extract: Callable[[DataFrame], DataFrame], top_qa: int = 5, top_segment: int = 3, segments: bool = True):
        self.extract, self.top_qa, self.top_segment, self.segments = extract, top_qa, top_segment, segments
        self.name = "exchanges_and_segments" if segments else "exchanges"

    def build(self, turns: DataFrame) -> None:
        self.memory = hierarchy.exact_topic_memory(self.extract(turns))

    def retrieve(self, questions: DataFrame) -> DataFrame:
        found = baselines.layer_retrieval(self.memory, questions, self.top_qa, self.top_segment)
        return found.select("query_id", "retrieved_ids", F.col("context" if self.segments else "qa_context").alias("context"))


def compare(methods: list[MemoryMethod], turns: DataFrame, questions: DataFrame) -> DataFrame:
    """The retrievals of every method for the same questions, with ``method``."""
    out = None
    for m in methods:
        m.build(turns)
        found = m.retrieve(questions).select(F.lit(m.name).alias("method"), "query_id", "retrieved_ids", "context")
        out = found if out is None else out.union(found)
    return out
