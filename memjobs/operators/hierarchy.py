"""Memory hierarchy: exchanges (qa) in segments in experiences, and what is derived from it.

Ids are deterministic: conversation and ordinal. ``conv_id`` is part of every key. In exact-topic mode an experience is
a distinct topic of a conversation; segments follow the cut rule. Within a conversation the rule is sequential, so rows
are sorted in their partitions and streamed through it: memory stays constant however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as X

CUT_SIMILARITY = 0.8
MIN_SEGMENT_QAS = 2
SUMMARY_EVERY = 5
_TOKEN = re.compile(r"[一-鿿]|[a-zA-Z0-9_]+")


def with_defaults(records: DataFrame) -> DataFrame:
    """Records with the required fields; entities default to the core entity, confidence to 0."""
    given = F.filter(F.transform("entities", lambda e: F.trim(e)), lambda e: e != "")
    rows = records.where(~X.blank(F.col("topic")) & ~X.blank(F.col("core_entity")) & ~X.blank(F.col("intent")))
    return rows.withColumns(
        {
            "entities": F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.array("core_entity")),
            "confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
        }
    )


def sequenced(records: DataFrame) -> DataFrame:
    """Records with ``seq``, their place in the conversation from 1."""
    w = Window.partitionBy("conv_id").orderBy("turn_ord", "rec_ord")
    return records.withColumn("seq", F.row_number().over(w))


def bag_cosine(a: str, b: str) -> float:
    """The plain-Python twin of ``functions.text.bag_cosine``, for the sequential rule."""
    x, y = ([w.lower() for w in _TOKEN.findall(t or "")] for t in (a, b))
    if not x or not y:
        return 0.0
    dot = sum(x.count(w) * y.count(w) for w in set(x))
    return dot / (sqrt(sum(x.count(w) ** 2 for w in set(x))) * sqrt(sum(y.count(w) ** 2 for w in set(y))))


def cuts(intent: str, first_intent: str, size: int, least: int = MIN_SEGMENT_QAS) -> bool:
    """Does this intent end the segment? Only if it differs enough from the segment's first and the segment is long enough."""
    return size >= least and intent != first_intent and bag_cosine(intent, first_intent) < CUT_SIMILARITY


def segment_numbers(rows: DataFrame, keys: list[str], order: list[str], least: int = MIN_SEGMENT_QAS) -> DataFrame:
    """``rows`` with ``seg_no``, counted within ``keys`` by the cut rule over ``intent``. One shuffle on the keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, first, size, number = None, "", 0, 0
        for frame in frames:
            out = []
            for values in zip(*(frame[k] for k in keys), frame["intent"], strict=True):
                key, intent = values[:-1], values[-1]
                if key != group:
                    group, first, size, number = key, intent, 0, 1
                elif cuts(intent, first, size, least):
                    first, size, number = intent, 0, number + 1
                size += 1
                out.append(number)
            yield frame.assign(seg_no=pd.Series(out, index=frame.index, dtype="int32"))

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", seg_no int")


def exact_topic_memory(records: DataFrame) -> DataFrame:
    """qa rows with ``qa_id``, ``segment_id`` and ``experience_id``; an experience is a topic of a conversation."""
    rows = sequenced(records)
    numbers = (
        rows.groupBy("conv_id", "topic").agg(F.min("seq").alias("first_seq")).withColumn("exp_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_seq")))
    )
    rows = rows.join(numbers.drop("first_seq"), ["conv_id", "topic"])
    rows = segment_numbers(rows, ["conv_id", "exp_no"], ["seq"])
    return rows.select(
        "*", F.concat_ws("_", F.lit("qa"), "conv_id", "seq").alias("qa_id"), F.concat_ws("_", F.lit("seg"), "conv_id", "exp_no", "seg_no").alias("segment_id"),
        F.concat_ws("_", F.lit("exp"), "conv_id", "exp_no").alias("experience_id"), F.lit("active").alias("status"),
    )


def topic_runs(records: DataFrame) -> DataFrame:
    """Records with ``run_no``: a new run begins where the topic differs from the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn_ord", "rec_ord")
    changed = F.when(F.col("topic") == F.lag("topic").over(w), 0).otherwise(1)
    return records.withColumn("changed", changed).withColumn("run_no", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("changed")


def in_order(order: str, value: str):
    """Aggregate: the values as an array in the order of another column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])


def segments_of(qa: DataFrame) -> DataFrame:
    """One row for each segment. Child lists are ordered; the first exchange gives topic, entity and intent."""
    return qa.groupBy("conv_id", "experience_id", "segment_id").agg(
        F.min_by("topic", "seq").alias("topic"), F.min_by("core_entity", "seq").alias("core_entity"), F.min_by("intent", "seq").alias("intent"),
        in_order("seq", "qa_id").alias("qa_ids"), F.count("*").alias("n_qas"), F.min("seq").alias("created_at"), F.max("seq").alias("updated_at"), F.lit("active").alias("status"),
    )


def experiences_of(qa: DataFrame) -> DataFrame:
    """One row for each experience: children and intents in the order first seen, state of the last touched segment."""
    return qa.groupBy("conv_id", "experience_id").agg(
        F.min_by("topic", "seq").alias("topic"), F.min_by("core_entity", "seq").alias("core_entity"),
        F.array_distinct(in_order("seq", "intent")).alias("intents_link"), F.array_distinct(in_order("seq", "segment_id")).alias("segment_ids"),
        F.struct(F.lit("active").alias("status"), F.max_by("segment_id", "seq").alias("current_segment_id")).alias("state"),
        F.count("*").alias("n_qas"), F.min("seq").alias("created_at"), F.max("seq").alias("updated_at"),
    )


def latest(rows: DataFrame, keys: list[str], id_col: str, n: int = 1) -> DataFrame:
    """The ``n`` most recently updated rows of each key; ties by creation, then by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("created_at"), id_col)
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def entity_ranks(qa: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent entities of each segment; ties go to the earlier one."""
    each = qa.select("conv_id", "segment_id", "seq", F.posexplode("entities").alias("at", "entity"))
    counts = each.groupBy("conv_id", "segment_id", "entity").agg(F.count("*").alias("n"), F.min(F.struct("seq", "at")).alias("first"))
    w = Window.partitionBy("conv_id", "segment_id").orderBy(F.desc("n"), "first", "entity")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def segment_summaries(qa: DataFrame, none: str = "none") -> DataFrame:
    """A template summary of each segment: number of exchanges and most frequent entities."""
    named = entity_ranks(qa).groupBy("conv_id", "segment_id").agg(F.array_join(in_order("rank", "entity"), ", ").alias("names"))
    sizes = qa.groupBy("conv_id", "experience_id", "segment_id").agg(F.count("*").alias("n_qas"), F.min_by("intent", "seq").alias("intent"), F.max("seq").alias("last_seq"))
    summary = F.format_string("%d exchanges on %s; entities: %s", "n_qas", "intent", F.coalesce("names", F.lit(none)))
    return sizes.join(named, ["conv_id", "segment_id"], "left").withColumn("summary", summary).drop("names")


def experience_summaries(qa: DataFrame) -> DataFrame:
    """A template summary of each experience, with that of its last segment in list order."""
    segments = segment_summaries(qa).join(qa.groupBy("conv_id", "segment_id").agg(F.min("seq").alias("place")), ["conv_id", "segment_id"])
    heads = experiences_of(qa)
    last = segments.groupBy("conv_id", "experience_id").agg(F.max_by("summary", "place").alias("last_summary"), F.count("*").alias("n_segments"))
    text = F.format_string("%d segments; intents: %s", "n_segments", F.array_join("intents_link", ", "))
    return heads.join(last, ["conv_id", "experience_id"]).select(
        "conv_id", "experience_id", F.when(F.col("last_summary") != "", F.concat(text, F.lit("; last: "), "last_summary")).otherwise(text).alias("summary")
    )


def summary_inputs(qa: DataFrame, last: int = 20, user_chars: int = 1200, assistant_chars: int = 1200) -> DataFrame:
    """Prompt input of each segment: its last exchanges as JSON, fields cut to their limits."""
    w = Window.partitionBy("conv_id", "segment_id").orderBy(F.desc("seq"))
    recent = qa.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    item = F.struct("seq", F.substring("user_input", 1, user_chars).alias("user"), F.substring("assistant_output", 1, assistant_chars).alias("assistant"))
    return recent.groupBy("conv_id", "segment_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"), F.count("*").alias("n_items"))


def summaries_due(qa: DataFrame, every: int = SUMMARY_EVERY) -> DataFrame:
    """After which exchange each segment's summary is due: every ``every`` exchanges since the last one."""
    w = Window.partitionBy("conv_id", "segment_id").orderBy("seq")
    n = F.row_number().over(w)
    return qa.withColumn("nth", n).select("conv_id", "segment_id", "seq", "nth", (F.col("nth") % every == 0).alias("due"), F.floor(F.col("nth") / every).cast("int").alias("version"))


def rolling_context(turns: DataFrame, size: int = 5) -> DataFrame:
    """Of each turn that isn't blank, the ``size`` turns before it as JSON lines."""
    w = Window.partitionBy("conv_id").orderBy("session_num", "turn_ord").rowsBetween(-size, -1)
    line = F.to_json(F.struct("speaker", "text"))
    return turns.where(~X.blank(F.col("text"))).withColumn("context", F.array_join(F.collect_list(line).over(w), "\n"))


def audit(turns: DataFrame, qa: DataFrame) -> DataFrame:
    """Of each conversation: expected, stored and missing turn ids, and whether its memory may be reused."""
    expected = turns.where(~X.blank(F.col("text"))).select("conv_id", "dia_id").distinct()
    stored = qa.select("conv_id", "dia_id").distinct().withColumn("found", F.lit(1))
    both = expected.join(stored, ["conv_id", "dia_id"], "left").groupBy("conv_id").agg(F.count("*").alias("n_expected"), F.count("found").alias("n_found"))
    sizes = qa.groupBy("conv_id").agg(F.count("*").alias("n_qas"))
    return both.join(sizes, "conv_id", "left").select(
        "conv_id", "n_expected", (F.col("n_expected") - F.col("n_found")).alias("n_missing"), (F.coalesce("n_qas", F.lit(0)) > 0).alias("reusable")
    )


def merged_state(old: DataFrame, new: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Last write wins for each key and column; a null in a later row keeps the earlier value."""
    rows = old.unionByName(new)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*last, F.max(order).alias(order))


def hierarchy_statistics(qa: DataFrame) -> DataFrame:
    """Counts of each layer, mean children and layers with a single child; one row."""
    segments = qa.groupBy("conv_id", "experience_id", "segment_id").agg(F.count("*").alias("n"))
    experiences = segments.groupBy("conv_id", "experience_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return experiences.agg(
        F.count("*").alias("experiences"), F.sum("k").alias("segments"), F.sum("n").alias("qas"), F.round(F.avg("k"), 6).alias("segments_per_experience"),
        F.round(F.sum("n") / F.sum("k"), 6).alias("qas_per_segment"), F.sum((F.col("k") == 1).cast("long")).alias("single_segment"),
    )
