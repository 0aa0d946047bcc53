"""Texts for embedding, prompts and contexts. All labels and templates are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the rendered fields; give another dict for another language.
LABELS = {
    "topic": "Topic", "core_entity": "Entity", "intent": "Intent", "entities": "Related", "question": "Question", "summary": "Summary",
    "state": "State", "segments": "Recent segments", "questions": "Recent questions", "user": "User", "assistant": "Assistant", "time": "Time",
    "experience_head": "== Long-term topics ==", "segment_head": "== Related segments ==", "qa_head": "== Original exchanges ==",
    "experience_none": "No long-term topic found.", "segment_none": "No segment found.", "qa_none": "No exchange found.",
}


def _line(name: str, value: Column, labels: dict[str, str]) -> Column:
    return F.concat(F.lit(f"{labels[name]}: "), F.coalesce(value, F.lit("")))


def experience_document(topic, core_entity, intents, summary, state, segment_summaries, labels=LABELS) -> Column:
    """Text of an experience: fields, then at most three segment summaries."""
    return F.concat_ws(
        "\n", _line("topic", topic, labels), _line("core_entity", core_entity, labels), _line("intent", F.array_join(intents, ", "), labels),
        _line("summary", summary, labels), _line("state", state, labels), _line("segments", F.array_join(F.slice(segment_summaries, 1, 3), " | "), labels),
    )


def segment_document(topic, core_entity, intent, summary, questions, labels=LABELS) -> Column:
    return F.concat_ws(
        "\n", _line("topic", topic, labels), _line("core_entity", core_entity, labels), _line("intent", intent, labels), _line("summary", summary, labels),
        _line("questions", F.array_join(F.slice(questions, 1, 3), " | "), labels),
    )


def qa_document(topic, core_entity, intent, entities, user_input, assistant_output, labels=LABELS, most: int = 500) -> Column:
    return F.concat_ws(
        "\n", _line("topic", topic, labels), _line("core_entity", core_entity, labels), _line("intent", intent, labels),
        _line("entities", F.array_join(entities, ", "), labels), _line("user", user_input, labels), _line("assistant", F.substring(assistant_output, 1, most), labels),
    )


def query_text(topic, core_entity, intent, entities, question, labels=LABELS) -> Column:
    return F.concat_ws(
        "\n", _line("topic", topic, labels), _line("core_entity", core_entity, labels), _line("intent", intent, labels),
        _line("entities", F.array_join(entities, ", "), labels), _line("question", question, labels),
    )


def keyword_query_text(topic, core_entity, intent, entities, question) -> Column:
    """The parts that aren't blank, one to a line."""
    parts = F.concat(F.array(topic, core_entity, intent), F.coalesce(entities, F.array()), F.array(question))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n")


def context_block(experiences: Column, segments: Column, qas: Column, labels=LABELS) -> Column:
    """Three headed sections with numbered items; an empty section says so."""

    def number(i: Column) -> Column:
        return (i + 1).cast("string")

    def section(head: str, items: Column, none: str, lines: Column) -> Column:
        return F.concat(F.array(F.lit(labels[head])), F.when(F.size(items) == 0, F.array(F.lit(labels[none]))).otherwise(lines))

    exp = F.transform(experiences, lambda e, i: F.concat(
        F.when(F.size(experiences) > 1, F.concat(number(i), F.lit(". "))).otherwise(""), _line("topic", e["topic"], labels), F.lit("\n"),
        _line("core_entity", e["core_entity"], labels), F.lit("\n"), _line("intent", F.array_join(e["intents"], ", "), labels), F.lit("\n"),
        _line("summary", e["summary"], labels), F.lit("\n")))
    seg = F.transform(segments, lambda s, i: F.concat(number(i), F.lit(". "), _line("intent", s["intent"], labels), F.lit("\n   "), _line("summary", s["summary"], labels), F.lit("\n")))
    qa = F.transform(qas, lambda q, i: F.concat(
        number(i), F.lit(". "), _line("time", q["ts_raw"], labels), F.lit("\n"), _line("user", q["user_input"], labels), F.lit("\n"), _line("assistant", q["assistant_output"], labels), F.lit("\n")))
    every = F.concat(
        section("experience_head", experiences, "experience_none", exp), section("segment_head", segments, "segment_none", seg), section("qa_head", qas, "qa_none", qa)
    )
    return F.regexp_replace(F.array_join(every, "\n"), r"\s+$", "")


def prompt(template: str, blank_context: str = "(nothing found)", **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced literally; a blank ``context`` becomes ``blank_context``."""
    out = F.lit(template)
    for name, value in values.items():
        value = F.coalesce(value.cast("string"), F.lit(""))
        if name == "context":
            value = F.when(F.trim(value) == "", F.lit(blank_context)).otherwise(value)
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
