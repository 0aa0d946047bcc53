"""Parsers for model responses and JSON columns. What can't be parsed becomes a default or a reason, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "struct<topic:string,core_entity:string,intent:string,entities:array<string>,confidence:string,reasoning:string>"
_NAMES = ("topic", "core_entity", "intent", "entities", "confidence", "reasoning")


def without_fence(text: Column) -> Column:
    """A response without the Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[a-zA-Z0-9_-]*\s*\n?|\n?\s*```$", ""))


def json_strings(text: Column) -> Column:
    """A JSON array of strings without blank ones; anything else is empty."""
    return F.coalesce(F.filter(F.from_json(text, "array<string>"), lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def json_state(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def summary_text(value: Column) -> Column:
    """A summary stored as text, or as an object with summary, long or short; broken JSON is empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    fields = F.from_json(text, "map<string,string>")
    chosen = F.coalesce(
        fields["summary"], F.when(F.trim(fields["long"]) != "", fields["long"]), F.when(F.trim(fields["short"]) != "", fields["short"]), F.lit("")
    )
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return (
        F.when(text.startswith("{"), F.trim(chosen))
        .when(text.startswith("["), F.lit(""))
        .when(text.startswith('"'), F.trim(F.coalesce(quoted, text)))
        .otherwise(text)
    )


def response_records(response: Column) -> Column:
    """The topic records of a response: an object, or an array of objects that isn't empty; null for others."""
    text = without_fence(response)
    many = F.from_json(text, f"array<{RECORD}>")
    raw = F.from_json(text, "array<string>")
    one = F.from_json(text, RECORD)
    is_objects = (F.size(raw) > 0) & F.forall(raw, lambda r: F.coalesce(F.ltrim(r).startswith("{"), F.lit(False)))
    return F.when(text.startswith("["), F.when(is_objects, many)).when(text.startswith("{"), F.when(one.isNotNull() & F.get_json_object(text, "$").isNotNull(), F.array(one)))


def record_error(record: Column) -> Column:
    """Why a topic record is invalid; null if it is valid. ``confidence`` is the JSON text of the number."""
    value = record["confidence"].try_cast("double")
    missing = [F.when(record[n].isNull(), F.lit(f"missing {n}")) for n in _NAMES]
    empty = [F.when(F.trim(record[n]) == "", F.lit(f"blank {n}")) for n in ("topic", "core_entity", "intent", "reasoning")]
    entities = F.filter(record["entities"], lambda e: F.trim(F.coalesce(e, F.lit(""))) != "")
    wrong = [
        F.when(F.size(entities) == 0, F.lit("no entities")),
        F.when(value.isNull() | record["confidence"].isin("true", "false"), F.lit("confidence is no number")),
        F.when((value < 0) | (value > 1), F.lit("confidence out of range")),
    ]
    return F.coalesce(*missing, *empty, *wrong)


def clean_record(record: Column) -> Column:
    """A valid record with its strings trimmed, blank entities removed and the confidence as a number."""
    entities = F.filter(F.transform(record["entities"], lambda e: F.trim(e)), lambda e: e != "")
    return F.struct(
        *(F.trim(record[n]).alias(n) for n in ("topic", "core_entity", "intent")),
        entities.alias("entities"), record["confidence"].try_cast("double").alias("confidence"), F.trim(record["reasoning"]).alias("reasoning"),
    )


def score(value: Column) -> Column:
    """A number between 0 and 1; what is no number is 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


FLAT = "struct<id:string,score:string,reason:string>"
QA = "struct<id:string,qa_id:string,score:string,reason:string>"
SEGMENT = f"struct<id:string,segment_id:string,score:string,reason:string,qas:array<{QA}>>"
EXPERIENCE = f"struct<id:string,experience_id:string,score:string,reason:string,segments:array<{SEGMENT}>>"


def _listed(text: Column, kind: str, field: str) -> Column:
    body = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, f"$.{field}"))
    return F.coalesce(F.from_json(body, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def reranked(response: Column) -> Column:
    """A flat rerank response as array of (id, score, reason); items without id are dropped."""
    items = _listed(without_fence(response), FLAT, "results")
    return F.transform(
        F.filter(items, lambda i: F.coalesce(i["id"], F.lit("")) != ""),
        lambda i: F.struct(i["id"].alias("id"), score(i["score"]).alias("score"), F.coalesce(i["reason"], F.lit("")).alias("reason")),
    )


def reranked_tree(response: Column) -> Column:
    """A hierarchical rerank response; an id is ``id`` or ``<level>_id``, items without one are dropped."""

    def level(items: Column, name: str, below) -> Column:
        def ident(i: Column) -> Column:
            return F.coalesce(F.nullif(i["id"], F.lit("")), F.nullif(i[name], F.lit("")))

        items = F.coalesce(items, F.array())
        return F.transform(
            F.filter(items, lambda i: ident(i).isNotNull()), lambda i: F.struct(ident(i).alias("id"), score(i["score"]).alias("score"), *below(i))
        )

    top = _listed(without_fence(response), EXPERIENCE, "experiences")
    return level(
        top, "experience_id",
        lambda e: [level(e["segments"], "segment_id", lambda s: [level(s["qas"], "qa_id", lambda q: []).alias("qas")]).alias("segments")],
    )


def summary_response(response: Column) -> Column:
    """Plain text, or the summary, result or content of an object."""
    text = without_fence(response)
    found = F.coalesce(*(F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit("")) for k in ("summary", "result", "content")))
    return F.when(text.startswith("{"), F.coalesce(found, text)).otherwise(text)


def judge_score(response: Column, strict: bool = False) -> Column:
    """1 for CORRECT, 0 for WRONG, else null. Unless ``strict``, CORRECT inside another word counts in plain text."""
    label = F.upper(F.trim(F.get_json_object(without_fence(response), "$.label")))
    text = F.upper(response)
    correct, wrong = (text.rlike(r"\bCORRECT\b"), text.rlike(r"\b(WRONG|INCORRECT)\b")) if strict else (text.contains("CORRECT"), text.contains("WRONG"))
    return F.when(label == "CORRECT", 1).when(label == "WRONG", 0).when(correct, 1).when(wrong, 0)
