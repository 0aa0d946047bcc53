"""Queries of the text, rendering and parsing functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memjobs.functions import parse, render
from memjobs.functions import text as X
from memjobs.plans.tables import RECORDS, TURNS, WORD, records, table, turns

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- SQL of the functions


def s_words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"


def s_answer(x: str) -> str:
    return s_words(f"regexp_replace(lower(coalesce({x}, '')), '[!-/:-@\\[-`{{-~]', '', 'g')")


def s_units(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), ' +'), lambda w: length(w) > 1)"
    forms = """[w, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) END,
        CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 2) END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN left(w, length(w) - 1) END,
        CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) END, CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN left(w, length(w) - 3) || 'e' END]"""
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_filter({forms}, lambda f: f IS NOT NULL))))"


def s_terms(x: str, *excluded: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in X.IGNORED_TERMS) + "]"
    out = f"list_filter({s_units(x)}, lambda u: NOT list_contains({stop}, u) AND length(u) BETWEEN 2 AND 32"
    for e in excluded:
        out += f" AND NOT list_contains({s_units(e)}, u)"
    return f"list_transform(list_slice(list_reverse_sort(list_transform({out}), lambda u: {{'n': length(u), 'u': u}})), 1, 12), lambda s: s.u)"


def s_overlap(q: str, c: str) -> str:
    return f"least(CAST(len(list_intersect({s_units(q)}, {s_units(c)})) AS DOUBLE) / greatest(1, least(len({s_units(q)}), 12)), 1.0)"


PAIRS = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations"


def pairs(spark, sf_dir):
    """Each turn with the one after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next_text"))


@query("b1_turn_text", f"SELECT conv_id, turn_ord, '[' || speaker || ']: ' || text AS turn_text FROM ({TURNS}) WHERE trim(text) <> '' AND dia_id IS NOT NULL")
def b1(spark, sf_dir):
    rows = turns(spark, sf_dir).where(~X.blank(F.col("text")) & F.col("dia_id").isNotNull())
    return rows.select("conv_id", "turn_ord", X.turn_text(F.col("speaker"), F.col("text")).alias("turn_text"))


@query("c1_answer_tokens", f"SELECT doc_id, len({s_answer('text')}) AS n_tokens, array_to_string({s_answer('text')}, ' ') AS normal FROM documents")
def c1(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.answer_tokens(t)).cast("long").alias("n_tokens"), X.answer_text(t).alias("normal"))


@query(
    "c2_memory_tokens",
    "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]|[a-zA-Z0-9_]+'), lambda w: lower(w)), ' ') AS tokens FROM documents",
)
def c2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.memory_tokens(F.col("text")), " ").alias("tokens"))


@query("c3_lexical_units", f"SELECT conv_id, turn, array_to_string(list_sort({s_units('text')}), ' ') AS units FROM conversations")
def c3(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(X.lexical_units(F.col("text"))), " ").alias("units"))


@query("c4_keyword_terms", f"SELECT conv_id, turn, array_to_string({s_terms('text', 'next_text')}, ' ') AS terms FROM ({PAIRS})")
def c4(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(X.keyword_terms(F.col("text"), F.col("next_text")), " ").alias("terms"))


@query("c5_lexical_overlap", f"SELECT conv_id, turn, round({s_overlap('text', 'next_text')}, 6) AS overlap FROM ({PAIRS})")
def c5(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(X.lexical_overlap(F.col("text"), F.col("next_text")), 6).alias("overlap"))


def s_memory(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '[\\x{{4e00}}-\\x{{9fff}}]|[a-zA-Z0-9_]+'), lambda w: lower(w))"


@query(
    "c6_bag_cosine",
    f"""WITH p AS ({PAIRS}), a AS (SELECT conv_id, turn, unnest({s_memory('text')}) AS w FROM p), b AS (SELECT conv_id, turn, unnest({s_memory('next_text')}) AS w FROM p),
    ca AS (SELECT conv_id, turn, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT conv_id, turn, w, count(*) AS n FROM b GROUP BY ALL),
    d AS (SELECT conv_id, turn, sum(ca.n * cb.n) AS dot FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL),
    na AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM ca GROUP BY ALL), nb AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM cb GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(dot / (na.l * nb.l), 0.0), 6) AS cosine FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN na USING (conv_id, turn) LEFT JOIN nb USING (conv_id, turn)""",
)
def c6(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(X.bag_cosine(F.col("text"), F.col("next_text")), 6).alias("cosine"))


@query("c7_token_counts", f"SELECT doc_id, len({s_words('text')}) AS words, CAST(ceil(strlen(coalesce(text, '')) / 3.0) AS BIGINT) AS budget FROM documents")
def c7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"), X.budget_tokens(F.col("text")).alias("budget"))


@query(
    "c8_compression_ratio",
    f"""WITH c AS (SELECT *, len({s_words('text')}) AS total, len({s_words('next_text')}) AS kept FROM ({PAIRS}))
    SELECT conv_id, turn, round(CASE WHEN kept <= 0 THEN CASE WHEN total > 0 THEN total ELSE 1 END ELSE greatest(total / kept, 1.0) END, 6) AS ratio,
           round(CASE WHEN kept > 0 THEN total / kept END, 6) AS bare_ratio FROM c""",
)
def c8(spark, sf_dir):
    total, kept = X.word_count(F.col("text")), X.word_count(F.col("next_text"))
    return pairs(spark, sf_dir).select(
        "conv_id", "turn", F.round(X.compression_ratio(total, kept), 6).alias("ratio"), F.round(X.compression_ratio(total, kept, floor=False), 6).alias("bare_ratio")
    )


@query(
    "c9_truncated",
    """WITH t AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0b]+|[ \\t\\n\\r\\f\\x0b]+$', '', 'g') AS x FROM documents)
    SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE regexp_replace(left(x, 240), '[ \\t\\n\\r\\f\\x0b]+$', '') || '...' END AS short FROM t""",
)
def c9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 240).alias("short"))


@query("c10_summary_sections", f"SELECT conv_id, turn, 'Facts：' || regexp_replace(coalesce(next_text, 'none'), '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Goal：' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS kept FROM ({PAIRS})")
def c10(spark, sf_dir):
    """Sections of summaries that are put together from turns."""
    made = F.concat(F.lit("Goal: "), "text", F.lit("\nFacts: "), F.coalesce("next_text", F.lit("none")), F.lit("\nNext: go on"))
    return pairs(spark, sf_dir).select("conv_id", "turn", X.kept_sections(made, ["Goal", "Facts", "Next"], ["Facts", "Goal"]).alias("kept"))


@query(
    "c11_embedding_text",
    f"""SELECT conv_id, turn_ord, 'Topic: ' || topic || chr(10) || 'Entity: ' || core_entity || chr(10) || 'Intent: ' || intent || chr(10) || 'Related: ' || array_to_string(entities, ', ')
    || chr(10) || 'User: ' || user_input || chr(10) || 'Assistant: ' || left(assistant_output, 500) AS qa_text,
    'Topic: ' || topic || chr(10) || 'Entity: ' || core_entity || chr(10) || 'Intent: ' || intent || chr(10) || 'Summary: s' || chr(10) || 'Recent questions: ' || array_to_string(list_slice(entities, 1, 3), ' | ') AS segment_text
    FROM ({RECORDS})""",
)
def c11(spark, sf_dir):
    c = F.col
    return records(spark, sf_dir).select(
        "conv_id", "turn_ord", render.qa_document(c("topic"), c("core_entity"), c("intent"), c("entities"), c("user_input"), c("assistant_output")).alias("qa_text"),
        render.segment_document(c("topic"), c("core_entity"), c("intent"), F.lit("s"), c("entities")).alias("segment_text"),
    )


@query(
    "c12_query_text",
    f"""SELECT conv_id, turn_ord, 'Topic: ' || topic || chr(10) || 'Entity: ' || core_entity || chr(10) || 'Intent: ' || intent || chr(10) || 'Related: ' || array_to_string(entities, ', ') || chr(10) || 'Question: ' || user_input AS full_text,
    array_to_string(list_filter(list_concat([topic, core_entity, intent], entities, [trim(user_input)]), lambda p: trim(p) <> ''), chr(10)) AS keyword_text FROM ({RECORDS})""",
)
def c12(spark, sf_dir):
    parts = [F.col(x) for x in ("topic", "core_entity", "intent", "entities", "user_input")]
    return records(spark, sf_dir).select("conv_id", "turn_ord", render.query_text(*parts).alias("full_text"), render.keyword_query_text(*parts).alias("keyword_text"))


@query(
    "c13_context_block",
    f"""SELECT conv_id, turn_ord, '== Long-term topics ==' || chr(10) || 'Topic: ' || topic || chr(10) || 'Entity: ' || core_entity || chr(10) || 'Intent: ' || intent || chr(10) || 'Summary: ' || topic || chr(10) || chr(10)
    || '== Related segments ==' || chr(10) || 'No segment found.' || chr(10) || '== Original exchanges ==' || chr(10) || '1. Time: ' || dia_id || chr(10) || 'User: ' || user_input || chr(10) || 'Assistant:' AS context FROM ({RECORDS})""",
)
def c13(spark, sf_dir):
    exp = F.array(F.struct("topic", "core_entity", F.array("intent").alias("intents"), F.col("topic").alias("summary")))
    none = F.array().cast("array<struct<intent:string,summary:string>>")
    qa = F.array(F.struct(F.col("dia_id").alias("ts_raw"), "user_input", "assistant_output"))
    return records(spark, sf_dir).select("conv_id", "turn_ord", render.context_block(exp, none, qa).alias("context"))


@query(
    "c14_prompts",
    """SELECT conv_id, turn, 'Context:' || chr(10) || CASE WHEN trim(coalesce(text, '')) = '' THEN '(nothing found)' ELSE text END || chr(10) || 'Question: ' || turn || chr(10) || 'Answer briefly.' AS answer_prompt FROM conversations""",
)
def c14(spark, sf_dir):
    template = "Context:\n{context}\nQuestion: {question}\nAnswer briefly."
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", render.prompt(template, context=F.col("text"), question=F.col("turn")).alias("answer_prompt"))


@query(
    "c15_rerank_parsed",
    f"""SELECT conv_id, turn_ord, '[{{"id":"' || dia_id || '","score":' || CAST(confidence AS VARCHAR) || ',"reason":""}}]' AS flat,
    '[{{"id":"' || topic || '","score":1.0,"segments":[{{"id":"' || intent || '","score":0.0,"qas":[{{"id":"' || dia_id || '","score":0.0}}]}}]}}]' AS tree FROM ({RECORDS})""",
)
def c15(spark, sf_dir):
    """Rerank responses, flat and as a tree, put together from topic records."""
    rows = records(spark, sf_dir)
    flat = F.to_json(F.struct(F.array(F.struct(F.col("dia_id").alias("id"), F.col("confidence").alias("score")), F.struct(F.lit("").alias("id"), F.lit(2.0).alias("score"))).alias("results")))
    tree = F.to_json(F.array(F.struct(F.col("topic").alias("experience_id"), F.lit("1.5").alias("score"), F.array(F.struct(F.col("intent").alias("segment_id"), F.array(F.struct(F.col("dia_id").alias("qa_id"))).alias("qas"))).alias("segments"))))
    return rows.select("conv_id", "turn_ord", F.to_json(parse.reranked(flat)).alias("flat"), F.to_json(parse.reranked_tree(F.concat(F.lit("```json\n"), tree, F.lit("\n```")))).alias("tree"))


@query("c16_summary_response", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) WHEN turn % 3 = 1 THEN 'r' || turn ELSE trim(role) END AS summary FROM conversations")
def c16(spark, sf_dir):
    turn = F.col("turn")
    response = F.when(turn % 3 == 0, F.col("text")).when(turn % 3 == 1, F.to_json(F.struct(F.concat(F.lit("r"), turn).alias("result")))).otherwise(
        F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit("").alias("summary"), F.col("role").alias("content"))), F.lit("\n```"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.summary_response(response).alias("summary"))


@query(
    "c17_judge_score",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS loose, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS strict FROM events",
)
def c17(spark, sf_dir):
    texts = ['{"label": "CORRECT"}', '```json\n{"label": "wrong"}\n```', "this is incorrect", "it is wrong", "no label"]
    response = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", parse.judge_score(response).alias("loose"), parse.judge_score(response, strict=True).alias("strict"))


@query(
    "c18_note_keywords",
    "SELECT doc_id, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '[a-zA-Z\\x{4e00}-\\x{9fff}]{2,}'), 1, 5), ' ') AS keywords, left(text, 100) AS context FROM documents",
)
def c18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.note_keywords(F.col("text")), " ").alias("keywords"), F.substring("text", 1, 100).alias("context"))


@query("c19_session_time", "SELECT event_id, date_trunc('minute', ts) AS parsed FROM events")
def c19(spark, sf_dir):
    raw = F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")
    low = F.replace(F.replace(raw, F.lit("AM"), F.lit("am")), F.lit("PM"), F.lit("pm"))
    return table(spark, sf_dir, "events").select("event_id", X.session_time(low).alias("parsed"))


@query(
    "b8_scores",
    "SELECT event_id, round(greatest(0.0, least(1.0, coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN CAST(value / 100 AS VARCHAR) WHEN 1 THEN event_type ELSE CAST(-value AS VARCHAR) END AS DOUBLE), 0.0))), 6) AS score FROM events",
)
def b8(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, (F.col("value") / 100).cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise((-F.col("value")).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.round(parse.score(raw), 6).alias("score"))


def responses(spark, sf_dir):
    """Model responses in all shapes: objects, arrays, fenced, broken, invalid."""
    rows = records(spark, sf_dir)
    record = F.struct("topic", "core_entity", "intent", "entities", "confidence", F.col("reasoning"))
    k = (F.col("conv_id") + F.col("turn_ord")) % 8
    response = (
        F.when(k == 1, F.to_json(F.array(record, record)))
        .when(k == 2, F.concat(F.lit("```json\n"), F.to_json(record), F.lit("\n```")))
        .when(k == 3, F.lit("[]"))
        .when(k == 4, F.lit("not json"))
        .when(k == 5, F.to_json(F.struct(F.lit(" ").alias("topic"), "core_entity", "intent", "entities", "confidence", "reasoning")))
        .when(k == 6, F.to_json(F.struct("topic", "core_entity", "intent", "entities", F.lit(1.5).alias("confidence"), "reasoning")))
        .when(k == 7, F.to_json(F.struct("topic", "intent", "entities", "confidence", "reasoning")))
        .otherwise(F.to_json(record))
    )
    return rows.select("conv_id", "turn_ord", "dia_id", "user_input", response.alias("response"))


@query("b2_parsed_records", f"SELECT conv_id, turn_ord, CASE (conv_id + turn_ord) % 8 WHEN 1 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 1 END AS n_records FROM ({TURNS})")
def b2(spark, sf_dir):
    found = parse.response_records(F.col("response"))
    return responses(spark, sf_dir).select("conv_id", "turn_ord", F.when(found.isNotNull(), F.size(found)).alias("n_records"))


@query(
    "b3_record_errors",
    f"""SELECT conv_id, turn_ord, CASE (conv_id + turn_ord) % 8 WHEN 3 THEN 'no record' WHEN 4 THEN 'no record' WHEN 5 THEN 'blank topic' WHEN 6 THEN 'confidence out of range' WHEN 7 THEN 'missing core_entity' END AS error FROM ({TURNS})""",
)
def b3(spark, sf_dir):
    found = parse.response_records(F.col("response"))
    errors = F.filter(F.transform(found, parse.record_error), lambda e: e.isNotNull())
    return responses(spark, sf_dir).select("conv_id", "turn_ord", F.when(found.isNull(), F.lit("no record")).otherwise(F.try_element_at(errors, F.lit(1))).alias("error"))


@query(
    "b4_source_fields",
    f"""SELECT conv_id, turn_ord, rec, dia_id, topic, user_input FROM ({RECORDS}) JOIN (SELECT 1 AS rec UNION ALL SELECT 2) ON rec = 1 OR (conv_id + turn_ord) % 8 = 1
    WHERE (conv_id + turn_ord) % 8 IN (0, 1, 2)""",
)
def b4(spark, sf_dir):
    """Valid records with their turn's text and id; one bad record rejects the whole response."""
    rows = responses(spark, sf_dir).withColumn("found", parse.response_records(F.col("response")))
    good = rows.where(F.col("found").isNotNull() & ~F.exists("found", lambda r: parse.record_error(r).isNotNull()))
    each = good.select("conv_id", "turn_ord", "dia_id", "user_input", F.posexplode(F.transform("found", parse.clean_record)).alias("at", "r"))
    return each.select("conv_id", "turn_ord", (F.col("at") + 1).alias("rec"), "dia_id", "r.topic", "user_input")


@query(
    "b5_ingest_defaults",
    f"""SELECT conv_id, turn_ord, CASE WHEN turn_ord % 2 = 0 THEN [core_entity] ELSE entities END AS entities, CASE WHEN turn_ord % 3 = 0 THEN 0.0 ELSE confidence END AS confidence FROM ({RECORDS})""",
)
def b5(spark, sf_dir):
    from memjobs.operators.hierarchy import with_defaults

    rows = records(spark, sf_dir).withColumn("entities", F.when(F.col("turn_ord") % 2 == 0, F.array(F.lit(" "))).otherwise(F.col("entities")))
    rows = rows.withColumn("confidence", F.when(F.col("turn_ord") % 3 == 0, F.lit(None)).otherwise(F.col("confidence")))
    return with_defaults(rows).select("conv_id", "turn_ord", "entities", "confidence")
