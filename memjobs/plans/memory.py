"""Queries that build the memory hierarchy and what is derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjobs.functions.embed import HashingEmbedder
from memjobs.operators import baselines, hierarchy, routing
from memjobs.plans.scalar import s_memory, s_words
from memjobs.plans.tables import RECORDS, TURNS, query_id, records, table, turns

QUERIES, ORACLE_SQL = {}, {}

#: Exact-topic memory in SQL: the cut rule as a recursion over each topic's exchanges.
_SAME = f"CAST(len(list_intersect({s_memory('o.intent')}, {s_memory('f.first_intent')})) AS DOUBLE) / sqrt(len({s_memory('o.intent')}) * len({s_memory('f.first_intent')}))"
_CUT = f"f.size >= 2 AND o.intent <> f.first_intent AND {_SAME} < 0.8"
MEMORY = f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_ord, rec_ord) AS seq FROM ({RECORDS})),
e AS (SELECT conv_id, topic, row_number() OVER (PARTITION BY conv_id ORDER BY min(seq)) AS exp_no FROM q GROUP BY conv_id, topic),
o AS (SELECT q.*, exp_no, row_number() OVER (PARTITION BY q.conv_id, exp_no ORDER BY seq) AS n FROM q JOIN e USING (conv_id, topic)),
fold(conv_id, exp_no, n, first_intent, size, seg_no) AS (
    SELECT conv_id, exp_no, n, intent, 1, 1 FROM o WHERE n = 1
    UNION ALL
    SELECT o.conv_id, o.exp_no, o.n, CASE WHEN {_CUT} THEN o.intent ELSE f.first_intent END, CASE WHEN {_CUT} THEN 1 ELSE f.size + 1 END, f.seg_no + CASE WHEN {_CUT} THEN 1 ELSE 0 END
    FROM fold AS f JOIN o ON o.conv_id = f.conv_id AND o.exp_no = f.exp_no AND o.n = f.n + 1
), qa AS (
    SELECT o.*, seg_no, 'qa_' || o.conv_id || '_' || seq AS qa_id, 'seg_' || o.conv_id || '_' || o.exp_no || '_' || seg_no AS segment_id, 'exp_' || o.conv_id || '_' || o.exp_no AS experience_id
    FROM o JOIN fold USING (conv_id, exp_no, n)
), seg AS (
    SELECT conv_id, experience_id, segment_id, arg_min(topic, seq) AS topic, arg_min(core_entity, seq) AS core_entity, arg_min(intent, seq) AS intent,
           list(qa_id ORDER BY seq) AS qa_ids, count(*) AS n_qas, min(seq) AS created_at, max(seq) AS updated_at FROM qa GROUP BY ALL
), ent AS (
    SELECT conv_id, segment_id, entity, count(*) AS n, min(seq * 1000 + pl) AS first FROM (SELECT conv_id, segment_id, seq, unnest(entities) AS entity, unnest(range(1, len(entities) + 1)) AS pl FROM qa) GROUP BY ALL
), top AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY n DESC, first, entity) AS rank FROM ent
), segsum AS (
    SELECT conv_id, experience_id, segment_id, n_qas, created_at, intent, n_qas || ' exchanges on ' || intent || '; entities: ' || coalesce(names, 'none') AS summary
    FROM seg LEFT JOIN (SELECT conv_id, segment_id, string_agg(entity, ', ' ORDER BY rank) AS names FROM top WHERE rank <= 8 GROUP BY ALL) USING (conv_id, segment_id)
)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def memory(spark, sf_dir):
    return hierarchy.exact_topic_memory(records(spark, sf_dir))


# -- routing in SQL: a recursion over each conversation's records, with its experiences as a list of structs


def _codes(x: str) -> str:
    """Bucket (from 1) times sign of each token of a text. SQL lacks the hash, so the words that topic records can have are listed."""
    embedder = HashingEmbedder()
    words = "topic entity intent t0 t1 t2 i0 i1 plan ask tell".split() + [f"e{k}" for k in range(10)]
    places = {w: embedder.place(w) for w in words}
    cases = " ".join(f"WHEN '{w}' THEN {int((b + 1) * sign)}" for w, (b, sign) in places.items())
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda t: CASE t {cases} END)"


def _dot(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform({a}, lambda i: list_sum(list_transform({b}, lambda j: CASE WHEN abs(i) = abs(j) THEN sign(i) * sign(j) ELSE 0 END)))), 0)"


_STATE = {"topic": "VARCHAR", "core_entity": "VARCHAR", "intents": "VARCHAR[]", "recent": "VARCHAR[]", "n_segments": "INT", "size": "INT", "segment_fresh": "INT", "segment_version": "INT", "version": "INT", "fresh": "INT"}
_NONE = "CAST([] AS VARCHAR[])"


def _with(x: str, **changes: str) -> str:
    """An experience's struct with some of its fields changed."""
    return "{" + ", ".join(f"'{c}': CAST({changes.get(c, f'{x}.{c}')} AS {t})" for c, t in _STATE.items()) + "}"


def _put(xs: str, place: str, x: str) -> str:
    return f"list_concat(list_concat(list_slice({xs}, 1, {place} - 1), [{x}]), list_slice({xs}, {place} + 1, len({xs})))"


_ALIKE = f"CAST(len(list_intersect({s_memory('intent')}, {s_memory('e.recent[1]')})) AS DOUBLE) / sqrt(len({s_memory('intent')}) * len({s_memory('e.recent[1]')}))"
_EVERY = hierarchy.SUMMARY_EVERY
ROUTED = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_ord, rec_ord) AS n, {_codes("'Topic: ' || topic || ' Entity: ' || core_entity")} AS asked FROM ({RECORDS})),
fold AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS cur, CAST([] AS STRUCT({', '.join(f'{c} {t}' for c, t in _STATE.items())})[]) AS xs, '' AS action FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL
    SELECT conv_id, n, now, {_put('xs', 'now', 'e')}, action FROM (
        SELECT conv_id, n, now, xs, action, {_with('e', segment_version='e.segment_version + CAST(e.segment_fresh >= ' + str(_EVERY) + ' AS INT)', segment_fresh='CASE WHEN e.segment_fresh >= ' + str(_EVERY) + ' THEN 0 ELSE e.segment_fresh END',
            version='e.version + CAST(e.fresh >= ' + str(_EVERY) + ' AS INT)', fresh='CASE WHEN e.fresh >= ' + str(_EVERY) + ' THEN 0 ELSE e.fresh END')} AS e
        FROM (
            SELECT conv_id, n, now, xs, CASE WHEN cut AND action = 'append_segment' THEN 'new_segment' ELSE action END AS action,
                {_with('e', intents='CASE WHEN list_contains(e.intents, intent) THEN e.intents ELSE list_append(e.intents, intent) END', recent='CASE WHEN cut THEN list_slice(list_concat([intent], e.recent), 1, 3) ELSE e.recent END',
                n_segments='e.n_segments + CAST(cut AS INT)', size='CASE WHEN cut THEN 1 ELSE e.size + 1 END', segment_fresh='CASE WHEN cut THEN 1 ELSE e.segment_fresh + 1 END', segment_version='CASE WHEN cut THEN 1 ELSE e.segment_version END', fresh='e.fresh + CAST(cut AS INT)')} AS e
            FROM (
                SELECT *, e.n_segments = 0 OR (e.size >= 2 AND intent <> e.recent[1] AND {_ALIKE} < 0.8) AS cut FROM (
                    SELECT *, xs[now] AS e FROM (
                        SELECT conv_id, n, intent, CASE WHEN NOT changed THEN 'append_segment' WHEN best IS NULL THEN 'new_experience' ELSE 'switch_experience' END AS action,
                            CASE WHEN NOT changed THEN cur WHEN best IS NULL THEN len(xs) + 1 ELSE best END AS now,
                            CASE WHEN changed AND best IS NULL THEN list_append(xs, {_with('', topic='topic', core_entity='core_entity', intents=_NONE, recent=_NONE, n_segments='0', size='0', segment_fresh='0', segment_version='1', version='1', fresh='0')}) ELSE xs END AS xs
                        FROM (
                            SELECT *, CASE WHEN changed AND list_max(near) >= {routing.MATCH} THEN list_position(near, list_max(near)) END AS best FROM (
                                SELECT *, list_transform(xs, lambda x: round(greatest(0.0, {_dot(_codes("'Topic: ' || x.topic || ' Entity: ' || x.core_entity || ' Intent: ' || array_to_string(list_concat(x.intents, x.recent), ' ')"), 'asked')}
                                    / sqrt({_dot('asked', 'asked')} * {_dot(*[_codes("'Topic: ' || x.topic || ' Entity: ' || x.core_entity || ' Intent: ' || array_to_string(list_concat(x.intents, x.recent), ' ')")] * 2)})), 12)) AS near
                                FROM (
                                    SELECT conv_id, n, cur, topic, core_entity, intent, asked, changed,
                                        CASE WHEN changed AND cur > 0 THEN {_put('xs', 'cur', _with('xs[cur]', segment_version='xs[cur].segment_version + 1', segment_fresh='0', version='xs[cur].version + 1', fresh='0'))} ELSE xs END AS xs
                                    FROM (SELECT r.*, f.cur, f.xs, f.cur = 0 OR f.xs[f.cur].topic <> r.topic AS changed FROM fold AS f JOIN r ON r.conv_id = f.conv_id AND r.n = f.n + 1))))))))))
SELECT conv_id, r.turn_ord, r.rec_ord, n AS seq, r.topic, r.intent, 'qa_' || conv_id || '_' || n AS qa_id, 'seg_' || conv_id || '_' || cur || '_' || xs[cur].n_segments AS segment_id, 'exp_' || conv_id || '_' || cur AS experience_id,
    action, xs[cur].segment_version AS segment_version, xs[cur].version AS experience_version FROM fold JOIN r USING (conv_id, n)"""


@query("e1_routed_memory", ROUTED)
def e1(spark, sf_dir):
    return routing.routed(hierarchy.with_defaults(records(spark, sf_dir)))


@query("e2_exact_topic_memory", MEMORY + "SELECT conv_id, seq, qa_id, segment_id, experience_id, topic FROM qa")
def e2(spark, sf_dir):
    return memory(spark, sf_dir).select("conv_id", "seq", "qa_id", "segment_id", "experience_id", "topic")


@query(
    "e3_topic_runs",
    f"""SELECT conv_id, turn_ord, topic, sum(changed) OVER (PARTITION BY conv_id ORDER BY turn_ord, rec_ord) AS run_no FROM (
    SELECT *, CASE WHEN topic = lag(topic) OVER (PARTITION BY conv_id ORDER BY turn_ord, rec_ord) THEN 0 ELSE 1 END AS changed FROM ({RECORDS}))""",
)
def e3(spark, sf_dir):
    return hierarchy.topic_runs(records(spark, sf_dir)).select("conv_id", "turn_ord", "topic", "run_no")


@query("e4_segment_numbers", MEMORY + "SELECT conv_id, exp_no, seq, intent, seg_no FROM qa")
def e4(spark, sf_dir):
    return memory(spark, sf_dir).select("conv_id", "exp_no", "seq", "intent", "seg_no")


@query(
    "e5_latest_segments",
    MEMORY + "SELECT conv_id, topic, segment_id, updated_at, recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, topic ORDER BY updated_at DESC, created_at DESC, segment_id) AS recency FROM seg) WHERE recency <= 2",
)
def e5(spark, sf_dir):
    found = hierarchy.latest(hierarchy.segments_of(memory(spark, sf_dir)), ["conv_id", "topic"], "segment_id", 2)
    return found.select("conv_id", "topic", "segment_id", "updated_at", "recency")


@query("e6_segments", MEMORY + "SELECT conv_id, experience_id, segment_id, topic, core_entity, intent, qa_ids, n_qas, created_at, updated_at FROM seg")
def e6(spark, sf_dir):
    return hierarchy.segments_of(memory(spark, sf_dir)).drop("status")


@query(
    "e6_experiences",
    MEMORY + """, s AS (SELECT experience_id, list(segment_id ORDER BY created_at) AS segment_ids FROM seg GROUP BY ALL),
    i AS (SELECT experience_id, list(intent ORDER BY f) AS intents FROM (SELECT experience_id, intent, min(seq) AS f FROM qa GROUP BY ALL) GROUP BY ALL)
    SELECT conv_id, experience_id, arg_min(topic, seq) AS topic, any_value(array_to_string(segment_ids, ',')) AS segment_ids, any_value(array_to_string(intents, ',')) AS intents,
           arg_max(segment_id, seq) AS current_segment_id, count(*) AS n_qas, min(seq) AS created_at, max(seq) AS updated_at
    FROM qa JOIN s USING (experience_id) JOIN i USING (experience_id) GROUP BY ALL""",
)
def e6b(spark, sf_dir):
    x = hierarchy.experiences_of(memory(spark, sf_dir))
    return x.select("conv_id", "experience_id", "topic", F.array_join("segment_ids", ",").alias("segment_ids"), F.array_join("intents_link", ",").alias("intents"),
                    F.col("state.current_segment_id").alias("current_segment_id"), "n_qas", "created_at", "updated_at")


@query("e7_summaries_due", MEMORY + "SELECT conv_id, segment_id, seq, nth, nth % 3 = 0 AS due, CAST(floor(nth / 3) AS INT) AS version FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY seq) AS nth FROM qa)")
def e7(spark, sf_dir):
    return hierarchy.summaries_due(memory(spark, sf_dir), 3)


@query("e8_segment_summaries", MEMORY + "SELECT conv_id, segment_id, summary FROM segsum")
def e8(spark, sf_dir):
    return hierarchy.segment_summaries(memory(spark, sf_dir)).select("conv_id", "segment_id", "summary")


@query(
    "e9_experience_summaries",
    MEMORY + """, i AS (SELECT conv_id, experience_id, string_agg(intent, ', ' ORDER BY f) AS intents FROM (SELECT conv_id, experience_id, intent, min(seq) AS f FROM qa GROUP BY ALL) GROUP BY ALL)
    SELECT conv_id, experience_id, n || ' segments; intents: ' || intents || '; last: ' || last AS summary
    FROM (SELECT conv_id, experience_id, count(*) AS n, arg_max(summary, created_at) AS last FROM segsum GROUP BY ALL) JOIN i USING (conv_id, experience_id)""",
)
def e9(spark, sf_dir):
    return hierarchy.experience_summaries(memory(spark, sf_dir))


@query(
    "e10_summary_inputs",
    MEMORY + """SELECT conv_id, segment_id, string_agg(left(user_input, 1200), '|' ORDER BY seq) AS users, count(*) AS n_items
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY seq DESC) AS back FROM qa) WHERE back <= 20 GROUP BY ALL""",
)
def e10(spark, sf_dir):
    rows = hierarchy.summary_inputs(memory(spark, sf_dir))
    items = F.from_json("items", "array<struct<user:string>>")
    return rows.select("conv_id", "segment_id", F.array_join(items["user"], "|").alias("users"), "n_items")


@query(
    "e11_vector_documents",
    MEMORY + """, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY seq DESC) AS back FROM qa)
    SELECT seg.conv_id, seg.segment_id, 'Topic: ' || seg.topic || chr(10) || 'Entity: ' || seg.core_entity || chr(10) || 'Intent: ' || seg.intent || chr(10) || 'Summary: ' || segsum.summary || chr(10)
    || 'Recent questions: ' || questions AS document FROM seg JOIN segsum USING (conv_id, segment_id)
    JOIN (SELECT conv_id, segment_id, string_agg(user_input, ' | ' ORDER BY back) AS questions FROM r WHERE back <= 3 GROUP BY ALL) USING (conv_id, segment_id)""",
)
def e11(spark, sf_dir):
    return baselines.segment_documents(memory(spark, sf_dir)).select("conv_id", "segment_id", "document")


@query(
    "e12_rolling_context",
    f"""SELECT conv_id, turn_ord, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY session_num, turn_ord ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS context
    FROM (SELECT *, speaker || ': ' || text AS line FROM ({TURNS}) WHERE trim(text) <> '')""",
)
def e12(spark, sf_dir):
    rows = hierarchy.rolling_context(turns(spark, sf_dir))
    lines = F.transform(F.filter(F.split("context", "\n"), lambda s: s != ""), lambda s: F.concat(F.get_json_object(s, "$.speaker"), F.lit(": "), F.get_json_object(s, "$.text")))
    return rows.select("conv_id", "turn_ord", F.array_join(lines, "\n").alias("context"))


@query(
    "e13_memory_audit",
    MEMORY + f""", t AS (SELECT DISTINCT conv_id, dia_id FROM ({TURNS}) WHERE trim(text) <> ''), s AS (SELECT DISTINCT conv_id, dia_id FROM qa WHERE turn_ord % 4 <> 3)
    SELECT t.conv_id, count(*) AS n_expected, count(*) - count(s.dia_id) AS n_missing, count(s.dia_id) > 0 AS reusable FROM t LEFT JOIN s USING (conv_id, dia_id) GROUP BY t.conv_id""",
)
def e13(spark, sf_dir):
    """The audit of a memory from which every fourth turn is missing."""
    return hierarchy.audit(turns(spark, sf_dir), memory(spark, sf_dir).where("turn_ord % 4 <> 3"))


@query(
    "e14_merged_state",
    "SELECT user_id, max(CASE WHEN r1 = 1 THEN value END) AS value, max(CASE WHEN r2 = 1 THEN kind END) AS kind, max(event_id) AS event_id FROM (SELECT user_id, event_id, value, kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r1, row_number() OVER (PARTITION BY user_id ORDER BY kind IS NULL, event_id DESC) AS r2 FROM (SELECT user_id, event_id, value, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind FROM events)) GROUP BY user_id",
)
def e14(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("kind"))
    return hierarchy.merged_state(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "event_id", ["value", "kind"])


@query(
    "e15_hierarchy_statistics",
    MEMORY + """, x AS (SELECT experience_id, count(*) AS k, sum(n_qas) AS n FROM seg GROUP BY ALL)
    SELECT count(*) AS experiences, sum(k) AS segments, sum(n) AS qas, round(avg(k), 6) AS segments_per_experience, round(sum(n) / sum(k), 6) AS qas_per_segment, count(*) FILTER (k = 1) AS single_segment FROM x""",
)
def e15(spark, sf_dir):
    return hierarchy.hierarchy_statistics(memory(spark, sf_dir))


@query(
    "b7_provenance",
    MEMORY + "SELECT conv_id, segment_id, string_agg(dia_id, ',' ORDER BY seq) AS dia_ids, count(DISTINCT dia_id) AS n_distinct FROM qa GROUP BY ALL",
)
def b7(spark, sf_dir):
    qa = memory(spark, sf_dir).withColumn("dia_ids", F.array("dia_id"))
    return baselines.provenance(qa, ["conv_id", "segment_id"])


@query("d2_embedding_reuse", "SELECT count(text) AS n_texts, count(DISTINCT text) AS n_distinct, round(1 - count(DISTINCT text) / count(text), 6) AS hit_rate FROM conversations")
def d2(spark, sf_dir):
    from memjobs.functions.embed import hit_rate

    return hit_rate(turns(spark, sf_dir), "text")


@query("d1_hash_embeddings")
def d1(spark, sf_dir):
    from memjobs.functions.embed import embed_once

    return embed_once(turns(spark, sf_dir), "text").select("conv_id", "turn_ord", "embedding")


FULL = f"""SELECT conv_id, string_agg('[' || speaker || ']: ' || text, chr(10) ORDER BY session_num, turn_ord) AS context, string_agg(dia_id, ',' ORDER BY session_num, turn_ord) AS dia_ids FROM ({TURNS}) GROUP BY conv_id"""


@query("f1_full_context", FULL)
def f1(spark, sf_dir):
    return baselines.full_context(turns(spark, sf_dir)).select("conv_id", "context", F.array_join("dia_ids", ",").alias("dia_ids"))


@query("h15_total_tokens", f"SELECT conv_id, len({s_words('context')}) AS total_tokens FROM ({FULL})")
def h15(spark, sf_dir):
    return baselines.total_tokens(turns(spark, sf_dir))


@query("f2_flat_retrieval")
def f2(spark, sf_dir):
    """Every turn asks for the nearest turns of its conversation."""
    rows = turns(spark, sf_dir)
    asked = rows.select("conv_id", query_id(), F.col("text").alias("question"))
    return baselines.flat_retrieval(rows, asked, 3)


@query(
    "f3_note_links",
    """WITH p AS (SELECT b.vec_id AS b, a.vec_id AS a, row_number() OVER (PARTITION BY b.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 10) DESC, a.vec_id) AS rank,
    list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id < b.vec_id),
    k AS (SELECT a, b FROM p WHERE rank <= 5 AND s >= 0.3) SELECT a AS src, b AS dst FROM k UNION SELECT b, a FROM k""",
)
def f3(spark, sf_dir):
    """Every vector as a note in the conversation of its label."""
    notes = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("conv_id"), F.col("vec_id").alias("note_id"), F.col("vec_id").alias("ord"), "embedding")
    return baselines.note_links(notes, 5, 0.3)


@query("f4_note_search")
def f4(spark, sf_dir):
    rows = turns(spark, sf_dir)
    asked = rows.select("conv_id", query_id(), F.col("text").alias("question"))
    return baselines.note_search_of_turns(rows, asked, 5)


@query("f5_layer_variants")
def f5(spark, sf_dir):
    qa = memory(spark, sf_dir)
    asked = turns(spark, sf_dir).select("conv_id", query_id(), F.col("text").alias("question"))
    return baselines.layer_retrieval(qa, asked, 3, 2)
