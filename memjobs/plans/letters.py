"""Retrieval and recall end to end, every turn asking, with letter counts as vectors, which SQL can make as well.

The same operators answer ``f2_flat_retrieval``, ``f4_note_search``, ``f5_layer_variants``, ``g7_descendants``, ``g23_recall`` and
``g24_layered_recall`` with hashed embeddings, for which SQL has no function.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from memjobs.functions.embed import embed_letters
from memjobs.operators import baselines
from memjobs.plans import recall
from memjobs.plans.memory import MEMORY, memory
from memjobs.plans.recall import asking, layers
from memjobs.plans.scalar import s_overlap, s_terms
from memjobs.plans.tables import TURNS, query_id, turns

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


# -- SQL of the vectors


def s_letters(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN list_transform(range(97, 123), lambda c: CAST(length({x}) - length(replace(replace({x}, chr(CAST(c AS INT)), ''), chr(CAST(c - 32 AS INT)), '')) AS DOUBLE)) END"


def s_near(a: str, b: str, digits: int = 12) -> str:
    return f"round(list_dot_product({a}, {b}) / greatest(1.0, sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), {digits})"


def s_first(rows: str, k: int) -> str:
    """The first ``k`` rows of ``rows`` (query_id, id, qv, v, more) for each query, with ``sim`` and ``near``, the rank."""
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS near FROM (SELECT *, {s_near('qv', 'v')} AS sim FROM ({rows}) WHERE qv IS NOT NULL AND v IS NOT NULL) QUALIFY near <= {k}"


_ASKING = f"ask AS (SELECT conv_id, conv_id * 1000000 + turn_ord AS query_id, {s_letters('text')} AS qv FROM ({TURNS}))"


def _questions(spark, sf_dir):
    rows = turns(spark, sf_dir)
    return rows, rows.select("conv_id", query_id(), F.col("text").alias("question"))


@query(
    "f2_flat_retrieval_letters",
    f"""WITH {_ASKING}, i AS (SELECT conv_id, dia_id AS id, '[' || speaker || ']: ' || text AS document FROM ({TURNS}) WHERE trim(text) <> '' AND dia_id IS NOT NULL),
    p AS ({s_first(f"SELECT query_id, qv, id, document, {s_letters('document')} AS v FROM ask JOIN i USING (conv_id)", 3)})
    SELECT query_id, string_agg(id, ',' ORDER BY near) AS retrieved_ids, string_agg(document, chr(10) ORDER BY near) AS context FROM p GROUP BY query_id""",
)
def f2(spark, sf_dir):
    found = baselines.flat_retrieval(*_questions(spark, sf_dir), 3, embed_letters)
    return found.withColumn("retrieved_ids", F.array_join("retrieved_ids", ","))


def s_keywords(x: str, most: int) -> str:
    return f"list_transform(list_slice(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), 1, {most}), lambda w: lower(w))"


@query(
    "f4_note_search_letters",
    f"""WITH n AS (SELECT conv_id, conv_id * 1000000 + turn_ord AS query_id, conv_id || '/' || dia_id AS id, turn_ord, {s_letters('text')} AS v, {s_keywords('text', 5)} AS words, list_distinct({s_keywords('text', 8)}) AS asked FROM ({TURNS})),
    kw AS (SELECT * FROM (SELECT q.query_id, i.id, len(list_intersect(q.asked, i.words)) / CAST(greatest(len(q.asked), 1) AS DOUBLE) AS keyword FROM n AS q JOIN n AS i USING (conv_id)) WHERE keyword > 0),
    near AS ({s_first("SELECT q.query_id, q.v AS qv, i.id, i.v FROM n AS q JOIN n AS i USING (conv_id)", 15)}),
    top AS (SELECT query_id, id, round(0.4 * coalesce(keyword, 0) + 0.6 * coalesce(sim, 0), 9) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(0.4 * coalesce(keyword, 0) + 0.6 * coalesce(sim, 0), 9) DESC, id) AS rank
            FROM kw FULL JOIN near USING (query_id, id) QUALIFY rank <= 5),
    e AS (SELECT b.id AS b, a.id AS a, {s_near('a.v', 'b.v', 10)} AS s FROM n AS a JOIN n AS b ON a.conv_id = b.conv_id AND a.turn_ord < b.turn_ord WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
    k AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS nth FROM e) WHERE nth <= 5 AND s >= 0.7),
    link AS (SELECT a AS src, b AS dst FROM k UNION SELECT b, a FROM k),
    linked AS (SELECT DISTINCT query_id, dst AS id FROM top JOIN link ON src = id)
    SELECT top.query_id, top.id, similarity, rank, linked.id IS NOT NULL AS linked FROM top LEFT JOIN linked ON linked.query_id = top.query_id AND linked.id = top.id""",
)
def f4(spark, sf_dir):
    return baselines.note_search_of_turns(*_questions(spark, sf_dir), 5, embed_letters)


_FIELDS = "'Topic: ' || topic || chr(10) || 'Entity: ' || core_entity || chr(10) || 'Intent: ' || intent || chr(10)"


@query(
    "f5_layer_variants_letters",
    MEMORY + f""", {_ASKING}, qd AS (SELECT conv_id, qa_id AS id, dia_id, {_FIELDS} || 'Related: ' || array_to_string(entities, ', ') || chr(10) || 'User: ' || user_input || chr(10) || 'Assistant: ' || left(assistant_output, 500) AS document FROM qa),
    last AS (SELECT conv_id, segment_id, user_input, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY seq DESC) AS back FROM qa QUALIFY back <= 3),
    sd AS (SELECT seg.conv_id, seg.segment_id AS id, 'Topic: ' || seg.topic || chr(10) || 'Entity: ' || seg.core_entity || chr(10) || 'Intent: ' || seg.intent || chr(10) || 'Summary: ' || summary || chr(10) || 'Recent questions: ' || questions AS document
           FROM seg JOIN segsum USING (conv_id, segment_id) JOIN (SELECT conv_id, segment_id, string_agg(user_input, ' | ' ORDER BY back) AS questions FROM last GROUP BY ALL) USING (conv_id, segment_id)),
    qn AS ({s_first(f"SELECT query_id, qv, id, dia_id, document, {s_letters('document')} AS v FROM ask JOIN qd USING (conv_id)", 3)}),
    sn AS ({s_first(f"SELECT query_id, qv, id, document, {s_letters('document')} AS v FROM ask JOIN sd USING (conv_id)", 2)}),
    qg AS (SELECT query_id, string_agg(dia_id, ',' ORDER BY near) AS retrieved_ids, string_agg(document, chr(10) || chr(10) ORDER BY near) AS qa_context FROM qn GROUP BY query_id),
    sg AS (SELECT query_id, string_agg(document, chr(10) || chr(10) ORDER BY near) AS segment_context FROM sn GROUP BY query_id)
    SELECT query_id, retrieved_ids, qa_context, concat_ws(chr(10) || chr(10), segment_context, qa_context) AS context FROM qg LEFT JOIN sg USING (query_id)""",
)
def f5(spark, sf_dir):
    found = baselines.layer_retrieval(memory(spark, sf_dir), _questions(spark, sf_dir)[1], 3, 2, embed_letters)
    return found.withColumn("retrieved_ids", F.array_join("retrieved_ids", ","))


# -- the memory as SQL sees it: ``q0`` the questions, ``m_experience``, ``m_segment`` and ``m_qa`` the rows of each layer with
#    ``told``, the text that keywords are looked for in, and ``v``, the vector of ``doc``

_KW = "array_to_string(list_filter(list_concat([qt, qe, qi], qents, [trim(question)]), lambda p: trim(p) <> ''), chr(10))"
_HEAD = "lower(topic || ' ' || core_entity || ' ' || "
LAYERS = f""", q0 AS (
    SELECT *, {s_terms(_KW, 'qt', 'qe', 'qi')} AS terms, {s_terms(_KW)} AS wide, {s_letters('question')} AS qv
    FROM (SELECT conv_id * 1000000 + turn_ord AS query_id, conv_id AS qc, topic AS qt, core_entity AS qe, intent AS qi, entities AS qents, confidence AS qconf, user_input AS question FROM qa)
), said AS (
    SELECT conv_id, experience_id, list(intent ORDER BY f) AS intents FROM (SELECT conv_id, experience_id, intent, min(seq) AS f FROM qa GROUP BY ALL) GROUP BY ALL
), m_experience AS (
    SELECT *, {_HEAD}array_to_string(intents, ' ') || ' ' || doc) AS told, {s_letters('doc')} AS v FROM (
        SELECT conv_id, experience_id AS id, topic, core_entity, intents, updated_at, 0.0 AS confidence, experience_id, CAST(NULL AS VARCHAR) AS segment_id,
               n || ' segments; intents: ' || array_to_string(intents, ', ') || '; last: ' || last AS doc
        FROM (SELECT conv_id, experience_id, arg_min(topic, seq) AS topic, arg_min(core_entity, seq) AS core_entity, max(seq) AS updated_at FROM qa GROUP BY ALL)
        JOIN (SELECT experience_id, count(*) AS n, arg_max(summary, created_at) AS last FROM segsum GROUP BY ALL) USING (experience_id) JOIN said USING (conv_id, experience_id))
), m_segment AS (
    SELECT *, {_HEAD}intents[1] || ' ' || doc) AS told, {s_letters('doc')} AS v FROM (
        SELECT seg.conv_id, seg.segment_id AS id, topic, core_entity, [seg.intent] AS intents, updated_at, 0.0 AS confidence, seg.experience_id, CAST(NULL AS VARCHAR) AS segment_id, summary AS doc
        FROM seg JOIN segsum USING (segment_id))
), m_qa AS (
    SELECT conv_id, qa_id AS id, topic, core_entity, [intent] AS intents, seq AS updated_at, confidence, experience_id, segment_id, user_input AS doc,
           {_HEAD}intent || ' ' || user_input || ' ' || assistant_output || ' ' || array_to_string(entities, ' ')) AS told, {s_letters('user_input')} AS v, user_input, assistant_output, entities FROM qa
)"""
_MATCHED = "(CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT))"
_ST = f"({_MATCHED} + CAST(list_contains(intents, qi) AS INT)) / 3.0"
_KEY = f"""CASE WHEN len(terms) = 0 THEN 0.0 ELSE {s_overlap("array_to_string(terms, ' ')", 'told')} END"""


def s_score(sim: str, keywords: str = _KEY) -> str:
    return f"least(1.0, 0.35 * coalesce({sim}, 0) + 0.35 * {keywords} + 0.3 * {_ST})"


def s_leaf(sim: str) -> str:
    return f"least(1.0, 0.95 * {s_score(sim)} + 0.05 * confidence)"


#: Roots, and what stands below them: ``found`` (query_id, experience_id, score), ``low`` of segments, ``leaf`` of exchanges.
DESCENT = LAYERS + f""", near_x AS ({s_first('SELECT query_id, qv, id, v FROM q0 JOIN m_experience ON conv_id = qc', 12)}),
rel AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {_MATCHED} DESC, updated_at DESC, id) AS place FROM q0 JOIN m_experience ON conv_id = qc WHERE {_MATCHED} > 0 QUALIFY place <= 12),
root AS (
    SELECT query_id, id AS experience_id, least(1.0, 0.4 * coalesce(61.0 / (60 + near), 0) + 0.4 * coalesce(61.0 / (60 + place), 0) + 0.2 * {s_score('sim', '0.0')}) AS score, updated_at
    FROM (SELECT query_id, id, sim, near, place FROM near_x FULL JOIN rel USING (query_id, id)) JOIN q0 USING (query_id) JOIN m_experience USING (id)
), found AS (SELECT query_id, experience_id, score FROM root QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, updated_at DESC, experience_id) <= 8),
below AS (SELECT found.query_id, m_segment.* FROM found JOIN m_segment USING (experience_id)),
near_s AS ({s_first('SELECT query_id, qv, id, v FROM q0 JOIN below USING (query_id)', 32)}),
low AS (SELECT below.query_id, below.id AS segment_id, experience_id, {s_score('sim')} AS score FROM below JOIN q0 USING (query_id) LEFT JOIN near_s ON near_s.query_id = below.query_id AND near_s.id = below.id),
under AS (SELECT below.query_id, m_qa.* FROM below JOIN m_qa ON m_qa.segment_id = below.id),
near_q AS ({s_first('SELECT query_id, qv, id, v FROM q0 JOIN under USING (query_id)', 64)}),
leaf AS (SELECT under.query_id, under.id AS qa_id, segment_id, {s_leaf('sim')} AS score, sim FROM under JOIN q0 USING (query_id) LEFT JOIN near_q ON near_q.query_id = under.query_id AND near_q.id = under.id)
"""


def s_select(exp: str, seg: str, qa: str, n_exp: int, n_seg: int, n_qa: int) -> str:
    """The selection from the top: ``x1``, ``s1`` and ``q1`` (query_id, id, rank) of candidate frames."""
    return f""", sp AS (SELECT c.*, coalesce(b, 0) AS best, round(least(1.0, 0.7 * coalesce(b, 0) + 0.3 * c.score), 9) AS path FROM {seg} AS c LEFT JOIN (SELECT query_id, segment_id, max(score) AS b FROM {qa} GROUP BY ALL) USING (query_id, segment_id)),
xp AS (SELECT c.*, round(least(1.0, 0.6 * coalesce(m, 0) + 0.3 * coalesce(w, 0) + 0.1 * c.score), 9) AS branch FROM {exp} AS c LEFT JOIN (SELECT query_id, experience_id, max(best) AS m, max(path) AS w FROM sp GROUP BY ALL) USING (query_id, experience_id)),
x1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY branch DESC, experience_id) AS rank FROM xp QUALIFY rank <= {n_exp}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path DESC, segment_id) AS rank FROM sp SEMI JOIN x1 USING (query_id, experience_id) QUALIFY rank <= {n_seg}),
q1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, qa_id) AS rank FROM {qa} SEMI JOIN s1 USING (query_id, segment_id) QUALIFY rank <= {n_qa})
"""


@query(
    "g7_descendants_letters",
    MEMORY + DESCENT + """SELECT query_id, qa_id, segment_id, round(score, 6) AS score, CASE WHEN sim IS NULL THEN 'initial_experience_descendant' ELSE 'initial_experience_descendant,scoped_qa_vector' END AS sources FROM leaf""",
)
def g7(spark, sf_dir):
    q, (exp, seg, qa) = asking(spark, sf_dir), layers(spark, sf_dir)
    _, _, leaves = recall.descended(q, exp, *recall.with_units(q, seg, qa), embed=embed_letters)
    return leaves.withColumn("score", F.round("score", 6)).withColumn("sources", F.array_join("sources", ","))


_RESCUE = f""", unsure AS (SELECT * FROM q0 WHERE qconf < 0.8),
near_g AS ({s_first('SELECT query_id, qv, id, v FROM unsure JOIN m_qa ON conv_id = qc', 40)}),
rel_g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, id) AS nth FROM unsure JOIN m_qa ON conv_id = qc WHERE {_MATCHED} > 0
    OR len(list_intersect(list_transform(entities, lambda e: lower(e)), list_transform(qents, lambda e: lower(e)))) > 0
    OR len(list_filter(wide, lambda t: contains(lower(user_input || ' ' || assistant_output || ' ' || intents[1]), t))) > 0 QUALIFY nth <= 40),
new AS (SELECT query_id, id AS qa_id, segment_id, {s_leaf('sim')} AS score FROM (SELECT query_id, id, sim FROM near_g FULL JOIN rel_g USING (query_id, id)) JOIN m_qa USING (id) JOIN q0 USING (query_id)),
q2 AS (SELECT query_id, qa_id, segment_id, score FROM (SELECT query_id, qa_id, segment_id, score, 0 AS turn FROM leaf UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY query_id, qa_id ORDER BY round(score, 12) DESC, turn) = 1),
s2 AS (SELECT * FROM low UNION ALL SELECT query_id, id, experience_id, {s_score('NULL')} FROM (SELECT DISTINCT query_id, segment_id FROM q2 ANTI JOIN low USING (query_id, segment_id)) AS w JOIN m_segment ON id = w.segment_id JOIN q0 USING (query_id)),
x2 AS (SELECT * FROM found UNION ALL SELECT query_id, id, {s_score('NULL', '0.0')} FROM (SELECT DISTINCT query_id, experience_id FROM s2 ANTI JOIN found USING (query_id, experience_id)) AS w JOIN m_experience ON id = w.experience_id JOIN q0 USING (query_id)),
s3 AS (SELECT * FROM s2 SEMI JOIN x2 USING (query_id, experience_id)), q3 AS (SELECT * FROM q2 SEMI JOIN s3 USING (query_id, segment_id)),
s4 AS (SELECT * FROM s3 SEMI JOIN q3 USING (query_id, segment_id)), x4 AS (SELECT * FROM x2 SEMI JOIN s4 USING (query_id, experience_id))"""


@query(
    "g23_recall_letters",
    MEMORY + DESCENT + _RESCUE + s_select("x4", "s4", "q3", 2, 3, 8) + """, s5 AS (SELECT * FROM s1 SEMI JOIN q1 USING (query_id, segment_id)), x5 AS (SELECT * FROM x1 SEMI JOIN s5 USING (query_id, experience_id))
    SELECT query_id, 'experience' AS level, experience_id AS id, rank FROM x5 UNION ALL SELECT query_id, 'segment', segment_id, rank FROM s5 UNION ALL SELECT query_id, 'qa', qa_id, rank FROM q1""",
)
def g23(spark, sf_dir):
    """Recall with a token budget that no tree of these conversations reaches; what a budget cuts is in ``g16_fitted_trees``."""
    x, s, q, _ = recall.recalled(asking(spark, sf_dir), *layers(spark, sf_dir), token_budget=1 << 30, embed=embed_letters)
    level = lambda rows, name: rows.select("query_id", F.lit(name).alias("level"), F.col(f"{name}_id").alias("id"), "rank")
    return level(x, "experience").union(level(s, "segment")).union(level(q, "qa"))


def s_layered(level: str, limit: int, score: str) -> str:
    """One layer of the older recall: relational, keyword and vector rows of a conversation, fused to ``limit`` rows in ``l_<level>``."""
    n, quota = level, max(1, limit // 3)
    return f""", a_{n} AS (SELECT *, {_MATCHED} + CAST(list_contains(intents, qi) AS INT) AS same, len(list_filter(terms, lambda t: contains(told, t))) > 0 AS named, CASE WHEN qv IS NOT NULL AND v IS NOT NULL THEN {s_near('qv', 'v')} END AS raw FROM q0 JOIN m_{n} ON conv_id = qc),
b_{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC NULLS LAST, id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, updated_at DESC, id) AS rel, row_number() OVER (PARTITION BY query_id, named ORDER BY updated_at DESC, id) AS kw FROM a_{n}),
c_{n} AS (SELECT query_id, id, updated_at, {score} AS score, coalesce(sim, 0) AS sim, {_KEY} AS kscore, {_ST} AS st FROM (SELECT *, CASE WHEN near <= 20 THEN raw END AS sim FROM b_{n})
    WHERE (raw IS NOT NULL AND near <= least(20, {limit})) OR (same > 0 AND rel <= {limit}) OR (named AND kw <= {limit})),
d_{n} AS (SELECT *, CASE WHEN sim > 0 THEN row_number() OVER (PARTITION BY query_id, sim > 0 ORDER BY round(least(1.0, 0.75 * sim + 0.25 * st), 9) DESC, id) END AS vr, CASE WHEN kscore > 0 THEN row_number() OVER (PARTITION BY query_id, kscore > 0 ORDER BY round(least(1.0, 0.75 * kscore + 0.25 * st), 9) DESC, id) END AS kr FROM c_{n}),
l_{n} AS (SELECT query_id, id, final AS score FROM (SELECT *, round(least(1.0, 0.75 * (0.5 * coalesce(61.0 / (60 + vr), 0) + 0.5 * coalesce(61.0 / (60 + kr), 0)) + 0.25 * score), 9) AS final FROM d_{n})
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN vr <= {quota} THEN vr WHEN kr <= {quota} THEN {quota} + kr ELSE {2 * quota + 1} END, final DESC, updated_at DESC, id) <= {limit})"""


@query(
    "g24_layered_recall_letters",
    MEMORY + LAYERS + s_layered("experience", 8, s_score("sim")) + s_layered("segment", 20, s_score("sim")) + s_layered("qa", 32, s_leaf("sim")) + """,
    qf AS (SELECT l.query_id, l.id AS qa_id, m.segment_id, l.score FROM l_qa AS l JOIN m_qa AS m USING (id)),
    sg AS (SELECT l.query_id, l.id AS segment_id, m.experience_id, l.score FROM l_segment AS l JOIN m_segment AS m USING (id)),
    sf AS (SELECT * FROM sg UNION ALL SELECT w.query_id, m.id, m.experience_id, 0.0 FROM (SELECT DISTINCT query_id, segment_id FROM qf ANTI JOIN sg USING (query_id, segment_id)) AS w JOIN m_segment AS m ON m.id = w.segment_id),
    xf AS (SELECT query_id, id AS experience_id, score FROM l_experience UNION ALL SELECT DISTINCT query_id, experience_id, 0.0 FROM sf ANTI JOIN (SELECT query_id, id AS experience_id FROM l_experience) USING (query_id, experience_id))
    """ + s_select("xf", "sf", "qf", 8, 20, 32) + "SELECT query_id, experience_id AS id, rank FROM x1 UNION ALL SELECT query_id, segment_id, rank FROM s1 UNION ALL SELECT query_id, qa_id, rank FROM q1",
)
def g24(spark, sf_dir):
    return recall.layered_recall(asking(spark, sf_dir), *layers(spark, sf_dir), embed=embed_letters)
