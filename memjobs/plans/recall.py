"""Queries of batch recall: every turn asks the memory of its conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memjobs.functions import text as X
from memjobs.functions.embed import Embed, embed_once
from memjobs.operators import budget, evaluation, hierarchy, models
from memjobs.operators import recall as R
from memjobs.operators.vectors import scoped_top_k
from memjobs.plans.memory import MEMORY
from memjobs.plans.scalar import s_overlap, s_terms
from memjobs.plans.tables import kept, query_id, records, records_of, turns

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- frames


def asked(spark, sf_dir):
    return records(spark, sf_dir).select(query_id(), "conv_id", "topic", "core_entity", "intent", "entities", "confidence", F.col("user_input").alias("question"))


def exchanges(spark, sf_dir):
    return kept(hierarchy.exact_topic_memory(records(spark, sf_dir)))


def asking(spark, sf_dir):
    """The queries with their keywords taken apart, which many steps read."""
    return kept(R.prepared(asked(spark, sf_dir)))


def layers(spark, sf_dir):
    return layers_of(exchanges(spark, sf_dir))


def layers_of(qa):
    """Experiences, segments and exchanges with their summaries, made once: recall reads each of them many times."""
    segments = hierarchy.segments_of(qa).join(hierarchy.segment_summaries(qa).select("conv_id", "segment_id", "summary"), ["conv_id", "segment_id"])
    experiences = hierarchy.experiences_of(qa).join(hierarchy.experience_summaries(qa), ["conv_id", "experience_id"])
    return kept(experiences), kept(segments), qa


def overlap_hits(queries, rows, id_col, text):
    """A stand-in for vector hits that SQL can express: lexical overlap of the question with a text, both taken apart before they meet."""
    asking = queries.select("query_id", "conv_id", X.lexical_units(F.col("question")).alias("asked"))
    pairs = asking.join(rows.select("conv_id", F.col(id_col).alias("id"), X.lexical_units(text).alias("told")), "conv_id")
    return pairs.select("query_id", "id", F.round(X.unit_overlap(F.col("asked"), F.col("told")), 6).alias("similarity")).where("similarity > 0")


_Q = "q0 AS (SELECT conv_id * 1000000 + turn_ord AS query_id, conv_id AS qc, topic AS qt, core_entity AS qe, intent AS qi, entities AS qents, confidence AS qconf, user_input AS question FROM qa)"
_EXP = """ex AS (SELECT conv_id, experience_id, arg_min(topic, seq) AS topic, arg_min(core_entity, seq) AS core_entity, list(DISTINCT intent) AS intents, max(seq) AS updated_at, min(seq) AS created_at, count(*) AS n_qas FROM qa GROUP BY ALL)"""
_KW = "array_to_string(list_filter(list_concat([qt, qe, qi], qents, [trim(question)]), lambda p: trim(p) <> ''), chr(10))"


@query(
    "g1_relational_experiences",
    MEMORY + f""", {_Q}, {_EXP} SELECT query_id, id, n_matches, rank FROM (SELECT query_id, experience_id AS id, CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) AS n_matches,
    row_number() OVER (PARTITION BY query_id ORDER BY CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) DESC, updated_at DESC, experience_id) AS rank
    FROM q0 JOIN ex ON conv_id = qc WHERE topic = qt OR core_entity = qe) WHERE rank <= 12""",
)
def g1(spark, sf_dir):
    return R.relational(asked(spark, sf_dir), layers(spark, sf_dir)[0], "experience_id", ["topic", "core_entity"], 12).select("query_id", "id", "n_matches", "rank")


@query(
    "g2_relational_exchanges",
    MEMORY + f""", {_Q}, t AS (SELECT *, {s_terms(_KW)} AS terms FROM q0), m AS (SELECT query_id, qa_id AS id, seq FROM t JOIN qa ON conv_id = qc
    WHERE topic = qt OR core_entity = qe OR len(list_intersect(list_transform(entities, lambda e: lower(e)), list_transform(qents, lambda e: lower(e)))) > 0
    OR len(list_filter(terms, lambda x: contains(lower(user_input || ' ' || assistant_output || ' ' || intent), x))) > 0)
    SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq DESC, id) AS rank FROM m) WHERE rank <= 40""",
)
def g2(spark, sf_dir):
    return R.qa_search(asked(spark, sf_dir), exchanges(spark, sf_dir), 40, kept).select("query_id", "id", "rank")


@query(
    "g3_structured_segments",
    MEMORY + f""", {_Q} SELECT query_id, id, n_matches, rank FROM (SELECT query_id, segment_id AS id, CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) + CAST(intent = qi AS INT) AS n_matches,
    row_number() OVER (PARTITION BY query_id ORDER BY CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) + CAST(intent = qi AS INT) DESC, updated_at DESC, segment_id) AS rank
    FROM q0 JOIN seg ON conv_id = qc WHERE topic = qt OR core_entity = qe OR intent = qi) WHERE rank <= 20""",
)
def g3(spark, sf_dir):
    return R.relational(asked(spark, sf_dir), layers(spark, sf_dir)[1], "segment_id", ["topic", "core_entity", "intent"], 20).select("query_id", "id", "n_matches", "rank")


@query(
    "g4_keyword_exchanges",
    MEMORY + f""", {_Q}, t AS (SELECT *, {s_terms(_KW, 'qt', 'qe', 'qi')} AS terms FROM q0), m AS (SELECT query_id, qa_id AS id, seq FROM t JOIN qa ON conv_id = qc
    WHERE len(list_filter(terms, lambda x: contains(lower(topic || ' ' || core_entity || ' ' || intent || ' ' || user_input || ' ' || assistant_output || ' ' || array_to_string(entities, ' ')), x))) > 0)
    SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq DESC, id) AS rank FROM m) WHERE rank <= 32""",
)
def g4(spark, sf_dir):
    """By the index alone, though the given conversations are short; ``g2_relational_exchanges`` compares short ones whole."""
    return R.keyword(asked(spark, sf_dir), exchanges(spark, sf_dir), "qa", 32, step=kept, whole=0).select("query_id", "id", "rank")


_TEXT = "lower(topic || ' ' || core_entity || ' ' || intent || ' ' || user_input || ' ' || assistant_output || ' ' || array_to_string(entities, ' '))"
_SCORE = f"""c AS (SELECT *, round({s_overlap('question', 'user_input')}, 6) AS sim, CASE WHEN len(terms) = 0 THEN 0.0 ELSE {s_overlap("array_to_string(terms, ' ')", _TEXT)} END AS kw,
    (CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) + CAST(intent = qi AS INT)) / 3.0 AS st FROM (SELECT *, {s_terms(_KW, 'qt', 'qe', 'qi')} AS terms FROM q0) JOIN qa ON conv_id = qc)"""


@query("g5_candidate_scores", MEMORY + f", {_Q}, {_SCORE} SELECT query_id, qa_id AS id, round(kw, 6) AS keyword_score, round(0.95 * least(1.0, 0.35 * sim + 0.35 * kw + 0.3 * st) + 0.05 * confidence, 6) AS score FROM c")
def g5(spark, sf_dir):
    q, qa = asked(spark, sf_dir), exchanges(spark, sf_dir)
    every = q.select("query_id", "conv_id").join(qa.select("conv_id", F.col("qa_id").alias("id")), "conv_id").drop("conv_id")
    rows = every.join(overlap_hits(q, qa, "qa_id", F.col("user_input")), ["query_id", "id"], "left")
    return R.candidate(rows, qa, q, "qa").select("query_id", "id", F.round("keyword_score", 6).alias("keyword_score"), F.round("score", 6).alias("score"))


@query(
    "g6_experience_roots",
    MEMORY + f""", {_Q}, {_EXP}, h AS (SELECT query_id, experience_id AS id, round({s_overlap('question', "array_to_string(list_sort(intents), ' ') || ' ' || topic")}, 6) AS s FROM q0 JOIN ex ON conv_id = qc),
    v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS vr FROM h WHERE s > 0), v2 AS (SELECT * FROM v WHERE vr <= 12),
    r AS (SELECT query_id, experience_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) DESC, updated_at DESC, experience_id) AS rr FROM q0 JOIN ex ON conv_id = qc WHERE topic = qt OR core_entity = qe),
    b AS (SELECT coalesce(v2.query_id, r2.query_id) AS query_id, coalesce(v2.id, r2.id) AS id, s, vr, rr FROM v2 FULL JOIN (SELECT * FROM r WHERE rr <= 12) AS r2 ON v2.query_id = r2.query_id AND v2.id = r2.id),
    f AS (SELECT b.query_id, id, updated_at, vr, rr, least(1.0, 0.4 * coalesce(61.0 / (60 + vr), 0) + 0.4 * coalesce(61.0 / (60 + rr), 0) + 0.2 * (0.35 * coalesce(s, 0) + 0.3 * (CAST(topic = qt AS INT) + CAST(core_entity = qe AS INT) + CAST(list_contains(intents, qi) AS INT)) / 3.0)) AS score
          FROM b JOIN q0 USING (query_id) JOIN ex ON experience_id = id)
    SELECT query_id, id AS experience_id, round(score, 6) AS score, CAST(vr IS NOT NULL AS INT) + CAST(rr IS NOT NULL AS INT) AS n_sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, updated_at DESC, id) AS rank FROM f) WHERE rank <= 8""",
)
def g6(spark, sf_dir):
    q, (exp, _, _) = asked(spark, sf_dir), layers(spark, sf_dir)
    hits = overlap_hits(q, exp, "experience_id", F.concat_ws(" ", F.array_join(F.array_sort("intents_link"), " "), "topic"))
    return R.roots(q, exp, hits).select("query_id", "experience_id", F.round("score", 6).alias("score"), F.size("sources").alias("n_sources"))


# -- candidate frames with plain scores: exchanges their confidence, parents a share of their size


def plain(spark, sf_dir, made=None):
    exp, seg, qa = made or layers(spark, sf_dir)
    key = F.col("conv_id").alias("query_id")
    return (
        exp.select(key, "experience_id", (F.col("n_qas") % 7 / 7).alias("score")),
        seg.select(key, "segment_id", "experience_id", (F.col("n_qas") % 5 / 5).alias("score")),
        qa.select(key, "qa_id", "segment_id", F.col("confidence").alias("score"), "seq"),
    )


_PLAIN = """, px AS (SELECT conv_id AS query_id, experience_id, (count(*) % 7) / 7.0 AS score FROM qa GROUP BY conv_id, experience_id), ps AS (SELECT conv_id AS query_id, segment_id, experience_id, (n_qas % 5) / 5.0 AS score FROM seg),
pq AS (SELECT conv_id AS query_id, qa_id, segment_id, experience_id, confidence AS score, seq FROM qa)"""
_PATHS = """, sp AS (SELECT ps.*, round(least(1.0, 0.7 * b + 0.3 * ps.score), 9) AS path, b FROM ps JOIN (SELECT segment_id, max(score) AS b FROM pq GROUP BY ALL) USING (segment_id)),
xp AS (SELECT px.*, round(least(1.0, 0.6 * m + 0.3 * w + 0.1 * px.score), 9) AS branch FROM px JOIN (SELECT experience_id, max(b) AS m, max(path) AS w FROM sp GROUP BY ALL) USING (experience_id)),
x1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY branch DESC, experience_id) AS rank FROM xp QUALIFY rank <= 2),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path DESC, segment_id) AS rank FROM sp SEMI JOIN x1 USING (query_id, experience_id) QUALIFY rank <= 3),
q1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, qa_id) AS rank FROM pq SEMI JOIN s1 USING (query_id, segment_id) QUALIFY rank <= 4)"""
_UNION = "SELECT query_id, experience_id AS id, rank FROM x1 UNION ALL SELECT query_id, segment_id, rank FROM s1 UNION ALL SELECT query_id, qa_id, rank FROM q1"


def _ids(exp, seg, qa, *more):
    return exp.select("query_id", F.col("experience_id").alias("id"), *more).union(seg.select("query_id", "segment_id", *more)).union(qa.select("query_id", "qa_id", *more))


_PATHS_LESS = _PATHS.replace("rank <= 3", "rank <= 2").replace("rank <= 4", "rank <= 2")


@query("g12_branch_pruning", MEMORY + _PLAIN + _PATHS + _UNION)
def g12(spark, sf_dir):
    return _ids(*R.select_top_down(*plain(spark, sf_dir), 2, 3, 4), "rank")


@query("g19_local_selection", MEMORY + _PLAIN + _PATHS_LESS + _UNION)
def g19(spark, sf_dir):
    """Used where an outside selection names no exchange."""
    return _ids(*R.select_top_down(*plain(spark, sf_dir), 2, 2, 2), "rank")


@query(
    "g21_stage_counts",
    MEMORY + _PLAIN + _PATHS + """SELECT query_id, 'candidates' AS stage, count(*) AS n FROM (SELECT query_id FROM px UNION ALL SELECT query_id FROM ps UNION ALL SELECT query_id FROM pq) GROUP BY query_id
    UNION ALL SELECT query_id, 'selected', count(*) FROM (SELECT query_id FROM x1 UNION ALL SELECT query_id FROM s1 UNION ALL SELECT query_id FROM q1) GROUP BY query_id""",
)
def g21b(spark, sf_dir):
    made = tuple(map(kept, plain(spark, sf_dir)))
    return R.stage_counts({"candidates": _ids(*made), "selected": _ids(*R.select_top_down(*made, 2, 3, 4))})


_PART = ", ax AS (SELECT * FROM px WHERE experience_id NOT LIKE '%_2'), asg AS (SELECT * FROM ps WHERE segment_id NOT LIKE '%_1_2'), aq AS (SELECT * FROM pq WHERE seq % 3 > 0)"


def _partial(spark, sf_dir, made=None):
    exp, seg, qa = plain(spark, sf_dir, made)
    return exp.where("experience_id NOT LIKE '%_2'"), seg.where("segment_id NOT LIKE '%_1_2'"), qa.where("seq % 3 > 0")


@query(
    "g9_orphans_pruned",
    MEMORY + _PLAIN + _PART + """, s2 AS (SELECT * FROM asg SEMI JOIN ax USING (query_id, experience_id)), q2 AS (SELECT * FROM aq SEMI JOIN s2 USING (query_id, segment_id)), s3 AS (SELECT * FROM s2 SEMI JOIN q2 USING (query_id, segment_id)), x3 AS (SELECT * FROM ax SEMI JOIN s3 USING (query_id, experience_id))
    SELECT query_id, experience_id AS id FROM x3 UNION ALL SELECT query_id, segment_id FROM s3 UNION ALL SELECT query_id, qa_id FROM q2""",
)
def g9(spark, sf_dir):
    return _ids(*R.prune_orphans(*_partial(spark, sf_dir)))


@query(
    "g10_ancestors_completed",
    MEMORY + _PLAIN + _PART + """, s2 AS (SELECT query_id, segment_id, experience_id FROM asg UNION SELECT query_id, segment_id, experience_id FROM aq), x2 AS (SELECT query_id, experience_id FROM ax UNION SELECT query_id, experience_id FROM s2)
    SELECT query_id, experience_id AS id FROM x2 UNION ALL SELECT query_id, segment_id FROM s2 UNION ALL SELECT query_id, qa_id FROM aq""",
)
def g10(spark, sf_dir):
    made = layers(spark, sf_dir)
    exp, seg, qa = map(kept, _partial(spark, sf_dir, made))
    return _ids(*map(kept, R.complete_ancestors(exp, seg, qa, made[1], made[0])))


@query(
    "g20_coherent_selection",
    MEMORY + _PLAIN + _PART + ", s3 AS (SELECT * FROM asg SEMI JOIN aq USING (query_id, segment_id)) SELECT query_id, experience_id AS id FROM ax SEMI JOIN s3 USING (query_id, experience_id) UNION ALL SELECT query_id, segment_id FROM s3",
)
def g20(spark, sf_dir):
    exp, seg = R.cohere(*_partial(spark, sf_dir))
    return exp.select("query_id", F.col("experience_id").alias("id")).union(seg.select("query_id", "segment_id"))


_CH = "SELECT conv_id AS query_id, qa_id AS id, seq AS updated_at, CASE WHEN seq % 3 > 0 THEN confidence ELSE 0.0 END AS v, CASE WHEN seq % 4 > 0 THEN (length(user_input) % 7) / 7.0 ELSE 0.0 END AS k, confidence AS score FROM qa"


@query(
    "g11_fused_channels",
    MEMORY + f""", c AS ({_CH}), r AS (SELECT *, CASE WHEN v > 0 THEN row_number() OVER (PARTITION BY query_id, v > 0 ORDER BY round(v, 9) DESC, id) END AS vr, CASE WHEN k > 0 THEN row_number() OVER (PARTITION BY query_id, k > 0 ORDER BY round(k, 9) DESC, id) END AS kr FROM c),
    f AS (SELECT *, round(least(1.0, 0.75 * (0.5 * coalesce(61.0 / (60 + vr), 0) + 0.5 * coalesce(61.0 / (60 + kr), 0)) + 0.25 * score), 9) AS final FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN vr <= 1 THEN vr WHEN kr <= 1 THEN 1 + kr ELSE 3 END, final DESC, updated_at DESC, id) AS pl FROM f)
    SELECT query_id, id, round(final, 6) AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM p WHERE pl <= 4""",
)
def g11(spark, sf_dir):
    qa = exchanges(spark, sf_dir)
    rows = qa.select(
        F.col("conv_id").alias("query_id"), F.col("qa_id").alias("id"), F.col("seq").alias("updated_at"), F.when(F.col("seq") % 3 > 0, F.col("confidence")).otherwise(0.0).alias("vector_channel"),
        F.when(F.col("seq") % 4 > 0, F.length("user_input") % 7 / 7).otherwise(0.0).alias("keyword_channel"), F.col("confidence").alias("score"),
    )
    return R.fuse_channels(rows, 4).select("query_id", "id", F.round("final_score", 6).alias("final_score"), "rank")


@query(
    "g13_diversified",
    MEMORY + _PLAIN + """SELECT query_id, qa_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY again, score DESC, qa_id) AS rank FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, segment_id ORDER BY score DESC, qa_id) > 1 THEN 1 ELSE 0 END AS again FROM pq)) WHERE rank <= 4""",
)
def g13(spark, sf_dir):
    return R.diversified(plain(spark, sf_dir)[2], "segment_id", "qa_id", 4).select("query_id", "qa_id", "rank")


def _trees(spark, sf_dir):
    made = layers(spark, sf_dir)
    exp, seg, qa = plain(spark, sf_dir, made)
    return R.candidate_tree(exp, seg, qa.drop("seq"), *made)


@query(
    "g14_candidate_trees",
    MEMORY + _PLAIN + """, te AS (SELECT query_id, experience_id, round(score, 4) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, experience_id) - 1 AS p FROM px),
    ts AS (SELECT query_id, experience_id, segment_id, round(score, 4) AS s, row_number() OVER (PARTITION BY query_id, experience_id ORDER BY round(score, 9) DESC, segment_id) - 1 AS p FROM ps),
    tq AS (SELECT query_id, segment_id, qa_id, round(score, 4) AS s, row_number() OVER (PARTITION BY query_id, segment_id ORDER BY round(score, 9) DESC, qa_id) - 1 AS p FROM pq)
    SELECT te.query_id, experience_id, te.s AS experience_score, te.p AS experience_place, segment_id, ts.s AS segment_score, ts.p AS segment_place, tq.qa_id, tq.s AS qa_score, tq.p AS qa_place, topic, trim(user_input) AS user_input, summary
    FROM te JOIN ts USING (query_id, experience_id) JOIN tq USING (query_id, segment_id) JOIN (SELECT qa_id, topic, CASE WHEN length(trim(user_input, ' ' || chr(9) || chr(10) || chr(13))) <= 320 THEN trim(user_input, ' ' || chr(9) || chr(10) || chr(13)) ELSE rtrim(substr(trim(user_input, ' ' || chr(9) || chr(10) || chr(13)), 1, 320), ' ' || chr(9) || chr(10) || chr(13)) || '...' END AS user_input FROM qa) USING (qa_id)
    JOIN (SELECT segment_id, summary FROM segsum) USING (segment_id)""",
)
def g14(spark, sf_dir):
    """The trees, a row for each leaf with its path, places, scores and texts."""
    e = _trees(spark, sf_dir).select("query_id", F.posexplode("tree").alias("experience_place", "e"))
    s = e.select("query_id", "experience_place", "e", F.posexplode("e.segments").alias("segment_place", "s"))
    q = s.select("query_id", "experience_place", "segment_place", "e", "s", F.posexplode("s.qas").alias("qa_place", "q"))
    return q.select(
        "query_id", F.col("e.id").alias("experience_id"), F.col("e.local_score").alias("experience_score"), "experience_place", F.col("s.id").alias("segment_id"), F.col("s.local_score").alias("segment_score"), "segment_place",
        F.col("q.id").alias("qa_id"), F.col("q.local_score").alias("qa_score"), "qa_place", "e.topic", "q.user_input", "s.summary",
    )


@query(
    "g15_tree_violations",
    MEMORY + """SELECT conv_id AS query_id, 'qa' AS level, CASE conv_id % 3 WHEN 0 THEN 'twice' ELSE ' ' END AS id, CASE conv_id % 3 WHEN 0 THEN 'repeated id' ELSE 'blank id' END AS problem FROM qa WHERE conv_id % 3 < 2 GROUP BY conv_id HAVING count(*) > 1 OR conv_id % 3 = 1
    UNION ALL SELECT conv_id, 'segment', segment_id, 'no children' FROM seg WHERE conv_id % 3 = 2""",
)
def g15(spark, sf_dir):
    """Violations in trees whose exchanges all got one id, or a blank one, or were taken out."""
    t, k = _trees(spark, sf_dir), F.col("query_id") % 3

    def spoilt(qas):
        renamed = F.transform(qas, lambda q: q.withField("id", F.when(k == 0, F.lit("twice")).otherwise(F.lit(" "))))
        return F.when(k < 2, renamed).otherwise(F.slice(qas, 1, 0))

    wrong = F.transform("tree", lambda e: e.withField("segments", F.transform(e["segments"], lambda s: s.withField("qas", spoilt(s["qas"])))))
    return R.tree_violations(kept(t.withColumn("tree", wrong)))


# -- fitting in SQL: what is removed is a prefix of an order, found by running sums of sizes. Texts aren't cut, which no tree of
#    the given tables needs at 700 tokens.

_WHITE = "' ' || chr(9) || chr(10) || chr(13)"


def _bytes(x: str) -> str:
    return f"strlen(CAST(to_json({x}) AS VARCHAR))"


def _unit(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def _segment_score(own: str, local: str) -> str:
    return _unit(f"0.65 * {own}[1] + 0.20 * (list_sum({own}[1:3]) / len({own}[1:3])) + 0.15 * {local}")


def _experience_score(own: str, local: str) -> str:
    return _unit(f"0.60 * {own}[1] + 0.25 * (list_sum({own}[1:2]) / len({own}[1:2])) + 0.15 * {local}")


def _grown(n: int, leaves: str) -> str:
    """``g<n>`` segments and ``h<n>`` experiences of the leaves that are left, in the order of the first scores, with their scores now."""
    place = "" if n == 0 else "JOIN g0 AS z USING (query_id, segment_id)"
    above = "" if n == 0 else "JOIN h0 AS z USING (query_id, experience_id)"
    first = "w.sc" if n == 0 else "z.sc"
    return f""", w{n} AS (SELECT query_id, experience_id, segment_id, list(l ORDER BY l DESC) AS own, list(node ORDER BY l DESC, qa_id) AS qas FROM {leaves} GROUP BY ALL),
    g{n} AS (SELECT w.query_id, w.experience_id, w.segment_id, w.sc, {first} AS sc0, {{'id': w.segment_id, 'intent': w.intent, 'summary': w.summary, 'qas': w.qas, 'local_score': w.l}} AS node
        FROM (SELECT *, {_segment_score('own', 'l')} AS sc FROM w{n} JOIN segs USING (query_id, segment_id)) AS w {place}),
    v{n} AS (SELECT query_id, experience_id, list(sc ORDER BY sc DESC) AS own, list(node ORDER BY sc0 DESC, segment_id) AS segments FROM g{n} GROUP BY ALL),
    h{n} AS (SELECT w.query_id, w.experience_id, w.sc, {first} AS sc0, len(w.segments) AS n_segments, {{'id': w.experience_id, 'topic': w.topic, 'core_entity': w.core_entity, 'intents': w.intents, 'summary': w.summary, 'segments': w.segments, 'local_score': w.l}} AS node
        FROM (SELECT *, {_experience_score('own', 'l')} AS sc FROM v{n} JOIN exps USING (query_id, experience_id)) AS w {above})"""


def _size(n: int) -> str:
    return f", t{n} AS (SELECT query_id, to_json(list(node ORDER BY sc0 DESC, experience_id)) AS tree, {_bytes('list(node ORDER BY sc0 DESC, experience_id)')} AS total, count(*) AS n_exp, sum(n_segments) AS n_seg FROM h{n} GROUP BY query_id)"


def _removed(name: str, rows: str, n: int, id_col: str, score: str, spared: str, most: str, budget: int = 700) -> str:
    """Rows of ``rows`` that go, the lowest score first, while the tree is too large; ``spared`` are never taken, nor more than ``most``."""
    return f""", {name} AS (SELECT query_id, {id_col}, nth FROM (
        SELECT *, row_number() OVER o AS nth, total - coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT *, {_bytes('node')} + 1 AS size, {spared} AS spared FROM {rows}) JOIN (SELECT query_id, total, n_exp, n_seg FROM t{n}) USING (query_id) WHERE NOT spared WINDOW o AS (PARTITION BY query_id ORDER BY {score}, {id_col}))
        WHERE before > {3 * budget} AND nth <= {most})"""


_LAST = "row_number() OVER (PARTITION BY query_id, {} ORDER BY {} DESC, {} DESC) = 1"
FITTED = MEMORY + _PLAIN + f""", leaves AS (SELECT query_id, experience_id, segment_id, qa_id, round(score, 4) AS l, {{'id': qa_id, 'user_input': u, 'assistant_output': '', 'local_score': round(score, 4)}} AS node FROM pq JOIN (
        SELECT qa_id, CASE WHEN length(u) <= 320 THEN u ELSE rtrim(substr(u, 1, 320), {_WHITE}) || '...' END AS u FROM (SELECT qa_id, trim(user_input, {_WHITE}) AS u FROM qa)) USING (qa_id)),
    segs AS (SELECT query_id, ps.segment_id, segsum.intent, summary, round(score, 4) AS l FROM ps JOIN segsum ON segsum.conv_id = query_id AND segsum.segment_id = ps.segment_id),
    said AS (SELECT experience_id, list(intent ORDER BY f) AS intents FROM (SELECT experience_id, intent, min(seq) AS f FROM qa GROUP BY ALL) GROUP BY ALL),
    exps AS (SELECT query_id, px.experience_id, topic, core_entity, intents, n || ' segments; intents: ' || array_to_string(intents, ', ') || '; last: ' || last AS summary, round(score, 4) AS l FROM px JOIN said USING (experience_id)
        JOIN (SELECT experience_id, arg_min(topic, seq) AS topic, arg_min(core_entity, seq) AS core_entity FROM qa GROUP BY ALL) USING (experience_id) JOIN (SELECT experience_id, count(*) AS n, arg_max(summary, created_at) AS last FROM segsum GROUP BY ALL) USING (experience_id))
    """ + _grown(0, "leaves") + _size(0) + _removed("gone_q", "leaves", 0, "qa_id", "l", _LAST.format("segment_id", "l", "qa_id"), "1000000") + ", left1 AS (SELECT * FROM leaves ANTI JOIN gone_q USING (query_id, qa_id))" \
    + _grown(1, "left1") + _size(1) + _removed("gone_s", "g1", 1, "segment_id", "sc", _LAST.format("experience_id", "sc", "segment_id"), "n_seg - 2") + ", left2 AS (SELECT * FROM left1 ANTI JOIN gone_s USING (query_id, segment_id))" \
    + _grown(2, "left2") + _size(2) + _removed("gone_x", "h2", 2, "experience_id", "sc", "false", "least(n_exp, n_seg) - 2") + ", left3 AS (SELECT * FROM left2 ANTI JOIN gone_x USING (query_id, experience_id))" \
    + _grown(3, "left3") + _size(3) + """
    SELECT query_id, CAST(t3.tree AS VARCHAR) AS tree, CAST(ceil(t0.total / 3) AS INT) AS tokens_before, CAST(ceil(t3.total / 3) AS INT) AS tokens_after, t3.total > 2100 AS overflow, coalesce(rq, []) AS removed_qa, coalesce(rs, []) AS removed_segments, coalesce(rx, []) AS removed_experiences, 0 AS clipped
    FROM t0 JOIN t3 USING (query_id) LEFT JOIN (SELECT query_id, list(qa_id ORDER BY nth) AS rq FROM gone_q GROUP BY ALL) USING (query_id) LEFT JOIN (SELECT query_id, list(segment_id ORDER BY nth) AS rs FROM gone_s GROUP BY ALL) USING (query_id)
    LEFT JOIN (SELECT query_id, list(experience_id ORDER BY nth) AS rx FROM gone_x GROUP BY ALL) USING (query_id)"""


@query("g16_fitted_trees", FITTED)
def g16(spark, sf_dir):
    """Trees fitted to 700 tokens."""
    return budget.fit_trees(_trees(spark, sf_dir).select("query_id", F.to_json("tree").alias("tree")), budget=700)


@query("g17_fitted_branches")
def g17(spark, sf_dir):
    """The older policy on the same trees: what remains of each."""
    import json

    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(q, *(lambda r: (len(r[0]), r[1]["tokens_after"], r[1]["context_overflow_unresolved"]))(budget.fit_branches(json.loads(t), 700, 1))) for q, t in zip(frame["query_id"], frame["tree"], strict=True)]
            yield pd.DataFrame(rows, columns=["query_id", "n_experiences", "tokens_after", "overflow"])

    trees = _trees(spark, sf_dir).select("query_id", F.to_json("tree").alias("tree"))
    return trees.mapInPandas(run, "query_id long, n_experiences int, tokens_after int, overflow boolean")


@query(
    "g18_applied_selection",
    MEMORY + """SELECT conv_id AS query_id, experience_id AS id FROM (SELECT DISTINCT conv_id, experience_id FROM qa WHERE exp_no = 1)
    UNION ALL SELECT conv_id, segment_id FROM (SELECT DISTINCT conv_id, segment_id FROM qa WHERE exp_no = 1 AND seg_no = 1)
    UNION ALL SELECT conv_id, arg_min(qa_id, seq) FROM qa WHERE exp_no = 1 AND seg_no = 1 GROUP BY conv_id""",
)
def g18(spark, sf_dir):
    """A selection that names the first path twice, a path that doesn't exist and a segment below the wrong experience."""
    exp, seg, qa = plain(spark, sf_dir)
    first = qa.where("segment_id LIKE '%_1_1'").groupBy("query_id").agg(F.min_by("qa_id", "seq").alias("leaf"), F.min("segment_id").alias("s"))
    e = F.regexp_replace(F.regexp_replace("s", "^seg", "exp"), "_1$", "")
    good = F.struct(e.alias("id"), F.array(F.struct(F.col("s").alias("id"), F.array(F.struct(F.col("leaf").alias("id")), F.struct(F.lit("no").alias("id"))).alias("qas"))).alias("segments"))
    wrong = F.struct(F.lit("exp_none").alias("id"), good["segments"].alias("segments"))
    return _ids(*R.apply_selection(first.select("query_id", F.array(wrong, good, good).alias("experiences")), exp, seg, qa, 2, 3, 4))


@query("g21_source_counts", MEMORY + f", {_Q}, {_EXP} SELECT query_id, 'experience_relational' AS source, count(*) AS n FROM q0 JOIN ex ON conv_id = qc WHERE topic = qt OR core_entity = qe GROUP BY query_id")
def g21(spark, sf_dir):
    """Sources of roots that relational recall alone has found."""
    q, (exp, _, _) = asked(spark, sf_dir), layers(spark, sf_dir)
    none = q.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("similarity")).where("false")
    return R.source_counts(R.roots(q, exp, none, keep=50, limit=50))


@query(
    "g22_reused_results",
    MEMORY + f""", {_Q}, {_EXP} SELECT query_id, level, id FROM (SELECT query_id, 'experience' AS level, experience_id AS id FROM q0 JOIN ex ON conv_id = qc AND topic = qt AND core_entity = qe
    UNION ALL SELECT DISTINCT query_id, 'segment', segment_id FROM q0 JOIN qa ON conv_id = qc AND topic = qt AND core_entity = qe AND intent = qi)""",
)
def g22(spark, sf_dir):
    q, qa = asked(spark, sf_dir).withColumn("state_key", F.col("conv_id")), exchanges(spark, sf_dir)
    cache = qa.groupBy(F.col("conv_id").alias("state_key"), "topic", "core_entity", "intent").agg(F.collect_set("experience_id").alias("experience_ids"), F.collect_set("segment_id").alias("segment_ids"))
    return R.reused(q, cache)


# -- end to end, with vectors


def vector_hits(queries, rows, id_col, text, limit, embed: Embed = embed_once):
    """Nearest rows of the query's own conversation, by hashed embeddings unless another embedder is given."""
    q = embed(queries.select("conv_id", "query_id", "question"), "question", "query")
    i = embed(rows.select("conv_id", F.col(id_col).alias("id"), text.alias("text")), "text", "embedding")
    return scoped_top_k(q.select("query_id", "query"), q.select("query_id", "conv_id"), i.select("id", "conv_id", "embedding"), limit, "conv_id")


def scoped_hits(queries, scope, rows, id_col, parent, text, limit, embed: Embed = embed_once):
    q = embed(queries.select("query_id", "question"), "question", "query")
    i = embed(rows.select(F.col(id_col).alias("id"), parent, text.alias("text")), "text", "embedding")
    return scoped_top_k(q, scope.select("query_id", parent), i, limit, parent)


def with_units(queries, seg, qa):
    """Segments and exchanges with the units that these queries ask for, taken apart once."""
    return kept(R.with_units(seg, "segment", queries)), kept(R.with_units(qa, "qa", queries))


def descended(queries, exp, seg, qa, embed: Embed = embed_once):
    """Roots by vector and relational recall, and what stands below them, scored with scoped vector hits."""
    found = kept(R.roots(queries, exp, vector_hits(queries, exp, "experience_id", F.col("summary"), 12, embed)))
    seg_hits = scoped_hits(queries, found, seg, "segment_id", "experience_id", F.col("summary"), 32, embed)
    below = found.join(seg.select("segment_id", "experience_id"), "experience_id")
    qa_hits = scoped_hits(queries, below, qa, "qa_id", "segment_id", F.col("user_input"), 64, embed)
    return found, *R.descend(queries, found, seg, qa, seg_hits, qa_hits)


def recalled(queries, exp, seg, qa, token_budget: int = 30_000, n_exp: int = 2, n_seg: int = 3, n_qa: int = 8, embed: Embed = embed_once):
    """Roots, descendants, rescue, pruning, tree, budget, selection and context for each query."""
    seg, qa = with_units(queries, seg, qa)
    found, *below = descended(queries, exp, seg, qa, embed)
    segments, leaves = map(kept, below)
    every = R.rescue(queries, found, segments, leaves, exp, seg, qa, vector_hits(queries, qa, "qa_id", F.col("user_input"), 40, embed), step=kept)
    whole = tuple(map(kept, R.prune_orphans(*map(kept, every))))
    fitted = kept(budget.fit_trees(R.candidate_tree(*whole, exp, seg, qa).select("query_id", F.to_json("tree").alias("tree")), budget=token_budget))
    ids = "array<struct<id:string,segments:array<struct<id:string,qas:array<struct<id:string>>>>>>"
    left = fitted.select("query_id", F.explode(F.from_json("tree", ids)).alias("e"))
    left_seg = left.select("query_id", F.explode("e.segments").alias("s"))
    left_qa = left_seg.select("query_id", F.explode("s.qas").alias("q")).select("query_id", F.col("q.id").alias("qa_id"))
    part = (
        whole[0].join(left.select("query_id", F.col("e.id").alias("experience_id")), ["query_id", "experience_id"], "left_semi"),
        whole[1].join(left_seg.select("query_id", F.col("s.id").alias("segment_id")), ["query_id", "segment_id"], "left_semi"),
        whole[2].join(left_qa, ["query_id", "qa_id"], "left_semi"),
    )
    x, s, q = R.select_top_down(*part, n_exp, n_seg, n_qa)
    x, s = R.cohere(x, s, q)
    return x, s, q, fitted


@query("g7_descendants")
def g7(spark, sf_dir):
    q, (exp, seg, qa) = asking(spark, sf_dir), layers(spark, sf_dir)
    _, _, leaves = descended(q, exp, *with_units(q, seg, qa))
    return leaves.withColumn("score", F.round("score", 6))


@query(
    "g8_rescued_paths",
    MEMORY + f""", {_Q}, t AS (SELECT *, {s_terms(_KW)} AS terms FROM q0 WHERE qconf < 0.8), m AS (SELECT query_id, qa_id, segment_id, experience_id FROM t JOIN qa ON conv_id = qc
    WHERE topic = qt OR core_entity = qe OR len(list_intersect(list_transform(entities, lambda e: lower(e)), list_transform(qents, lambda e: lower(e)))) > 0
    OR len(list_filter(terms, lambda x: contains(lower(user_input || ' ' || assistant_output || ' ' || intent), x))) > 0)
    SELECT DISTINCT query_id, unnest([qa_id, segment_id, experience_id]) AS id FROM m""",
)
def g8(spark, sf_dir):
    """Rescue alone: no roots, no vector hits; what relational search finds, with its ancestors."""
    q, (exp, seg, qa) = asking(spark, sf_dir), layers(spark, sf_dir)
    tags = F.array().cast("array<string>")
    none = [kept(df.withColumn("sources", tags).where("false")) for df in plain(spark, sf_dir, (exp, seg, qa))]
    hits = q.select("query_id", F.lit("").alias("id"), F.lit(0.0).alias("similarity")).where("false")
    found = R.rescue(q, none[0], none[1], none[2].drop("seq"), exp, seg, qa, hits, step=kept)
    return _ids(*found)


@query("g23_recall")
def g23(spark, sf_dir):
    q, frames = asking(spark, sf_dir), layers(spark, sf_dir)
    _, _, leaves, fitted = recalled(q, *frames)
    order = F.transform(F.array_sort(F.collect_list(F.struct("rank", "qa_id"))), lambda s: s["qa_id"])
    return leaves.groupBy("query_id").agg(order.alias("qa_ids")).join(fitted.select("query_id", "tokens_after", "overflow"), "query_id")


class Recall:
    """The hierarchical recall as a memory method. Questions carry the turn's fields, of which topic records are made."""

    name = "recall"

    def __init__(self, n_qa: int = 5, token_budget: int = 30_000):
        self.n_qa, self.token_budget = n_qa, token_budget

    def build(self, rows):
        self.memory = layers_of(kept(hierarchy.exact_topic_memory(records_of(rows))))

    def retrieve(self, questions):
        about = records_of(questions.select("conv_id", "turn_ord", "dia_id", "speaker", F.col("question").alias("text")))
        q = kept(R.prepared(about.select(query_id(), "conv_id", "topic", "core_entity", "intent", "entities", "confidence", F.col("user_input").alias("question"))))
        _, _, leaves, _ = recalled(q, *self.memory, token_budget=self.token_budget, n_qa=self.n_qa)
        rows = leaves.select("query_id", "qa_id", "rank").join(self.memory[2].select("qa_id", "dia_id", "user_input"), "qa_id")
        r = F.array_sort(F.collect_list(F.struct("rank", "dia_id", "user_input")))
        return rows.groupBy("query_id").agg(r.alias("r")).select("query_id", F.col("r.dia_id").alias("retrieved_ids"), F.array_join("r.user_input", "\n").alias("context"))


@query("h18_compared_memories")
def h18b(spark, sf_dir):
    """Six memory methods asked by every turn for itself and the turn after it: means at 1, 3 and 5."""
    rows = kept(turns(spark, sf_dir))
    own = [F.concat(F.lit("D1:"), (F.col("turn_ord") + d).cast("string")) for d in (1, 2)]
    questions = rows.select("conv_id", "turn_ord", "dia_id", "speaker", query_id(), F.col("text").alias("question"), F.array(*own).alias("evidence"))
    methods = [models.FullContext(), models.RecentTurns(5), models.FlatRetrieval(5), models.NoteSearch(5), models.Layers(records_of, 5, 3), Recall(5)]
    found = models.compare(methods, rows, questions).join(questions.select("query_id", "evidence"), "query_id")
    return evaluation.macro_average(evaluation.retrieval_scores(found.select("method", "query_id", "retrieved_ids", "evidence"), [1, 3, 5]), ["method"])


@query("g24_layered_recall")
def g24(spark, sf_dir):
    """The older recall, one layer at a time, completed and pruned."""
    return layered_recall(asking(spark, sf_dir), *layers(spark, sf_dir))


def layered_recall(q, exp, seg, qa, embed: Embed = embed_once):
    exp, (seg, qa) = kept(R.with_units(exp, "experience", q)), with_units(q, seg, qa)
    rows = [R.layered(q, m, level, vector_hits(q, m, R.LEVELS[level], text, 20, embed), n, step=kept).select("query_id", "id", F.col("final_score").alias("score"))
            for m, level, text, n in ((exp, "experience", F.col("summary"), 8), (seg, "segment", F.col("summary"), 20), (qa, "qa", F.col("user_input"), 32))]
    rows = [kept(r) for r in rows]
    e = rows[0].withColumnRenamed("id", "experience_id")
    s = rows[1].withColumnRenamed("id", "segment_id").join(seg.select("segment_id", "experience_id"), "segment_id")
    a = rows[2].withColumnRenamed("id", "qa_id").join(qa.select("qa_id", "segment_id"), "qa_id")
    return _ids(*R.select_top_down(*R.complete_ancestors(e, s, a, seg, exp), 8, 20, 32), F.col("rank"))

