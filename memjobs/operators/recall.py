"""Batch recall: a table of queries against memory tables, by relational, keyword and vector channels.

Every frame is keyed by ``query_id`` and memory ids; memory frames carry ``conv_id`` and all joins use it. An OR of
several keys is one equi-join for each key, united and added up. Ranks end with the id, so results don't depend on
how rows are partitioned.

Frames: queries (query_id, conv_id, topic, core_entity, intent, entities, confidence, question); experiences
(conv_id, experience_id, topic, core_entity, intents_link, summary, updated_at, created_at); segments (conv_id,
segment_id, experience_id, topic, core_entity, intent, summary, status, updated_at); qa (conv_id, qa_id, segment_id,
topic, core_entity, intent, entities, user_input, assistant_output, status, confidence, seq); hits (query_id, id,
similarity).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import render
from memjobs.functions import text as X

RRF = 60.0
LEVELS = {"experience": "experience_id", "segment": "segment_id", "qa": "qa_id"}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def first(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def rrf(rank: Column) -> Column:
    """61 / (60 + rank), 0 without a rank."""
    return F.coalesce((RRF + 1) / (RRF + rank), F.lit(0.0))


def matches(queries: DataFrame, rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """query_id, id, n_matches: how many of the fields are equal, for rows with at least one. One equi-join a field."""
    parts = []
    for field in fields:
        asked = queries.where(~X.blank(F.col(field))).select("query_id", "conv_id", F.trim(field).alias("value"))
        if field == "intent" and "intents_link" in rows.columns:
            given = rows.select("conv_id", F.col(id_col).alias("id"), F.explode(F.array_distinct("intents_link")).alias("value"))
        else:
            given = rows.select("conv_id", F.col(id_col).alias("id"), F.col(field).alias("value"))
        parts.append(asked.join(given, ["conv_id", "value"]).select("query_id", "id"))
    return reduce(DataFrame.union, parts).groupBy("query_id", "id").agg(F.count("*").alias("n_matches"))


def relational(queries: DataFrame, rows: DataFrame, id_col: str, fields: list[str], limit: int) -> DataFrame:
    """The rows with the most matching fields, then the newest, then by id."""
    found = matches(queries, rows, id_col, fields).join(rows.select(F.col(id_col).alias("id"), "updated_at"), "id")
    return first(found, ["query_id"], [F.desc("n_matches"), F.desc("updated_at"), F.col("id")], limit)


def searchable(rows: DataFrame, level: str) -> Column:
    """The text that keyword recall looks at, in lower case."""
    names = {"experience": ["topic", "core_entity", "intents_link", "summary"], "segment": ["topic", "core_entity", "intent", "summary"],
             "qa": ["topic", "core_entity", "intent", "user_input", "assistant_output", "entities"]}[level]
    kinds = dict(rows.dtypes)
    return F.lower(F.concat_ws(" ", *(F.array_join(n, " ") if kinds[n].startswith("array") else F.col(n) for n in names)))


#: Characters of an index entry; terms of fewer characters look up entries of their own length.
GRAM = 3
Step = Callable[[DataFrame], DataFrame]


def as_is(rows: DataFrame) -> DataFrame:
    return rows


def _entries(term: Column, gram: int) -> Column:
    """The entries among which a term chooses: its first, middle and last gram, or a short term itself."""
    n = F.length(term)
    places = (F.lit(1), F.floor((n - gram) / 2).cast("int") + 1, n - gram + 1)
    return F.when(n >= gram, F.array_distinct(F.array(*(F.substring(term, p, F.lit(gram)) for p in places)))).otherwise(F.array(term))


def keyword_candidates(asked: DataFrame, given: DataFrame, gram: int = GRAM, step: Step = as_is) -> DataFrame:
    """(query_id, conv_id, id, terms): rows whose text may contain one of the terms, by an inverted index of character n-grams.

    ``asked`` (query_id, conv_id, terms), ``given`` (conv_id, id, text). A text that contains a term has all of its grams,
    so a term looks up only the rarest of three of them in its conversation, by an equi-join; a term with a gram that no text
    has is dropped. The index lists the grams that some query of the conversation asks for, so a text makes one row for each
    of these that it has. Without false negatives; the texts are still to be compared with the ``terms`` that led to them.
    ``step`` may write the index, which is read twice, and return it as read again.
    """
    each = asked.select("query_id", "conv_id", F.explode("terms").alias("term"))
    pieces = each.withColumn("piece", F.explode(_entries(F.col("term"), gram)))
    wanted = pieces.groupBy("conv_id").agg(F.collect_set("piece").alias("wanted"), F.collect_set(F.length("piece")).alias("sizes"))  # distinct grams, however many queries
    met = given.join(wanted, "conv_id")
    own = F.flatten(F.array(*(F.when(F.array_contains("sizes", n), X.grams(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1))))
    index = step(met.select("conv_id", "id", F.explode(F.array_intersect(own, F.col("wanted"))).alias("piece")))
    counts = index.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    known = pieces.join(counts, ["conv_id", "piece"], "left")
    rarest = known.groupBy("query_id", "conv_id", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("piece"))).alias("r")).where("r.n > 0")
    found = rarest.select("query_id", "conv_id", "term", F.col("r.piece").alias("piece")).join(index, ["conv_id", "piece"])
    return found.groupBy("query_id", "conv_id", "id").agg(F.collect_set("term").alias("terms"))


#: Conversations of at most so many rows are compared whole: the rows that a query meets have this bound then.
WHOLE = 16


def keyword_hits(asked: DataFrame, given: DataFrame, step: Step = as_is, whole: int = WHOLE) -> DataFrame:
    """(query_id, conv_id, id): rows whose text contains one of the terms.

    In conversations of more than ``whole`` rows candidates come from the index; in others an index would cost more than the
    few rows. Either way the same rows are found.
    """

    def told(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.exists("terms", lambda t: F.contains(F.col("text"), t))).select("query_id", "conv_id", "id")

    large = step(given.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("conv_id"))
    long, many = (df.join(large, "conv_id", "left_semi") for df in (given, asked))
    indexed = told(keyword_candidates(many, long, step=step).join(long.select("conv_id", "id", "text"), ["conv_id", "id"]))
    return told(asked.join(given.join(large, "conv_id", "left_anti"), "conv_id")).union(indexed) if whole else indexed


def keyword(queries: DataFrame, rows: DataFrame, level: str, limit: int, terms: Column | None = None, step: Step = as_is, whole: int = WHOLE) -> DataFrame:
    """Rows whose searchable text contains a keyword of the query; the newest first. Looked up in an index of n-grams."""
    id_col = LEVELS[level]
    if terms is None:
        queries, terms = prepared(queries), F.col("terms")
    asked = queries.select("query_id", "conv_id", terms.alias("terms")).where(F.size("terms") > 0)
    order = "seq" if level == "qa" else "updated_at"
    given = rows.where("status = 'active'") if "status" in rows.columns else rows
    given = given.select("conv_id", F.col(id_col).alias("id"), F.col(order).alias("updated_at"), searchable(rows, level).alias("text"))
    found = keyword_hits(step(asked), given, step, whole).join(given.select("conv_id", "id", "updated_at"), ["conv_id", "id"])
    return first(found.select("query_id", "id", "updated_at"), ["query_id"], [F.desc("updated_at"), F.col("id")], limit)


def keyword_text() -> Column:
    return render.keyword_query_text(*(F.col(c) for c in ("topic", "core_entity", "intent", "entities", "question")))


def hashes(units: Column) -> Column:
    """Units as 64-bit hashes: what is compared with many rows is short and compares fast."""
    return F.transform(units, lambda u: F.xxhash64(u))


def prepared(queries: DataFrame) -> DataFrame:
    """Queries with their keywords taken apart, once if the result is written: ``terms`` without the units of the query's own fields,
    ``wide_terms`` with them, and ``q_units``, the hashes of the units of ``terms``. Operators that need them add them if they aren't there."""
    if "q_units" in queries.columns:
        return queries
    fields = F.col("topic"), F.col("core_entity"), F.col("intent")
    rows = queries.withColumns({"terms": X.keyword_terms(keyword_text(), *fields), "wide_terms": X.keyword_terms(keyword_text())})
    return rows.withColumn("q_units", hashes(X.lexical_units(F.array_join("terms", " "))))


def with_units(memory: DataFrame, level: str, queries: DataFrame | None = None) -> DataFrame:
    """``memory`` with ``units``, the hashes of the units of its searchable text: a row's text is taken apart once, not once a pair.

    With ``queries``, only units that some query of the row's conversation asks for; the result is for these queries.
    """
    rows = memory.withColumn("units", hashes(X.lexical_units(searchable(memory, level))))
    if queries is None:
        return rows
    wanted = prepared(queries).select("conv_id", F.explode("q_units").alias("unit")).groupBy("conv_id").agg(F.collect_set("unit").alias("wanted"))
    met = F.array_intersect(F.coalesce("wanted", F.array().cast("array<bigint>")), "units")
    return rows.join(wanted, "conv_id", "left").withColumn("units", met).drop("wanted")


def qa_search(queries: DataFrame, qa: DataFrame, limit: int = 40, step: Step = as_is) -> DataFrame:
    """Active exchanges that share topic, core entity or an entity with the query, or contain a keyword; the newest first."""
    active = qa.where("status = 'active'")
    same = matches(queries, active, "qa_id", ["topic", "core_entity"]).select("query_id", "id")
    asked = queries.select("query_id", "conv_id", F.explode("entities").alias("e")).select("query_id", "conv_id", F.lower("e").alias("value"))
    given = active.select("conv_id", F.col("qa_id").alias("id"), F.explode("entities").alias("e")).select("conv_id", "id", F.lower("e").alias("value"))
    named = asked.join(given, ["conv_id", "value"]).select("query_id", "id")
    text = F.lower(F.concat_ws(" ", "user_input", "assistant_output", "intent"))
    terms = prepared(queries).select("query_id", "conv_id", F.col("wide_terms").alias("terms")).where(F.size("terms") > 0)
    told = keyword_hits(step(terms), active.select("conv_id", F.col("qa_id").alias("id"), text.alias("text")), step).select("query_id", "id")
    every = same.union(named).union(told).distinct().join(active.select(F.col("qa_id").alias("id"), F.col("seq").alias("updated_at")), "id")
    return first(every, ["query_id"], [F.desc("updated_at"), F.col("id")], limit)


def structure(topic: Column, core_entity: Column, intents: Column) -> Column:
    """Mean of the matches of topic, core entity and, if the query has one, intent. The query's fields are ``q_*``."""
    t = (F.trim(topic) == F.trim("q_topic")).cast("double")
    c = (F.trim(core_entity) == F.trim("q_core_entity")).cast("double")
    i = F.array_contains(F.transform(intents, lambda x: F.trim(x)), F.trim("q_intent")).cast("double")
    return F.coalesce(F.when(X.blank(F.col("q_intent")), (t + c) / 2).otherwise((t + c + i) / 3), F.lit(0.0))


def scored(rows: DataFrame, cached: Column | None = None) -> DataFrame:
    """``rows`` with ``structure_score`` given: adds the candidate score and the scores of both channels."""
    v, k, s = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("similarity", "keyword_score", "structure_score"))
    bonus = F.when(cached, 0.03).otherwise(0.0) if cached is not None else F.lit(0.0)
    return rows.withColumns(
        {
            "score": clamp(0.35 * v + 0.35 * k + 0.3 * s + bonus),
            "vector_channel": F.when(v > 0, clamp(0.75 * v + 0.25 * s)).otherwise(0.0),
            "keyword_channel": F.when(k > 0, clamp(0.75 * k + 0.25 * s)).otherwise(0.0),
        }
    )


def with_query(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The query's fields as ``q_*``, and the units of its keywords, taken apart before the join: once a query, not once a row."""
    fields = (F.col(c).alias(f"q_{c}") for c in ("topic", "core_entity", "intent", "entities", "question"))
    return rows.join(prepared(queries).select("query_id", *fields, "q_units"), "query_id")


def candidate(rows: DataFrame, memory: DataFrame, queries: DataFrame, level: str, keywords: bool = True) -> DataFrame:
    """(query_id, id, similarity) rows with their memory row, the structure and keyword scores and the candidate score."""
    id_col = LEVELS[level]
    if keywords and "units" not in memory.columns:
        memory = with_units(memory, level)
    joined = with_query(rows.join(memory.withColumnRenamed(id_col, "id"), "id"), queries)
    intents = F.col("intents_link") if level == "experience" else F.array("intent")
    joined = joined.withColumn("structure_score", structure(F.col("topic"), F.col("core_entity"), intents))
    joined = joined.withColumn("keyword_score", X.unit_overlap(F.col("q_units"), F.col("units")) if keywords else F.lit(0.0))
    out = scored(joined)
    if level == "qa":
        out = out.withColumn("score", clamp(0.95 * F.col("score") + 0.05 * F.coalesce("confidence", F.lit(0.0))))
    return out


def roots(queries: DataFrame, experiences: DataFrame, hits: DataFrame, keep: int = 8, limit: int = 12) -> DataFrame:
    """Experiences by fused ranks of vector and relational recall: 0.4 each, 0.2 the candidate score."""
    by_vector = first(hits, ["query_id"], [F.desc("similarity"), F.col("id")], limit, "vector_rank").select("query_id", "id", "similarity", "vector_rank")
    by_relation = relational(queries, experiences, "experience_id", ["topic", "core_entity"], limit).select("query_id", "id", F.col("rank").alias("relation_rank"), clamp(F.col("n_matches") / 2).alias("relation_score"))
    both = by_vector.join(by_relation, ["query_id", "id"], "full_outer")
    rows = candidate(both, experiences, queries, "experience", keywords=False)
    fused = rows.withColumn("score", clamp(0.4 * rrf(F.col("vector_rank")) + 0.4 * rrf(F.col("relation_rank")) + 0.2 * F.col("score")))
    tags = F.filter(F.array(F.when(F.col("vector_rank").isNotNull(), "experience_vector"), F.when(F.col("relation_rank").isNotNull(), "experience_relational")), lambda s: s.isNotNull())
    kept = first(fused.withColumn("sources", tags), ["query_id"], [F.desc(F.round("score", 9)), F.desc("updated_at"), F.col("id")], keep)
    return kept.select("query_id", F.col("id").alias("experience_id"), "score", "sources")


def descend(queries: DataFrame, found: DataFrame, segments: DataFrame, qa: DataFrame, segment_hits: DataFrame, qa_hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All live segments and exchanges below the roots, scored. Hits come from the scoped search."""
    below = found.select("query_id", "experience_id").join(segments.where("status <> 'deleted'").select("segment_id", "experience_id"), "experience_id")
    seg = below.select("query_id", F.col("segment_id").alias("id")).join(segment_hits.select("query_id", "id", "similarity"), ["query_id", "id"], "left")
    seg = candidate(seg, segments, queries, "segment")
    seg = seg.select("query_id", F.col("id").alias("segment_id"), "experience_id", "score", _tags(F.col("similarity"), "scoped_segment_vector").alias("sources"))
    leaves = below.select("query_id", "segment_id").join(qa.where("status = 'active'").select("segment_id", F.col("qa_id").alias("id")), "segment_id").select("query_id", "id")
    leaves = candidate(leaves.join(qa_hits.select("query_id", "id", "similarity"), ["query_id", "id"], "left"), qa, queries, "qa")
    return seg, leaves.select("query_id", F.col("id").alias("qa_id"), "segment_id", "score", _tags(F.col("similarity"), "scoped_qa_vector").alias("sources"))


def _tags(similarity: Column, name: str) -> Column:
    return F.when(similarity.isNotNull(), F.array(F.lit("initial_experience_descendant"), F.lit(name))).otherwise(F.array(F.lit("initial_experience_descendant")))


def rescue(
    queries: DataFrame, exp: DataFrame, seg: DataFrame, leaves: DataFrame, experiences: DataFrame, segments: DataFrame, qa: DataFrame, hits: DataFrame,
    below: float = 0.8, limit: int = 40, step: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For queries of low confidence: exchanges from the whole conversation, with only their own ancestors.

    A rescued exchange replaces one already there only with a higher score. ``step`` may write what later steps read
    several times and return it as read again.
    """
    unsure = queries.where(F.col("confidence") < below)
    by_vector = first(hits.join(unsure.select("query_id"), "query_id", "left_semi"), ["query_id"], [F.desc("similarity"), F.col("id")], limit).select("query_id", "id", "similarity")
    by_relation = qa_search(unsure, qa, limit, step).select("query_id", "id", F.lit(True).alias("related"))
    both = by_vector.join(by_relation, ["query_id", "id"], "full_outer")
    sources = F.filter(F.array(F.when(F.col("similarity").isNotNull(), "global_qa_vector"), F.when(F.col("related"), "global_qa_relational")), lambda s: s.isNotNull())
    new = candidate(both.withColumn("sources", sources), qa.where("status = 'active'"), queries, "qa").select("query_id", F.col("id").alias("qa_id"), "segment_id", "score", "sources", F.lit(1).alias("turn"))
    every = leaves.withColumn("turn", F.lit(0)).unionByName(new)
    best = Window.partitionBy("query_id", "qa_id").orderBy(F.desc(F.round("score", 12)), "turn")
    leaves = step(every.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "turn"))
    wanted = leaves.select("query_id", "segment_id").distinct().join(seg, ["query_id", "segment_id"], "left_anti")
    more = candidate(wanted.select("query_id", F.col("segment_id").alias("id"), F.lit(None).cast("double").alias("similarity")), segments.where("status <> 'deleted'"), queries, "segment")
    seg = step(seg.unionByName(more.select("query_id", F.col("id").alias("segment_id"), "experience_id", "score", F.array(F.lit("qa_rescue_ancestor")).alias("sources"))))
    wanted = seg.select("query_id", "experience_id").distinct().join(exp, ["query_id", "experience_id"], "left_anti")
    more = candidate(wanted.select("query_id", F.col("experience_id").alias("id"), F.lit(None).cast("double").alias("similarity")), experiences, queries, "experience", keywords=False)
    exp = exp.unionByName(more.select("query_id", F.col("id").alias("experience_id"), "score", F.array(F.lit("qa_rescue_ancestor")).alias("sources")))
    return exp, seg, leaves


def prune_orphans(exp: DataFrame, seg: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children need a parent, then parents need a child."""
    seg = seg.join(exp.select("query_id", "experience_id"), ["query_id", "experience_id"], "left_semi")
    qa = qa.join(seg.select("query_id", "segment_id"), ["query_id", "segment_id"], "left_semi")
    return *cohere(exp, seg, qa), qa


def cohere(exp: DataFrame, seg: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents that have a child."""
    seg = seg.join(qa.select("query_id", "segment_id").distinct(), ["query_id", "segment_id"], "left_semi")
    return exp.join(seg.select("query_id", "experience_id").distinct(), ["query_id", "experience_id"], "left_semi"), seg


def complete_ancestors(exp: DataFrame, seg: DataFrame, qa: DataFrame, segments: DataFrame, experiences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing parents of recalled rows, flagged ``added``; rows whose parents don't exist are dropped."""
    seg, exp = seg.withColumn("added", F.lit(False)), exp.withColumn("added", F.lit(False))
    missing = qa.select("query_id", "segment_id").distinct().join(seg, ["query_id", "segment_id"], "left_anti")
    more = missing.join(segments.select("segment_id", "experience_id"), "segment_id").select("query_id", "segment_id", "experience_id", F.lit(0.0).alias("score"), F.lit(True).alias("added"))
    seg = seg.select("query_id", "segment_id", "experience_id", "score", "added").unionByName(more)
    missing = seg.select("query_id", "experience_id").distinct().join(exp, ["query_id", "experience_id"], "left_anti")
    more = missing.join(experiences.select("experience_id"), "experience_id").select("query_id", "experience_id", F.lit(0.0).alias("score"), F.lit(True).alias("added"))
    exp = exp.select("query_id", "experience_id", "score", "added").unionByName(more)
    seg = seg.join(exp.select("query_id", "experience_id"), ["query_id", "experience_id"], "left_semi")
    return exp, seg, qa.join(seg.select("query_id", "segment_id"), ["query_id", "segment_id"], "left_semi")


def fuse_channels(rows: DataFrame, limit: int, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """Two ranked channels fused; the first third of each is sure of a place, the rest goes by the final score."""
    ranks = rows
    for channel in ("vector_channel", "keyword_channel"):
        w = Window.partitionBy(by, F.col(channel) > 0).orderBy(F.desc(F.round(channel, 9)), id_col)
        ranks = ranks.withColumn(f"{channel}_rank", F.when(F.col(channel) > 0, F.row_number().over(w)))
    v, k = F.col("vector_channel_rank"), F.col("keyword_channel_rank")
    fused = clamp(0.75 * (0.5 * rrf(v) + 0.5 * rrf(k)) + 0.25 * F.col("score"))
    quota = max(1, limit // 3)
    sure = F.when(v <= quota, v).when(k <= quota, quota + k).otherwise(2 * quota + 1)
    placed = ranks.withColumn("final_score", F.round(fused, 9)).withColumn("__sure", sure)
    kept = first(placed, [by], [F.col("__sure"), F.desc("final_score"), F.desc("updated_at"), F.col(id_col)], limit, "__place").drop("__sure", "__place")
    return first(kept, [by], [F.desc("final_score"), F.col(id_col)], limit)


def branch_scores(exp: DataFrame, seg: DataFrame, qa: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path`` of segments: 0.7 best exchange + 0.3 own; ``branch`` of experiences: 0.6 best exchange + 0.3 best path + 0.1 own."""
    best = qa.groupBy("query_id", "segment_id").agg(F.max("score").alias("best"))
    seg = seg.join(best, ["query_id", "segment_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    seg = seg.withColumn("path", F.round(clamp(0.7 * F.col("best") + 0.3 * F.col("score")), 9))
    above = seg.groupBy("query_id", "experience_id").agg(F.max("best").alias("top"), F.max("path").alias("way"))
    exp = exp.join(above, ["query_id", "experience_id"], "left")
    branch = clamp(0.6 * F.coalesce("top", F.lit(0.0)) + 0.3 * F.coalesce("way", F.lit(0.0)) + 0.1 * F.col("score"))
    return exp.withColumn("branch", F.round(branch, 9)).drop("top", "way"), seg.drop("best")


def select_top_down(exp: DataFrame, seg: DataFrame, qa: DataFrame, n_exp: int, n_seg: int, n_qa: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best branches, then the best paths in them, then the best exchanges in those."""
    exp, seg = branch_scores(exp, seg, qa)
    exp = first(exp, ["query_id"], [F.desc("branch"), F.col("experience_id")], n_exp)
    seg = first(seg.join(exp.select("query_id", "experience_id"), ["query_id", "experience_id"], "left_semi"), ["query_id"], [F.desc("path"), F.col("segment_id")], n_seg)
    qa = qa.join(seg.select("query_id", "segment_id"), ["query_id", "segment_id"], "left_semi")
    return exp, seg, first(qa, ["query_id"], [F.desc(F.round("score", 9)), F.col("qa_id")], n_qa)


def diversified(rows: DataFrame, parent: str, id_col: str, limit: int) -> DataFrame:
    """The best of each parent first, then the rest, both by score."""
    within = Window.partitionBy("query_id", parent).orderBy(F.desc("score"), id_col)
    placed = rows.withColumn("__again", (F.row_number().over(within) > 1).cast("int"))
    return first(placed, ["query_id"], [F.col("__again"), F.desc("score"), F.col(id_col)], limit).drop("__again")


def candidate_tree(exp: DataFrame, seg: DataFrame, qa: DataFrame, experiences: DataFrame, segments: DataFrame, exchanges: DataFrame) -> DataFrame:
    """One row for each query: experiences with their segments with their exchanges, each list by score."""
    def by_score(*columns):
        items = F.collect_list(F.struct((-F.round("score", 9)).alias("o"), F.col("id").alias("i"), F.struct("id", *columns, F.round("score", 4).alias("local_score")).alias("v")))
        return F.transform(F.array_sort(items), lambda s: s["v"])

    leaf = qa.join(exchanges.select("qa_id", X.truncated(F.col("user_input"), 320).alias("user_input"), X.truncated(F.col("assistant_output"), 240).alias("assistant_output")), "qa_id")
    leaves = leaf.withColumnRenamed("qa_id", "id").groupBy("query_id", "segment_id").agg(by_score("user_input", "assistant_output").alias("qas"))
    node = seg.join(leaves, ["query_id", "segment_id"]).join(segments.select("segment_id", "intent", "summary"), "segment_id")
    nodes = node.withColumnRenamed("segment_id", "id").groupBy("query_id", "experience_id").agg(by_score("intent", "summary", "qas").alias("segments"))
    top = exp.join(nodes, ["query_id", "experience_id"]).join(experiences.select("experience_id", "topic", "core_entity", F.col("intents_link").alias("intents"), "summary"), "experience_id")
    return top.withColumnRenamed("experience_id", "id").groupBy("query_id").agg(by_score("topic", "core_entity", "intents", "summary", "segments").alias("tree"))


def tree_violations(trees: DataFrame) -> DataFrame:
    """query_id, level, id, problem: blank ids, repeated ids, nodes without children."""
    exp = trees.select("query_id", F.explode("tree").alias("e"))
    seg = exp.select("query_id", F.explode("e.segments").alias("s"))
    qa = seg.select("query_id", F.explode("s.qas").alias("q"))
    every = (
        exp.select("query_id", F.lit("experience").alias("level"), F.col("e.id").alias("id"), F.size("e.segments").alias("n"))
        .union(seg.select("query_id", F.lit("segment"), "s.id", F.size("s.qas")))
        .union(qa.select("query_id", F.lit("qa"), "q.id", F.lit(1)))
    )
    counts = every.groupBy("query_id", "level", "id").agg(F.count("*").alias("times"), F.min("n").alias("n"))
    problem = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "blank id").when(F.col("times") > 1, "repeated id").when(F.col("n") < 1, "no children")
    return counts.withColumn("problem", problem).where("problem is not null").select("query_id", "level", "id", "problem")


def apply_selection(selection: DataFrame, exp: DataFrame, seg: DataFrame, qa: DataFrame, n_exp: int, n_seg: int, n_qa: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An outside selection (query_id, experiences: nested ids) applied to the candidates.

    Only ids that exist on the same path count; of repeated ones the first; limits hold in listed order.
    """
    listed = selection.select("query_id", F.posexplode("experiences").alias("p", "e")).select("query_id", "p", F.col("e.id").alias("experience_id"), F.col("e.segments").alias("s"))
    listed = listed.join(exp, ["query_id", "experience_id"])
    listed = first(first(listed, ["query_id", "experience_id"], [F.col("p")], 1, "m").drop("m"), ["query_id"], [F.col("p")], n_exp, "place")
    below = listed.select("query_id", "experience_id", F.col("place").alias("p1"), F.posexplode("s").alias("p2", "v")).select("query_id", "experience_id", "p1", "p2", F.col("v.id").alias("segment_id"), F.col("v.qas").alias("q"))
    below = below.join(seg, ["query_id", "segment_id", "experience_id"])
    below = first(first(below, ["query_id", "segment_id"], [F.col("p1"), F.col("p2")], 1, "m").drop("m"), ["query_id"], [F.col("p1"), F.col("p2")], n_seg, "place")
    leaf = below.select("query_id", "segment_id", F.col("place").alias("p1"), F.posexplode("q").alias("p2", "v")).select("query_id", "segment_id", "p1", "p2", F.col("v.id").alias("qa_id"))
    leaf = leaf.join(qa, ["query_id", "qa_id", "segment_id"])
    leaf = first(first(leaf, ["query_id", "qa_id"], [F.col("p1"), F.col("p2")], 1, "m").drop("m"), ["query_id"], [F.col("p1"), F.col("p2")], n_qa, "place")
    return listed.drop("s", "p"), below.drop("q", "p1", "p2"), leaf.drop("p1", "p2")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage for each query."""
    parts = [df.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(DataFrame.union, parts)


def source_counts(rows: DataFrame) -> DataFrame:
    """By which recall path rows were found."""
    return rows.select("query_id", F.explode("sources").alias("source")).groupBy("query_id", "source").agg(F.count("*").alias("n"))


def reused(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """(query_id, level, id) that a former result offers: experiences if topic and entity are equal, segments if the intent is too.

    ``cache`` (state_key, topic, core_entity, intent, experience_ids, segment_ids); queries have a ``state_key``.
    """
    key = ["state_key", "topic", "core_entity"]
    hit = queries.select("query_id", *key, F.col("intent").alias("asked")).join(cache, key)
    exp = hit.select("query_id", F.lit("experience").alias("level"), F.explode("experience_ids").alias("id"))
    return exp.union(hit.where(F.col("asked") == F.col("intent")).select("query_id", F.lit("segment"), F.explode("segment_ids").alias("id"))).distinct()


def layered(queries: DataFrame, memory: DataFrame, level: str, hits: DataFrame, limit: int, cached: DataFrame | None = None, step: Step = as_is) -> DataFrame:
    """The older global recall of one layer: relational, keyword, vector and cached rows, scored and fused."""
    id_col = LEVELS[level]
    rows = memory if "updated_at" in memory.columns else memory.withColumn("updated_at", F.col("seq"))
    ids = relational(queries, rows, id_col, ["topic", "core_entity", "intent"], limit).select("query_id", "id")
    ids = ids.union(keyword(queries, rows, level, limit, step=step).select("query_id", "id")).union(first(hits, ["query_id"], [F.desc("similarity"), F.col("id")], limit).select("query_id", "id"))
    if cached is not None:
        ids = ids.union(cached.where(F.col("level") == level).select("query_id", "id"))
    found = candidate(ids.distinct().join(hits.select("query_id", "id", "similarity"), ["query_id", "id"], "left"), rows, queries, level)
    return fuse_channels(found, limit)
