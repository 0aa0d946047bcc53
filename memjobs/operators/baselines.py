"""Plainer memory layouts to compare with: full context, flat turn vectors, linked notes, single layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import render
from memjobs.functions import text as X
from memjobs.functions.embed import Embed, embed_once
from memjobs.operators import hierarchy
from memjobs.operators.vectors import ranked, scoped_top_k


def full_context(turns: DataFrame) -> DataFrame:
    """All turns of a conversation as one text, with their ids. Built once for each conversation, joined where needed."""
    line = X.turn_text(F.col("speaker"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("session_num", "turn_ord", line.alias("line"), "dia_id")))
    found = turns.groupBy("conv_id").agg(rows.alias("r"))
    return found.select("conv_id", F.array_join(F.col("r.line"), "\n").alias("context"), F.filter(F.col("r.dia_id"), lambda d: d.isNotNull()).alias("dia_ids"))


def total_tokens(turns: DataFrame) -> DataFrame:
    """Words of the whole conversation, added up turn by turn (turns are joined by white space)."""
    n = X.word_count(X.turn_text(F.col("speaker"), F.col("text")))
    return turns.groupBy("conv_id").agg(F.sum(n).alias("total_tokens"))


def provenance(qa: DataFrame, keys: list[str]) -> DataFrame:
    """The first turn id of each exchange in order, and the number of distinct turn ids."""
    first = qa.select(*keys, "seq", F.try_element_at("dia_ids", F.lit(1)).alias("dia_id"), F.explode("dia_ids").alias("every"))
    return first.groupBy(*keys).agg(F.array_join(hierarchy.in_order("seq", "dia_id"), ",").alias("dia_ids"), F.countDistinct("every").alias("n_distinct"))


def _near(asked: DataFrame, items: DataFrame, k: int, embed: Embed) -> DataFrame:
    """Nearest items of a query's own conversation; ``items`` (conv_id, id, text)."""
    q = embed(asked.select("conv_id", "query_id", "question"), "question", "query")
    i = embed(items, "text", "embedding")
    found = scoped_top_k(q.select("query_id", "query"), q.select("query_id", "conv_id"), i.select("id", "conv_id", "embedding"), k, "conv_id")
    # ids are unique within a conversation
    documents = items.select("conv_id", "id", F.col("text").alias("document"))
    return found.join(asked.select("query_id", "conv_id"), "query_id").join(documents, ["conv_id", "id"]).select("query_id", "conv_id", "id", "document", "similarity", "rank")


def flat_retrieval(turns: DataFrame, asked: DataFrame, k: int, embed: Embed = embed_once) -> DataFrame:
    """The nearest turns of each question as ids and as one text, both in rank order."""
    rows = turns.where(~X.blank(F.col("text")) & F.col("dia_id").isNotNull())
    items = rows.select("conv_id", F.col("dia_id").alias("id"), X.turn_text(F.col("speaker"), F.col("text")).alias("text"))
    found = F.array_sort(F.collect_list(F.struct("rank", "id", "document")))
    return _near(asked, items, k, embed).groupBy("query_id").agg(found.alias("r")).select("query_id", F.col("r.id").alias("retrieved_ids"), F.array_join(F.col("r.document"), "\n").alias("context"))


#: About how many notes a block has; two blocks of a conversation are compared in a task.
NOTE_BLOCK = 1024


def nearest_earlier(notes: DataFrame, k: int) -> DataFrame:
    """(a, b, s): of each note ``b`` the ``k`` nearest ``a`` of the earlier notes of its conversation, by ``s`` and then id.

    ``notes`` (conv_id long, note_id, ord, embedding); those without a vector are near to nothing. A conversation's notes are
    dealt into blocks. Each two blocks meet in one task, which hands on ``k`` rows a note: pairs are never written out, and a
    conversation of any length is spread.
    """
    notes = notes.where("embedding is not null")
    blocks = notes.groupBy("conv_id").agg(F.ceil(F.count("*") / NOTE_BLOCK).cast("int").alias("blocks"))
    dealt = notes.join(blocks, "conv_id").withColumn("own", F.pmod(F.xxhash64("note_id"), "blocks").cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    id_type = notes.schema["note_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("note_id", ignore_index=True)
        v = np.array(rows["embedding"].tolist(), dtype=np.float64)
        norm = np.sqrt((v**2).sum(axis=1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        ids, order, own = rows["note_id"].to_numpy(), rows["ord"].to_numpy(), rows["own"].to_numpy()
        left = rows["met"].to_numpy()
        out_a, out_b, out_s = [], [], []
        for at in range(0, len(rows), 512):
            s = np.round(np.clip(v[at : at + 512] @ v.T, 0.0, 1.0), 10)
            # two notes of one block meet where the block meets itself
            meet = (own[None, :] == left[at : at + 512, None]) & (order[None, :] < order[at : at + 512, None])
            s[~meet] = -1.0
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids are sorted, so ties go to the smaller one
            found = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(found >= 0)
            out_a.append(ids[best[i, j]])
            out_b.append(ids[at + i])
            out_s.append(found[i, j])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "s": np.concatenate(out_s)})

    met = dealt.select("conv_id", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "met", "note_id", "ord", "embedding")
    near = met.groupBy("conv_id", "i", "j").applyInPandas(run, f"a {id_type}, b {id_type}, s double")
    w = Window.partitionBy("b").orderBy(F.desc("s"), "a")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def note_links(notes: DataFrame, k: int = 5, least: float = 0.7) -> DataFrame:
    """Edges, both ways, between each note and the nearest of the earlier notes of its conversation."""
    kept = nearest_earlier(notes, k).where(F.col("s") >= least)
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(kept.select("b", "a")).distinct()


def blended(keyword: DataFrame, vector: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """``0.4 keyword + 0.6 vector`` over (query_id, id) frames; notes linked to the first ``k`` are marked when they make it themselves."""
    both = keyword.join(vector, ["query_id", "id"], "full_outer")
    score = F.round(0.4 * F.coalesce("keyword", F.lit(0.0)) + 0.6 * F.coalesce("similarity", F.lit(0.0)), 9)
    scored = both.select("query_id", "id", score.alias("similarity"))
    top = ranked(scored, k)
    linked = top.join(links, top["id"] == links["src"]).select("query_id", F.col("dst").alias("id")).distinct().withColumn("linked", F.lit(True))
    return top.join(linked, ["query_id", "id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def note_search_of_turns(turns: DataFrame, asked: DataFrame, k: int, embed: Embed = embed_once) -> DataFrame:
    """Turns as notes with their first words as keywords: keyword and vector blend with one-hop links."""
    notes = turns.select("conv_id", F.concat_ws("/", "conv_id", "dia_id").alias("id"), "turn_ord", "text", F.transform(X.note_keywords(F.col("text")), F.lower).alias("keywords"))
    words = asked.select("conv_id", "query_id", F.array_distinct(F.transform(X.note_keywords(F.col("question"), 8), F.lower)).alias("asked"))
    share = F.size(F.array_intersect("asked", "keywords")) / F.greatest(F.size("asked"), F.lit(1))
    keyword = words.join(notes, "conv_id").select("query_id", "id", share.alias("keyword")).where("keyword > 0")
    vector = _near(asked, notes.select("conv_id", "id", "text"), min(3 * k, 20), embed).select("query_id", "id", "similarity")
    embedded = embed(notes.select("conv_id", "id", "turn_ord", "text"), "text", "embedding")
    links = note_links(embedded.select("conv_id", F.col("id").alias("note_id"), F.col("turn_ord").alias("ord"), "embedding"))
    return blended(keyword, vector, links, k)


def segment_documents(qa: DataFrame) -> DataFrame:
    """The text of each segment for embedding: fields, summary and its three last questions."""
    w = Window.partitionBy("conv_id", "segment_id").orderBy(F.desc("seq"))
    recent = qa.withColumn("back", F.row_number().over(w)).where("back <= 3").groupBy("conv_id", "segment_id").agg(hierarchy.in_order("back", "user_input").alias("questions"))
    rows = hierarchy.segments_of(qa).join(hierarchy.segment_summaries(qa).select("conv_id", "segment_id", "summary"), ["conv_id", "segment_id"]).join(recent, ["conv_id", "segment_id"])
    c = F.col
    return rows.withColumn("document", render.segment_document(c("topic"), c("core_entity"), c("intent"), c("summary"), c("questions")))


def layer_retrieval(qa: DataFrame, asked: DataFrame, top_qa: int, top_segment: int, embed: Embed = embed_once) -> DataFrame:
    """Retrieval from exchanges alone, and from exchanges and segments; only turn ids of exchanges count as retrieved."""
    c = F.col
    texts = qa.select("conv_id", c("qa_id").alias("id"), render.qa_document(c("topic"), c("core_entity"), c("intent"), c("entities"), c("user_input"), c("assistant_output")).alias("text"))
    hits = _near(asked, texts, top_qa, embed).join(qa.select(c("qa_id").alias("id"), "dia_id"), "id")
    r = F.array_sort(F.collect_list(F.struct("rank", "dia_id", "document")))
    found = hits.groupBy("query_id").agg(r.alias("r")).select("query_id", c("r.dia_id").alias("retrieved_ids"), F.array_join(c("r.document"), "\n\n").alias("qa_context"))
    segments = segment_documents(qa).select("conv_id", c("segment_id").alias("id"), c("document").alias("text"))
    s = F.array_sort(F.collect_list(F.struct("rank", "document")))
    above = _near(asked, segments, top_segment, embed).groupBy("query_id").agg(s.alias("s")).select("query_id", F.array_join(c("s.document"), "\n\n").alias("segment_context"))
    both = found.join(above, "query_id", "left")
    parts = F.filter(F.array("segment_context", "qa_context"), lambda p: F.coalesce(p, F.lit("")) != "")
    return both.select("query_id", "retrieved_ids", "qa_context", F.array_join(parts, "\n\n").alias("context"))
