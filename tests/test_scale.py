"""Ties at the digits shown, and operators in blocks compared with SQL or with their plain definition."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from memjobs.functions import embed
from memjobs.functions import text as X
from memjobs.operators import recall as R
from memjobs.operators import vectors
from memjobs.plans.tables import kept
from memjobs.streaming import ingest


def against_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL on small tables that are given as DataFrames."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = E.queries()[name](spark, str(folder)), con.execute(E.oracle_sql()[name])
    names = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(*names).collect())), sorted(want.fetchall())


@pytest.mark.parametrize("name", ["b6_filtered_top_k", "d5_scoped_top_k", "d4_top_k", "d6_nearest_above", "h2_scores_at_k"])
def test_what_is_equal_when_shown_goes_by_id(spark, tmp_path, name):
    """Later vectors are nearer to the query by less than is shown."""
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1.0, 2e-4 - i * 1e-5], i // 8) for i in range(1, 13)]
    got, want = against_sql(spark, tmp_path, name, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got == want and want


# -- texts are taken apart once


def test_letters_are_lowered_once_a_text(spark):
    rows = spark.createDataFrame([("Abba",)], "t string").select(embed.letter_counts(F.col("t")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("translate(") == 1 and rows.first()[0][:3] == [2.0, 2.0, 0.0]


def test_units_are_taken_apart_before_rows_meet(spark):
    """Scores by the units that the queries ask for are those by all units; a pair's text is not taken apart."""
    texts = ["Boats rowed to harbours", "the boat sails", "港口汽车 boats", "", None, "engines and boats running"]
    cols = "conv_id long, qa_id string, topic string, core_entity string, intent string, user_input string, assistant_output string, entities array<string>, confidence double"
    qa = kept(spark.createDataFrame([(i % 2, f"q{i}", "t", "e", "i", t, "", ["x"], 0.5) for i, t in enumerate(texts * 2)], cols))
    cols = "query_id long, conv_id long, topic string, core_entity string, intent string, entities array<string>, question string"
    asked = kept(R.prepared(spark.createDataFrame([(i, i % 2, "t", "e", "i", ["x"], t or "") for i, t in enumerate(texts)], cols)))
    pairs = asked.select("query_id", "conv_id").join(qa.select("conv_id", F.col("qa_id").alias("id")), "conv_id").select("query_id", "id", F.lit(0.5).alias("similarity"))
    told = kept(R.with_units(qa, "qa", asked))
    score = lambda memory: R.candidate(pairs, memory, asked, "qa").select("query_id", "id", "keyword_score", "score")
    assert sorted(score(told).collect()) == sorted(score(qa).collect()) and score(told).where("keyword_score > 0").count() > 5
    assert "split(" not in score(told)._jdf.queryExecution().optimizedPlan().toString()
    want = asked.select("query_id", X.keyword_terms(R.keyword_text(), *map(F.col, ("topic", "core_entity", "intent"))).alias("terms")).join(
        qa.select("conv_id", F.col("qa_id").alias("id"), R.searchable(qa, "qa").alias("text")).join(asked.select("query_id", "conv_id"), "conv_id"), "query_id")
    want = want.select("query_id", "id", X.keyword_score(F.col("terms"), F.col("text")).alias("k"))
    assert sorted(map(tuple, want.collect())) == sorted((r.query_id, r.id, r.keyword_score) for r in score(told).collect())


# -- every pair of a scope


def test_every_pair_is_multiplied_in_blocks(spark):
    """As the join row by row, odd vectors too; other than odd ones no pair is joined."""
    odd = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [1.0]]
    rows = [(i, [float(i % 7) - 3, float(i % 5)], i % 3 if i % 11 else None) for i in range(200)] + [(300 + i, v, i % 2) for i, v in enumerate(odd)]
    items = spark.createDataFrame(rows, "id long, embedding array<float>, label int")
    asked = items.where("id % 10 = 0 or id > 299").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"), "label")
    got, want = (vectors.every_pair(asked, items, ("label", "label"), values=n) for n in (1 << 22, 0))
    shown = lambda df: sorted((r.query_id, r.id, round(r.similarity, 9)) for r in df.collect())
    assert shown(got) == shown(want) and got.count() > 1000 and "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


# -- search of an index


def of_index(spark, copies):
    """Items of which some are equal, zero, null or not a number, some ids of them repeated, and every tenth id as a query."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(copies)] + [(9000 + i, [0.0] * 8) for i in range(30)] + [(9100, None), (9101, [float("nan")] * 8), (7, rows[7][1]), (7, rows[8][1])]
    items = spark.createDataFrame(rows + [(1003, rows[5][1])] * 25, "id long, embedding array<float>").repartition(3)
    return items, items.where("id % 10 = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


def test_a_part_of_the_codes_hands_on_no_more_than_is_compared(spark, monkeypatch):
    """Rows of queries and codes grow with the queries and parts, not with the codes of the cells; no row of a query and a cell is ranked."""
    items, asked = of_index(spark, 700)
    monkeypatch.setattr(vectors, "CODE_PART", 500, raising=False)
    index, sizes, plain = vectors.build_index(items, rows_per_cell=20, step=kept), [], vectors.ranked

    def ranked(pairs, k, *names):
        sizes.append(pairs.count())
        return plain(pairs, k, *names)

    monkeypatch.setattr(vectors, "ranked", ranked)
    found, looked = vectors.search_index(index, asked, items, 3, share=0.68, refine=2)
    parts, n = -(-index.codes.count() // 500), asked.where("query is not null").count()
    assert sizes and max(sizes) <= n * 3 * 2 * (parts + 1) and found.count() >= 3 * (n - 1)
    assert "Window" not in looked._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("part", "small"), [(1 << 16, False), (150, True)])
@pytest.mark.parametrize(("share", "refine"), [(0.68, 10), (0.1, 2), (1.0, 1)])
def test_search_of_an_index_equals_a_plain_search_of_its_cells(spark, monkeypatch, part, small, share, refine):
    items, asked = of_index(spark, 200)
    index = vectors.build_index(items, rows_per_cell=20, step=kept)
    if small:
        for name, most in (("CODE_PART", part), ("CENTRE_SCORES", 300), ("ASKED_VALUES", 80), ("SCOPE_PART", 40)):
            monkeypatch.setattr(vectors, name, most)
    found, looked = vectors.search_index(index, asked, items, 4, share, refine)
    unit, shown = vectors._unit, lambda a, b: np.round(np.clip(a @ b.T, 0.0, 1.0), 12)
    cells = {r.cell: (r.coarse, np.array(r.centre, dtype=np.float32)) for r in index.cells.collect()}
    codes, vectors_of = {}, {}
    for r in index.codes.collect():
        codes.setdefault(r.cell, set()).add((r.id, (np.frombuffer(r.code, np.int8) * np.float32(r.scale) + cells[r.cell][1]).tobytes()))
    for r in items.where("embedding is not null").collect():
        vectors_of.setdefault(r.id, []).append(np.array(r.embedding))
    n_coarse, probes = math.ceil(math.sqrt(share) * len(index.coarse)), math.ceil(share * index.n_cells)
    got, seen = {}, {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.similarity, 6)))
    for r in looked.collect():
        seen.setdefault(r.query_id, set()).add(r.cell)
    for q in asked.where("query is not null and query_id <> 9101").collect():
        v = unit(np.array([q.query], dtype=np.float64))
        allowed = set(np.argsort(-(v @ index.coarse.T)[0], kind="stable")[:n_coarse].tolist())
        near = sorted((-shown(v, unit(m[None].astype(np.float64)))[0, 0], cell) for cell, (coarse, m) in cells.items() if coarse in allowed and not np.isnan(m).any())
        assert seen[q.query_id] == {cell for _, cell in near[:probes]}
        met = {(-shown(v, unit(np.frombuffer(m, np.float32)[None].astype(np.float64)))[0, 0], i) for cell in seen[q.query_id] for i, m in codes.get(cell, ())}
        first = sorted((-round(float(shown(v, unit(x[None]))[0, 0]), 12), i) for _, i in sorted(met)[: refine * 4] for x in vectors_of[i])
        assert [i for i, _ in got[q.query_id]] == [i for _, i in first[:4]]
    counts = {r.cell: r.n_queries for r in vectors.looks_by_cell(index, asked, share).where("n_queries > 0").collect()}
    assert counts == dict(Counter(cell for of in seen.values() for cell in of))


# -- streaming state


def test_an_entry_of_the_state_takes_one_call():
    class Store:
        calls = 0

        def getValue(self, key):  # noqa: N802  name of the interface
            self.calls += 1
            return {(1,): (7,)}.get(key)

    store = Store()
    m = ingest.Kept(store, lambda k: (k,), lambda v: (v,), lambda t: t[0])
    assert 2 not in m and m[1] == m[1] == 7 and store.calls == 2
