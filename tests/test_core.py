"""Behaviours of routing, budgets, recall and search on small hand-made frames."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memjobs.functions import parse
from memjobs.functions import text as X
from memjobs.functions.embed import HashingEmbedder
from memjobs.operators import budget, hierarchy, models, routing, vectors
from memjobs.operators import recall as R
from memjobs.streaming import ingest

RECORDS = "conv_id long, turn_ord int, rec_ord int, topic string, core_entity string, intent string, entities array<string>, confidence double, user_input string, assistant_output string"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, 0, topic, "ann", intent, ["x"], 0.5, f"u{t}", "") for c, t, topic, intent in rows], RECORDS)


def six(conv):
    return [(conv, 0, "trip", "plan a"), (conv, 1, "trip", "plan a"), (conv, 2, "trip", "plan a"), (conv, 3, "trip", "book b"), (conv, 4, "trip", "book b"), (conv, 5, "salary", "ask c")]


def test_six_ordered_records(spark):
    rows = routing.routed(frame(spark, six(7))).orderBy("seq").collect()
    assert [r.action for r in rows] == ["new_experience", "append_segment", "append_segment", "new_segment", "append_segment", "new_experience"]
    assert [r.segment_id for r in rows] == ["seg_7_1_1"] * 3 + ["seg_7_1_2"] * 2 + ["seg_7_2_1"]


def test_routing_does_not_depend_on_partitions(spark):
    rows = frame(spark, [r for c in range(5) for r in six(c)])
    found = [sorted(map(tuple, routing.routed(rows.repartition(n)).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_streamed_state_equals_batch_and_rejects_late_rows():
    rows = pd.DataFrame([{"conv_id": 1, "turn_ord": t, "rec_ord": 0, "topic": topic, "core_entity": "ann", "intent": intent} for _, t, topic, intent in six(1)])

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Map(dict):
        def getValue(self, key):  # noqa: N802  names of the interface
            return self[key]

        def containsKey(self, key):  # noqa: N802
            return key in self

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

        def getMapState(self, *_):  # noqa: N802
            return Map()

    job, out = ingest.Routing(), []
    job.init(Handle())
    for part in (rows[:2], rows[2:5], rows[1:2], rows[5:]):
        out.append(pd.concat(list(job.handleInputRows((1,), iter([part]), None))))
    out = pd.concat(out)
    assert (out["action"] == "rejected_late").sum() == 1
    whole = routing.route_frame(routing.Router(1), rows)
    assert out[out["action"] != "rejected_late"]["segment_id"].tolist() == [r["segment_id"] for r in whole]


def test_every_exchange_is_in_one_segment(spark):
    qa = hierarchy.exact_topic_memory(frame(spark, [r for c in range(3) for r in six(c)]))
    assert qa.count() == 18 and qa.select("qa_id").distinct().count() == 18
    assert hierarchy.segments_of(qa).agg(F.sum("n_qas")).first()[0] == 18


def leaf(name, score, n=20):
    return {"id": name, "user_input": "u" * n, "assistant_output": "a" * n, "local_score": score}


def branch(name, score, qas, summary="s"):
    return {"id": name, "summary": summary, "local_score": score, "qas": qas}


def test_budget_removes_leaf_then_segment_then_experience():
    tree = [
        {"id": "e1", "summary": "s", "local_score": 0.9, "segments": [branch("s1", 0.9, [leaf("q1", 0.9), leaf("q1-low", 0.05)]), branch("s1-low", 0.1, [leaf("q1-branch", 0.2)])]},
        {"id": "e2", "summary": "s", "local_score": 0.1, "segments": [branch("s2", 0.1, [leaf("q2", 0.1)])]},
    ]
    fitted, done = budget.fit(tree, 10, 1, 1)
    assert (done["removed_qa"], done["removed_segments"], done["removed_experiences"]) == (["q1-low"], ["s1-low"], ["e2"])
    assert [e["id"] for e in fitted] == ["e1"] and done["context_overflow_unresolved"]
    assert budget.fit(tree, 10_000)[1]["removed_qa"] == []


def test_budget_keeps_sizes_right():
    tree = [{"id": f"e{i}", "summary": "long words " * 200, "local_score": 0.1 * i, "segments": [branch(f"s{i}{j}", 0.3, [leaf(f"q{i}{j}{k}", k / 5, 300) for k in range(3)], "é" * 700) for j in range(3)]} for i in range(3)]
    for size in (300, 700, 1500, 3000, 8000):
        fitted, done = budget.fit(tree, size)
        assert done["tokens_after"] == budget.tokens(fitted)
        assert done["context_overflow_unresolved"] == (budget.tokens(fitted) > size)


def test_topic_records_are_rejected_with_a_reason(spark):
    good = {"topic": "t", "core_entity": "e", "intent": "i", "entities": ["x", " "], "confidence": 0.5, "reasoning": "r"}
    cases = [(good, None), (good | {"topic": " "}, "blank topic"), (good | {"entities": [" "]}, "no entities"), (good | {"confidence": 1.2}, "confidence out of range"),
             (good | {"confidence": True}, "confidence is no number"), ({k: v for k, v in good.items() if k != "intent"}, "missing intent")]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, r string")
    found = df.select("i", parse.record_error(parse.response_records(F.col("r"))[0]).alias("e")).orderBy("i").collect()
    assert [r.e for r in found] == [e for _, e in cases]
    odd = spark.createDataFrame([("[]",), ("[1]",), ('"x"',), ("nope",), (None,)], "r string")
    assert [r[0] for r in odd.select(parse.response_records(F.col("r"))).collect()] == [None] * 5


def test_lexical_units_of_cjk(spark):
    got = spark.createDataFrame([("旅行计划 cities",)], "t string").select(X.lexical_units(F.col("t"))).first()[0]
    assert set(got) == {"旅行计划", "cities", "city", "旅行", "行计", "计划"}


def test_scoped_search(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    items = spark.createDataFrame([(1, "s1", [1.0, 0.0]), (2, "s2", [0.9, 0.1]), (3, "s1", [0.0, 0.0])], "id long, parent string, embedding array<float>")
    scope = spark.createDataFrame([(1, "s1")], "query_id long, parent string")
    assert [r.id for r in vectors.scoped_top_k(q, scope, items, 5, "parent").orderBy("rank").collect()] == [1, 3]
    assert vectors.scoped_top_k(q, scope.where("false"), items, 5, "parent").count() == 0
    assert [r.id for r in vectors.top_k(q, items, 9).orderBy("rank").collect()] == [1, 2, 3]


def test_embedder_is_unit_or_zero():
    e = HashingEmbedder()
    assert e("").sum() == 0 and abs((e("a b c") ** 2).sum() - 1) < 1e-9 and (e("A b") == e("b a")).all()


def test_diversified_takes_one_of_each_parent_first(spark):
    rows = spark.createDataFrame([(1, "a", "p", 0.9), (1, "b", "p", 0.8), (1, "c", "q", 0.1)], "query_id long, id string, parent string, score double")
    assert [r.id for r in R.diversified(rows, "parent", "id", 3).orderBy("rank").collect()] == ["a", "c", "b"]


def test_model_hook_loses_no_row(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("bad prompt")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "x"), (4, None)], "id int, prompt string")
    got = {r.id: (r.response, r.error) for r in models.call_model(rows, "prompt", model, fallback="-").collect()}
    assert got == {1: ("X", None), 2: ("-", "bad prompt"), 3: ("X", None), 4: (None, None)}


@pytest.mark.parametrize("raw,hour", [("1:56 pm on 8 May, 2023", 13), ("11:05 am on 12 June, 2022", 11), ("nonsense", None)])
def test_session_time(spark, raw, hour):
    got = spark.createDataFrame([(raw,)], "t string").select(F.hour(X.session_time(F.col("t")))).first()[0]
    assert got == hour
