"""Every registered query of the subpackage on empty tables and on a table of odd rows, and statistics against brute force."""

import random
from collections import Counter

import pytest

from memjobs.llm import quality
from memjobs.llm.registry import QUERIES

#: Other columns than the contract's, named as columns that the operators compute.
CLASHING = "score string, rule string, n_words string, predicted string, labels string, ids string, part string, y string, payload string, n string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
PAGES = f"page_id long, url string, html string, {CLASHING}"
MARKS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
REST = ("x",) * 10
LONG = "word other " * 100_000
TEXTS = [None, "", " \n\t ", "one", "é" * 3, LONG, "a" * 300_000, "tie tie tie", "tie tie tie", "mail a@b.co " * 40]


VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def written(spark, path, documents, pages, marks, items):
    tables = (("documents", documents, DOCUMENTS), ("pages", pages, PAGES), ("labels", marks, MARKS), ("benchmark", items, ITEMS), ("embeddings", [], VECTORS), ("conversations", [], TURNS))
    for name, rows, schema in tables:
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    path = written(spark, f"file://{tmp_path}/t", [], [], [], [])
    assert QUERIES[name](spark, path).count() == 0


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    documents = [(i, t, "en", "s", len(t or ""), *REST) for i, t in enumerate(TEXTS)]
    documents += [documents[7], (None, None, None, None, None, *(None,) * 10), (None, "tie tie tie", None, None, None, *REST)]
    pages = [(i, None if i == 3 else f"u{i}", t and f"<p>{t}</p>", *REST) for i, t in enumerate(TEXTS)]
    pages += [pages[7], (None, None, None, *(None,) * 10)]
    marks = [(0, None, None), (None, 1, 1), (3, 0, 1), (3, 1, 0), (5, 1, 0), (77, 0, 1)]
    return written(spark, f"file://{tmp_path_factory.mktemp('odd')}/t", documents, pages, marks, [(1, None), (2, ""), (None, "tie tie tie"), (4, "tie tie tie")])


#: Rows that repeat an id and a text are one row in these.
ONCE = ("op3_ngram_jaccard", "op4_decontaminate", "op5_warc_archive")


#: These read other tables; their odd rows are in tests of their own.
OTHER = ("op11_whitening", "op12_conversation_repair")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(OTHER)))
def test_odd_rows_have_defined_results(spark, odd, name):
    df = QUERIES[name](spark, odd)
    rows = [r.asDict() for r in df.collect()]
    key = "page_id" if "page_id" in df.columns else "doc_id"
    nulls = 1 if key == "page_id" else 2
    got = Counter(r[key] for r in rows)
    assert got == Counter({i: 2 if i == 7 and name not in ONCE else 1 for i in range(len(TEXTS))} | {None: nulls})
    same = [{c: v for c, v in r.items() if c not in (key, "url", "component_id", "held_out", "refers_to", "record_type")} for i in (7, 8) for r in rows if r[key] == i]
    if name not in ("op6_substring_dedup", "op13_suffix_dedup"):
        assert all(x == same[0] for x in same)
    again = [r.asDict() for r in QUERIES[name](spark, odd).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_statistics_of_texts_of_any_length(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(size)], k=n)) for size, n in ((5, 30), (40, 400), (900, 3000), (10, 2500), (4000, 9000))]
    texts += ["a b c " * 700, "\n".join(["x y", "", " x y", "x y", "#$ |<>"] * 90), " ".join(map(str, range(5000))), LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.text_statistics(df).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        times = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if times[x] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if x.split()]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][s] for s in quality.STATISTICS[:5]) == want
