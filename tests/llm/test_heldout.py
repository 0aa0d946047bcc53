"""What the learned operators reach on the given tables: rows that they didn't learn from, and pages whose article is known."""

import os
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from memjobs.llm import extraction, quality, toxicity
from memjobs.llm.common import table

LARGE, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="the given tables aren't here")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_rules_reject_bad_documents_that_they_have_not_seen(spark):
    documents = table(spark, LARGE, "documents").select("doc_id", "text")
    labels = table(spark, LARGE, "labels")
    statistics = quality.text_statistics(documents)
    rules = quality.learn_rules(statistics, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    truth = {r.doc_id: r.quality for r in labels.select("doc_id", "quality").collect()}
    rows = statistics.select("doc_id", "n_words", "n_repeat_words", quality.first_rule(rules).alias("rule")).collect()
    got = {r.doc_id: r for r in rows if held_out(r.doc_id) and r.doc_id in truth}
    base = {i: r.n_words < 50 or 2 * r.n_repeat_words > r.n_words for i, r in got.items()}
    bad = [base[i] or r.rule is not None for i, r in got.items() if truth[i] == 0]
    good = [r.rule is not None for i, r in got.items() if truth[i] == 1 and not base[i]]
    assert len(bad) > 50 and len(good) > 300
    assert sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.02 * len(good)


def test_toxic_documents_that_it_has_not_seen(spark):
    truth = {r.doc_id: r.toxic for r in table(spark, LARGE, "labels").where("toxic is not null").collect()}
    rows = [r for r in toxicity.query(spark, LARGE).collect() if r.held_out and r.doc_id in truth]
    assert all(held_out(r.doc_id) for r in rows)
    score, y = np.array([r.score for r in rows]), np.array([truth[r.doc_id] for r in rows])
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (y == 0).sum()
    assert auc >= 0.95 and ((score >= 0.5) == y).mean() >= 0.97


class Article(HTMLParser):
    """The words between the article's tags, whatever stands between them."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_articles_of_the_given_pages(spark):
    """Their main text stands in an article element, which the operator isn't told; all words of all pages count."""
    right = found = wanted = 0
    got = {r.page_id: r.text for r in extraction.query(spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        parser = Article()
        parser.feed(r.html or "")
        truth, mine = Counter("".join(parser.parts).split()), Counter(got[r.page_id].split())
        right, found, wanted = right + (truth & mine).total(), found + mine.total(), wanted + truth.total()
    assert wanted > 10_000 and right / found >= 0.99 and right / wanted >= 0.99, (right, found, wanted)
