"""Evaluation: answer scores, retrieval scores at K, aggregates, audits. Row-wise scores are array expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memjobs.functions import text as X


def token_scores(prediction: Column, truth: Column) -> Column:
    """(precision, recall, f1) of the tokens as multisets; both empty 1, one empty or nothing shared 0.

    The tokens of both texts are bound once; equal ones are told apart by their number, so that a set intersection counts.
    """
    both = F.array(F.struct(X.numbered(X.answer_tokens(prediction)).alias("p"), X.numbered(X.answer_tokens(truth)).alias("g")))
    sizes = F.transform(both, lambda s: F.struct(F.size(s["p"]).alias("p"), F.size(s["g"]).alias("g"), F.size(F.array_intersect(s["p"], s["g"])).cast("double").alias("shared")))

    def scores(s: Column) -> Column:
        neither, none = (s["p"] == 0) & (s["g"] == 0), s["shared"] == 0
        precision, recall = s["shared"] / s["p"], s["shared"] / s["g"]

        def guarded(value: Column) -> Column:
            return F.when(neither, 1.0).when(none, 0.0).otherwise(value)

        return F.struct(guarded(precision).alias("precision"), guarded(recall).alias("recall"), guarded(2 * precision * recall / (precision + recall)).alias("f1"))

    return F.transform(sizes, scores)[0]


def scores_at(retrieved: Column, evidence: Column, k: Column) -> Column:
    """(recall, precision, f1, accuracy) of the first ``k`` ids: cut, then without repeats; precision is over k."""
    hits = F.size(F.array_intersect(F.slice(retrieved, F.lit(1), k), evidence)).cast("double")
    n = F.size(F.array_distinct(evidence))
    return _scores(hits, n, k)


def _scores(hits: Column, n: Column, k: Column) -> Column:
    recall = F.when(n == 0, 0.0).otherwise(hits / n)
    precision = hits / k
    f1 = F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), F.when(hits > 0, 1.0).otherwise(0.0).alias("accuracy"))


def retrieval_scores(rows: DataFrame, ks: list[int], retrieved: str = "retrieved_ids", evidence: str = "evidence") -> DataFrame:
    """A row for each input row and K, with recall, precision, f1 and accuracy."""
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    scored = each.withColumn("s", scores_at(F.coalesce(F.col(retrieved), F.array()), F.coalesce(F.col(evidence), F.array()), F.col("k")))
    return scored.select(*rows.columns, "k", "s.*")


def group_scores(found: DataFrame, members: DataFrame, key: str, group: str, ks: list[int], by: list[str]) -> DataFrame:
    """``retrieval_scores`` where the evidence is a whole group, however large: its ids are joined and counted, not listed.

    ``found`` (``key``, ``group``, rank, id, ``by``), each id once a key, ``members`` (``group``, id), each id once. A row
    for each key with something found and K, with ``n_evidence``, recall, precision, f1 and accuracy. A group without
    members has recall 0.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n_evidence"))
    hits = found.join(members.select(group, "id", F.lit(1).alias("hit")), [group, "id"], "left")
    counts = hits.groupBy(key, group, *by).agg(*(F.count(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"__{k}") for k in ks))
    each = counts.join(sizes, group, "left").select(
        key, group, *by, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"__{k}").cast("double").alias("hits")) for k in ks))).alias("at")
    )
    scored = each.withColumn("s", _scores(F.col("at.hits"), F.col("n_evidence"), F.col("at.k")))
    return scored.select(key, group, *by, "n_evidence", "at.k", "s.*")


def macro_average(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means over questions for each K; groups without any are 0."""
    return scores.groupBy(*by, "k").agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"avg_{c}") for c in ("recall", "precision", "f1", "accuracy")), F.count("*").alias("n"))


def _mean(value: Column, default: float = 0.0) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(default)), 6)


def method_metrics(records: DataFrame, by: list[str]) -> DataFrame:
    """Means by method: nulls don't count, nor do judge scores of -1; without values 0 (ratio 1)."""
    return records.groupBy(*by).agg(
        F.count("*").alias("n_questions"), _mean(F.col("f1")).alias("avg_f1"), _mean(F.when(F.col("judge_score") >= 0, F.col("judge_score"))).alias("avg_judge"),
        _mean(F.col("retrieved_tokens")).alias("avg_tokens"), _mean(F.col("compression_ratio"), 1.0).alias("avg_ratio"),
    )


def by_category(records: DataFrame, method: str = "method", category: str = "category") -> DataFrame:
    """Overall and for each category in one pass; ``level`` tells which. Without valid judge score the mean is null."""
    rows = records.withColumn(category, F.coalesce(F.col(category).cast("string"), F.lit("0")))
    found = rows.rollup(method, category).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n_questions"), _mean(F.col("f1")).alias("avg_f1"), F.round(F.avg(F.when(F.col("judge_score") >= 0, F.col("judge_score"))), 6).alias("avg_judge")
    )
    return found.where("g < 3").select(method, category, F.when(F.col("g") == 1, "overall").otherwise("category").alias("level"), "n_questions", "avg_f1", "avg_judge")


def answered_split(records: DataFrame, by: list[str], unknown: str = "Unknown") -> DataFrame:
    """How many predictions are exactly ``unknown``, and the mean F1 of the others."""
    known = F.coalesce(F.col("prediction"), F.lit("")) != unknown
    return records.groupBy(*by).agg(F.sum((~known).cast("long")).alias("n_unknown"), F.sum(known.cast("long")).alias("n_answered"), _mean(F.when(known, F.col("f1"))).alias("answered_f1"))


def evidence_coverage(rows: DataFrame, category: str, retrieved: str = "retrieved_ids", evidence: str = "evidence") -> DataFrame:
    """Of the rows with evidence, the share with any and with all of it retrieved; by category and overall (null)."""
    some = rows.where(F.size(F.coalesce(F.col(evidence), F.array())) > 0)
    hits = F.size(F.array_intersect(F.coalesce(F.col(retrieved), F.array()), F.col(evidence)))
    return _coverage(some.select(F.col(category), (hits > 0).alias("any"), (hits == F.size(F.array_distinct(F.col(evidence)))).alias("all")), category)


def group_coverage(scores: DataFrame, category: str) -> DataFrame:
    """``evidence_coverage`` from scores at one K, for evidence that is too large to be listed."""
    return _coverage(scores.where("n_evidence > 0").select(category, (F.col("recall") > 0).alias("any"), (F.col("recall") == 1).alias("all")), category)


def _coverage(marked: DataFrame, category: str) -> DataFrame:
    share = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_hit") for c in ("any", "all")]
    return marked.rollup(category).agg(F.count("*").alias("n"), *share)


def distribution(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))


def recount_audit(rows: DataFrame, by: str, text_col: str, stored: str) -> DataFrame:
    """Mean tokens counted again against the stored mean, which is null unless every record has one."""
    n = X.word_count(F.col(text_col))
    found = rows.groupBy(by).agg(F.avg(n).alias("fresh"), F.when(F.count(stored) == F.count("*"), F.avg(stored)).alias("kept"))
    return found.select(by, F.round("fresh", 6).alias("recounted"), F.round("kept", 6).alias("stored_mean"), F.round(F.col("fresh") - F.col("kept"), 6).alias("delta"))


#: Rows of a table that may be sent to every task, once they are counted.
SENT = 200_000


def _sent(rows: DataFrame) -> DataFrame:
    """``rows`` made now and, if they are at most ``SENT``, to be sent to every task; more of them are joined by a shuffle."""
    found = rows.limit(SENT + 1).toArrow()
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)) if found.num_rows <= SENT else rows


def percentiles(rows: DataFrame, value: str, by: list[str], points: list[int], cells: int = 4096) -> DataFrame:
    """The value at index max(0, int(n p / 100) - 1) of the sorted values of each group, for each p.

    Selection by counting, with bounds that don't depend on samples, so that reading ``rows`` again can't change them: values are
    counted in fixed cells on a logarithmic scale; the cell in which a rank lies is cut into ``cells`` equal parts between its
    least and largest value, which are counted; only what lies in the part of a rank is sorted. So the rows are read three
    times and never shuffled but for the last part: what moves are the cells' counts, added up in each task first, and the
    wanted cells, at most a row for each group and point, which are sent to the tasks if they are few (``SENT``). The first two
    rounds run when this is called. Infinite values and NaN, which is the largest, lie in cells of their own. Without ``by``
    all rows are one group. Nulls don't count.
    """
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] if by else [F.lit(0).alias(keys[0])]
    d = F.col(value).cast("double")
    finite = F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
    first = F.coalesce(F.floor(F.signum(finite) * F.log1p(F.abs(finite)) * 64).cast("int"), F.when(F.isnan(d), 1 << 30).when(d > 0, 1 << 29).otherwise(-(1 << 29)))
    base = rows.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("v"), finite.alias("f"), first.alias("c1"))

    def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        other = right.withColumnsRenamed({c: f"__r{c}" for c in on})
        return left.join(other, [F.col(c).eqNullSafe(F.col(f"__r{c}")) for c in on]).drop(*(f"__r{c}" for c in on))

    def placed(counted: DataFrame, path: list[str], at: str) -> DataFrame:
        """Each cell of ``path`` with its rows, its ends, all rows of the path and those before it. A window holds a row a cell."""
        counts = counted.groupBy(*path, at).agg(F.count("*").alias("n"), F.min("f").alias("low"), F.max("f").alias("high"))
        w = Window.partitionBy(*path)
        return counts.withColumns({"total": F.sum("n").over(w), "before": F.sum("n").over(w.orderBy(at)) - F.col("n")})

    def wanted(cells_: DataFrame, path: list[str], at: str) -> DataFrame:
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        return cells_.where(inside).select(*path, at, "low", "high", "p", (F.col("rank") - F.col("before")).alias("rank"))

    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.lit(0), F.floor(F.col("total") * p / 100).cast("long") - 1).alias("rank")) for p in points))
    found = _sent(wanted(placed(base, keys, "c1").withColumn("of", F.explode(ranks)).select("*", "of.*"), keys, "c1"))
    path = [*keys, "c1"]
    # halves, so that the difference of two large values is finite
    share = F.coalesce(F.try_divide(F.col("f") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
    part = F.least(F.lit(cells - 1), F.floor(share * cells)).cast("int")
    second = matched(base, found.select(*path, "low", "high").distinct(), path)
    second = second.withColumn("c2", F.when(F.col("f").isNull() | (F.col("high") == F.col("low")), 0).otherwise(part)).drop("low", "high")
    ends = found.select(*path, "low", "high").distinct()
    found = _sent(wanted(matched(placed(second, path, "c2"), found.select(*path, "p", "rank"), path), path, "c2"))
    path = [*path, "c2"]
    last = matched(matched(base, ends, path[:-1]).withColumn("c2", F.when(F.col("f").isNull() | (F.col("high") == F.col("low")), 0).otherwise(part)), found.select(*path).distinct(), path)
    times = last.groupBy(*path, "v").agg(F.count("*").alias("n"))  # copies of a value are one row
    upto = times.withColumn("upto", F.sum("n").over(Window.partitionBy(*path).orderBy("v")))
    hit = matched(upto, found.select(*path, "p", "rank"), path).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    out = hit.groupBy(*keys).agg(*(F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in points))
    if not by:  # one row even where nothing counts
        return out.drop(*keys).groupBy().agg(*(F.max(f"p{p}").alias(f"p{p}") for p in points))
    return out.withColumnsRenamed(dict(zip(keys, by)))


def reduction(off: Column, on: Column) -> Column:
    """Relative gain of ``on`` over ``off``; 0 where ``off`` isn't positive."""
    return F.when(off > 0, (off - on) / off).otherwise(0.0)


def first_per(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def open_questions(questions: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Questions without an answer: done only if the prediction isn't null and the trimmed question is the same."""
    done = answers.where(F.col("prediction").isNotNull()).select(*keys, F.trim("question").alias("asked"))
    return questions.withColumn("asked", F.trim("question")).join(done, [*keys, "asked"], "left_anti").drop("asked")


def resume_status(questions: DataFrame, answers: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    left = open_questions(questions, answers, keys).groupBy(*by).agg(F.count("*").alias("n_open"))
    total = questions.groupBy(*by).agg(F.count("*").alias("n_total"))
    n_open = F.coalesce("n_open", F.lit(0))
    return total.join(left, by, "left").select(*by, "n_total", (F.col("n_total") - n_open).alias("n_done"), F.when(n_open == 0, "complete").otherwise("running").alias("status"))


def evidence_texts(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """Each question's evidence with the turn's text; of turns with one id the last counts."""
    last = turns.groupBy("conv_id", "dia_id").agg(F.max_by("text", "turn_ord").alias("text"))
    each = questions.select("conv_id", "q_index", F.posexplode("evidence").alias("place", "dia_id"))
    return each.join(last, ["conv_id", "dia_id"], "left")


def evaluate(questions: DataFrame, retrievals: DataFrame, answers: DataFrame, totals: DataFrame, ks: list[int]) -> tuple[DataFrame, DataFrame]:
    """Records with all row-wise scores, and the scores at each K.

    ``questions`` (conv_id, q_index, question, answer, evidence, category), ``retrievals`` (method, conv_id, q_index,
    retrieved_ids, context), ``answers`` (method, conv_id, q_index, prediction, judge_score), ``totals`` (conv_id, total_tokens).
    """
    key = ["conv_id", "q_index"]
    rows = questions.join(retrievals, key).join(answers, ["method", *key], "left").join(totals, "conv_id", "left")
    s = token_scores(F.coalesce("prediction", F.lit("")), F.col("answer"))
    rows = rows.withColumn("s", s).withColumn("retrieved_tokens", X.word_count(F.col("context")))
    rows = rows.withColumn("compression_ratio", X.compression_ratio(F.coalesce("total_tokens", F.lit(0)), F.col("retrieved_tokens")))
    records = rows.select("method", *key, "category", "retrieved_ids", "evidence", "prediction", "judge_score", "retrieved_tokens", "compression_ratio",
                          F.col("s.f1").alias("f1"), F.col("s.precision").alias("f1_precision"), F.col("s.recall").alias("f1_recall"))
    return records, retrieval_scores(records.select("method", *key, "retrieved_ids", "evidence"), ks)


def report_table(metrics: DataFrame, at_k: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each method, K values wide, all values formatted: percent 2, judge 4, tokens 1, ratio 2 decimals."""

    def percent(c: Column) -> Column:
        return F.format_string("%.2f", F.round(100 * c, 2))

    wide = at_k.groupBy("method").pivot("k", ks).agg(F.first("avg_recall").alias("recall"), F.first("avg_accuracy").alias("accuracy"))
    table = metrics.join(wide, "method")
    return table.select(
        "method", percent(F.col("avg_f1")).alias("F1"), F.format_string("%.4f", "avg_judge").alias("Judge"),
        *(percent(F.col(f"{k}_recall")).alias(f"R@{k}") for k in ks), *(percent(F.col(f"{k}_accuracy")).alias(f"A@{k}") for k in ks),
        F.format_string("%.1f", "avg_tokens").alias("Tokens"), F.format_string("%.2f", "avg_ratio").alias("Ratio"),
    )


def markdown_rows(table: DataFrame, left: list[str]) -> DataFrame:
    """The table as Markdown lines; ``left`` columns are aligned left, others right."""
    head = [(0, "| " + " | ".join(table.columns) + " |"), (1, "| " + " | ".join(":---" if c in left else "---:" for c in table.columns) + " |")]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns)), F.lit(" |"))
    order = Window.orderBy(*left)  # a report has a row for each method
    return table.sparkSession.createDataFrame(head, "line long, text string").union(table.select((F.row_number().over(order) + 1).cast("long"), cells))
