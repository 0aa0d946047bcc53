"""Quality rules: ordered threshold conjunctions learned from labelled statistics, as Spark conditional expressions.

``text_statistics`` makes whole-number statistics of every text in one pass. ``learn_rules`` grows and prunes
rules for the low-quality class by sequential covering on a bounded sample of labelled rows (``max_rows``, part of
the interface); only their statistics reach the driver. ``first_rule`` turns the list into nested ``when``
expressions, so the verdict itself is an ordinary column that Spark plans and compiles.

Null and empty texts have no words, all statistics are 0 (and fail the base rule). Rows without a 0/1 label aren't
learned from; with no labels the list is empty and the base rule alone decides. Repeated rows get the same verdict.
An empty table gives no rows. Texts of any length are counted whole. Of conditions with equal gain the first measure and
the lowest threshold are taken. Other columns pass through; one named as a computed column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import WordHashes, extended, labelled_sample, raw_texts, space_words, stored, table, window_hashes

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks")

#: The measures that rules put thresholds on, as SQL over the statistics.
MEASURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True


def statistics_of(raw: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = space_words(raw)
    n = len(words)
    codes = np.frombuffer(raw, dtype=np.uint8)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    repeated = 0
    if n >= 4:
        if len(number) < 1 << 21:
            a = np.array(ids, dtype=np.int64)
            window = a[:-2] << 42 | a[1:-1] << 21 | a[2:]
        else:
            window = window_hashes(hashes.of(words), 3)
        order = np.sort(window)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            again = np.isin(window, twice)
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : k + n - 2] |= again
            repeated = int(covered.sum())
    return (
        n,
        int(((codes & 0xC0) != 0x80).sum()) - int(_SPACE[codes].sum()),
        int(_SYMBOL[codes].sum()),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(number),
        int(((codes >= 65) & (codes <= 90)).sum()),
        raw.count(b"!") + raw.count(b"?"),
    )


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    def compute(batch: pa.RecordBatch):
        hashes = WordHashes()
        rows = np.array([statistics_of(raw, hashes) for raw in raw_texts(batch, text_col)], dtype=np.int64)
        for column in rows.reshape(-1, len(STATISTICS)).T:
            yield pa.array(column, pa.int64())

    return extended(docs, compute, [T.StructField(s, T.LongType()) for s in STATISTICS], keep)


Condition = tuple[str, str, float]  # measure, "<=" or ">", threshold
Rule = list[Condition]


def _holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for measure, sign, value in rule:
        out &= (x[measure] <= value) if sign == "<=" else (x[measure] > value)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    """Add the condition with the highest FOIL gain until the rule covers no good row."""
    rule: Rule = []
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and live.any() and (~bad[live]).any():
        p0, n0 = int(bad[live].sum()), int((~bad[live]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for measure, values in x.items():
            v, y = values[live], bad[live]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            p_low = np.cumsum(y)[ends].astype(float)
            n_low = ends + 1 - p_low
            for sign, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    cut = (float(v[ends[k]]) + float(v[ends[k] + 1])) / 2
                    best = (float(gain[k]), (measure, sign, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _holds(rule[-1:], x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on rows it wasn't grown on."""
    best, kept = -2.0, rule
    for k in range(len(rule), 0, -1):
        hit = _holds(rule[:k], x)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, rule[:k]
    return kept


def cover(
    x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, precision: float = 0.95, longest: int = 4, most_rules: int = 24
) -> list[Rule]:
    """Sequential covering. ``part`` 0 prunes, the rest grows. Rules below ``precision`` on either part end the search."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules and (bad & left).sum() >= 3:
        grow, check = left & (part != 0), left & (part == 0)
        if not (bad & grow).any():
            break
        pick = lambda mask: {k: v[mask] for k, v in x.items()}
        rule = _grow(pick(grow), bad[grow], longest)
        if not rule:
            break
        if check.any():
            rule = _prune(rule, pick(check), bad[check])
        hit = _holds(rule, x) & left
        held = hit & (part == 0)
        if hit.sum() < 3 or bad[hit].mean() < precision or (held.any() and bad[held].mean() < precision - 0.05):
            break
        rules.append([(m, s, round(v, 6)) for m, s, v in rule])
        left &= ~hit
    return rules


def learn_rules(
    statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000, precision: float = 0.95
) -> list[Rule]:
    """Rules for rows labelled 0, from at most ``max_rows`` labelled rows."""
    sample = labelled_sample(labels.select(id_col, label_col), id_col, label_col, max_rows)
    rows = (
        statistics.join(F.broadcast(sample), id_col)
        .select(*(F.expr(e).cast("double").alias(m) for m, e in MEASURES.items()), F.col(label_col).alias("y"),
                F.pmod(F.xxhash64(*STATISTICS), F.lit(3)).cast("int").alias("part"))
        .toPandas()
    )
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return cover({m: rows[m].to_numpy(float) for m in MEASURES}, rows["y"].to_numpy() == 0, rows["part"].to_numpy(), precision)


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(F.expr(" AND ".join(f"{MEASURES[m]} {sign} {value!r}D" for m, sign, value in rule)), F.lit(i))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(text_statistics(docs, keep=["doc_id"]), "quality-statistics")
    rules = learn_rules(rows, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("rule", first_rule(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"), F.col("rule").cast("int").alias("rule"),
    )
