"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A benchmark item's windows are its runs
of ``window`` consecutive words; an item with fewer words, but not none, is one window. The hashes of all distinct
windows form a small table that is broadcast as long as it has at most ``broadcast_rows`` rows, else joined by a
shuffle of hashes. Each document's windows are hashed and looked up in one pass over its words; a hit counts only if the words
themselves are equal. Only hits, and one row for each document, leave that pass.

A null or empty text has no words and isn't contaminated; such items have no windows. An empty benchmark or table of
documents gives no hits or no rows. Rows with equal id and text count as one document; rows with equal id and other
texts are documents of their own. Items that repeat an id count once; a window that several items have counts for each.
Texts of any length are used whole. Other columns aren't read, so their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.llm.common import set_aside, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z only. Where a text is all ASCII, plain ``lower`` does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _hashes(words: Column, length: int) -> Column:
    """Hashes of all windows; the words are bound once, so they aren't computed again for each window."""
    hashes = F.transform(
        F.array(words),
        lambda ws: F.when(
            F.size(ws) >= length,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (length - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, length))),
        ),
    )
    return F.coalesce(hashes[0], F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """item_id (as text), length, hash, words: one row for each distinct window of each item."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item_id"), normal_words(F.col(text_col)).alias("all_words"))
    n = F.size("all_words")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    return (
        words.select("item_id", "all_words", F.least(n, F.lit(window)).alias("length"), F.explode(starts).alias("start"))
        .select("item_id", "length", F.slice("all_words", F.col("start") + 1, F.col("length")).alias("words"))
        .withColumn("hash", F.xxhash64("words"))
        .distinct()
    )


def find_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 13, broadcast_rows: int = 200_000,
) -> tuple[DataFrame, DataFrame]:
    """The items' windows, and the rows (doc_id, text_hash, n_words, start, length, hash) of all hits.

    Every document also has a row whose ``start`` is null.
    """
    items = stored(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    sizes = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``window`` rows
    distinct = items.select(F.col("length").alias("b_length"), F.col("hash").alias("b_hash"), F.col("words").alias("b_words")).distinct()
    words = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), normal_words(F.col(text_col)).alias("words")
    ).withColumn("n_words", F.size("words").cast("long"))
    # the document's own row comes first: no length, no hash
    own = F.struct(F.lit(None).cast("int").alias("length"), F.array(F.lit(None).cast("long")).alias("hashes"))
    every = F.array(own, *(F.struct(F.lit(n).alias("length"), _hashes(F.col("words"), n).alias("hashes")) for n in sorted(sizes)))
    kept = ("doc_id", "text_hash", "n_words", "words")
    if sum(sizes.values()) > broadcast_rows:
        return items, _shuffled_hits(words, every, distinct)
    rows = words.select(*kept, F.explode(every).alias("of")).select(*kept, F.col("of.length").alias("length"), F.posexplode("of.hashes").alias("start", "hash"))
    equal = (F.col("length") == F.col("b_length")) & (F.slice("words", F.col("start") + 1, F.coalesce("length", F.lit(0))) == F.col("b_words"))
    # the hash alone is the join's key; the words of a hit are compared after it
    found = rows.join(F.broadcast(distinct), F.col("hash") == F.col("b_hash"), "left").where(F.col("length").isNull() | (F.col("b_hash").isNotNull() & equal))
    found = found.withColumn("start", F.when(F.col("length").isNotNull(), F.col("start")))
    return items, found.select("doc_id", "text_hash", "n_words", "start", "length", "hash")


def _shuffled_hits(words: DataFrame, every: Column, distinct: DataFrame) -> DataFrame:
    """The same rows without a broadcast: windows travel as hashes, and the words are fetched for those that are met."""
    key = ("doc_id", "text_hash", "n_words")
    each = words.select(*key, F.explode(F.slice(every, 2, F.size(every))).alias("of")).select(*key, F.col("of.length").alias("length"), F.posexplode("of.hashes").alias("start", "hash"))
    met = each.join(distinct, (F.col("hash") == F.col("b_hash")) & (F.col("length") == F.col("b_length"))).withColumnsRenamed({"doc_id": "at_id", "text_hash": "at_hash"})
    texts = words.select("doc_id", "text_hash", "words")
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & F.col("text_hash").eqNullSafe(F.col("at_hash"))
    found = met.join(texts, same).where(F.slice("words", F.col("start") + 1, F.col("length")) == F.col("b_words"))
    columns = ("doc_id", "text_hash", "n_words", "start", "length", "hash")
    own = words.select(*key, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("hash"))
    return found.select(*columns).union(own.select(*columns))


def _merged(spans: Column) -> Column:
    """Sorted (start, end) ranges without overlaps, of (start, length) pairs."""
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["start"] + s["length"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end"))))).cast(kind),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, least_share: int = 20, broadcast_rows: int = 200_000,
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, hit ``ranges``, ``items`` (sorted ids), contaminated: 1 / ``least_share`` of the words are hit."""
    items, hits = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, broadcast_rows)
    hits = stored(hits, "benchmark-hits")
    per_doc = (
        hits.groupBy("doc_id", "text_hash")
        .agg(F.max("n_words").alias("n_words"), F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("spans"))
        .select("doc_id", "text_hash", "n_words", _merged(F.col("spans")).alias("ranges"))
        .withColumn("n_hit", F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]))
    )
    found = hits.where("start is not null").select("doc_id", "text_hash", "hash", "length").distinct()
    owners = items.select("hash", "length", "item_id")
    names = (
        found.join(owners, ["hash", "length"])
        .groupBy(F.col("doc_id").alias("in_doc"), F.col("text_hash").alias("in_hash"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    joined = per_doc.join(names, F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("text_hash") == F.col("in_hash")), "left")
    return joined.select(
        "doc_id", "text_hash", "n_words", "n_hit", "ranges", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (least_share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    docs, back = set_aside(docs, ("__bad_id", "__bad_hash"))
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    same = F.col(id_col).eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__bad_hash"))
    return docs.join(bad, same, "left_anti").withColumnsRenamed(back)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` whose texts lose the words inside hit windows; all other characters stay."""
    docs, back = set_aside(docs, ("__hit_id", "__hit_hash", "__ranges"))
    hit = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_hash"), F.col("ranges").alias("__ranges"))
    same = F.col(id_col).eqNullSafe(F.col("__hit_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__hit_hash"))
    word = SEPARATORS[:-1].replace("[", "[^").replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    apart = SEPARATORS[:-1].replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{word}+|{apart}+"), F.lit(0))
    # words and separators alternate, so a piece's place gives the word's number
    cleaned = F.transform(
        F.array(pieces),
        lambda ps: F.array_join(
            F.filter(
                ps,
                lambda p, i: ~(
                    p.rlike(f"^{word}")
                    & F.exists("__ranges", lambda r: (F.floor(i / 2) >= r["start"]) & (F.floor(i / 2) < r["end"]))
                ),
            ),
            "",
        ),
    )[0]
    return docs.join(hit, same, "left").withColumn(text_col, F.when(F.col("__ranges").isNotNull(), cleaned).otherwise(F.col(text_col))).drop("__hit_id", "__hit_hash", "__ranges").withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark
), w AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS words
    FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), hit AS (
    SELECT x.doc_id, x.i, x.n, w.item_id
    FROM (
        SELECT doc_id, l.n, i, array_to_string(list_slice(ws, i, i + l.n - 1), ' ') AS words
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) AS k WHERE len(ws) >= n) AS l
    ) AS x JOIN w ON w.n = x.n AND w.words = x.words
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id
), owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""
