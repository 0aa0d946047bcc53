"""Queries of readers, parsers of stored rows, streaming and model hooks. Documents are put together from the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.functions import parse
from memjobs.operators import evaluation, hierarchy, models
from memjobs.plans.memory import MEMORY, ROUTED
from memjobs.plans.tables import RECORDS, TURNS, kept, query_id, records, shared_folder, table, turns
from memjobs.sources import dialogue, records as stored_records
from memjobs.streaming import ingest

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def documents(spark, sf_dir):
    """A nested dialogue document for each conversation: turns below 4 in session 2, the others in session 10."""
    t = turns(spark, sf_dir).withColumn("s", F.when(F.col("turn_ord") < 4, "session_2").otherwise("session_10"))
    item = F.struct("turn_ord", F.struct("speaker", "dia_id", "text").alias("v"))
    sessions = t.groupBy("conv_id", "s").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])).alias("j"))
    head = sessions.groupBy("conv_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "s", F.lit('":'), "j"))), ","), F.lit(',"session_2_date_time":"1:56 pm on 8 May, 2023","session_3":[]}')).alias("c"))
    qa = F.concat(F.lit('[{"question":"q'), "conv_id", F.lit('","answer":'), "conv_id", F.lit(',"evidence":["D1:1"]},{"question":"r","category":5}]'))
    body = F.concat(F.lit('{"sample_id":"'), "conv_id", F.lit('","conversation":'), "c", F.lit(',"qa":'), qa, F.lit("}"))
    return head.select(F.col("conv_id").alias("position"), F.when(F.col("conv_id") % 10 == 9, F.substring(body, 1, 40)).otherwise(body).alias("document"))


def document_files(spark, sf_dir):
    """The documents as JSON files: lists of those of up to 25 conversations, and each broken one in a file of its own."""
    broken = F.col("position") % 10 == 9
    block = F.lpad(F.floor(F.col("position") / 25).cast("string"), 12, "0")
    rows = documents(spark, sf_dir).select("position", "document", F.when(broken, F.concat_ws("-", block, "position")).otherwise(block).alias("part"), broken.alias("broken"))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "document"))), lambda d: d["document"]), ",")
    path = shared_folder(spark)
    rows.groupBy("part").agg(F.when(F.max("broken"), inside).otherwise(F.concat(F.lit("["), inside, F.lit("]"))).alias("value")).write.partitionBy("part").text(path)
    return path


@query(
    "a1_dialogue_turns",
    f"SELECT CAST(conv_id AS VARCHAR) AS conv_id, CASE WHEN turn_ord < 4 THEN 2 ELSE 10 END AS session_num, dia_id, speaker, text, CASE WHEN turn_ord < 4 THEN TIMESTAMP '2023-05-08 13:56:00' END AS ts FROM ({TURNS}) WHERE conv_id % 10 <> 9",
)
def a1(spark, sf_dir):
    """Read from JSON files, of which some are broken."""
    return dialogue.turns(dialogue.read_documents(spark, document_files(spark, sf_dir))).select("conv_id", "session_num", "dia_id", "speaker", "text", "ts")


@query(
    "a2_dialogue_questions",
    "SELECT CAST(conv_id AS VARCHAR) AS conv_id, i AS q_index, CASE i WHEN 0 THEN 'q' || conv_id ELSE 'r' END AS question, CASE i WHEN 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS answer, CASE i WHEN 0 THEN 1 ELSE 0 END AS n_evidence, CASE i WHEN 0 THEN 1 ELSE 5 END AS category FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 9), (SELECT unnest([0, 1]) AS i)",
)
def a2(spark, sf_dir):
    q = dialogue.questions(dialogue.read_documents(spark, document_files(spark, sf_dir)))
    return q.select("conv_id", "q_index", "question", "answer", F.size("evidence").alias("n_evidence"), "category")


@query("a3_first_documents", "SELECT CAST(conv_id AS VARCHAR) AS conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 10 <> 9 ORDER BY conv_id LIMIT 20)")
def a3(spark, sf_dir):
    """The first 20 documents of the files in input order; broken files don't count."""
    return dialogue.read_documents(spark, document_files(spark, sf_dir), 20).select("conv_id")


@query("a4_saved_answers", f"SELECT CASE WHEN conv_id % 2 = 0 THEN 'map' ELSE 'list' END AS method, CAST(conv_id AS VARCHAR) AS conv_id, CAST(CASE WHEN conv_id % 2 = 0 THEN turn_ord + 10 ELSE turn_ord END AS INT) AS q_index, text AS prediction FROM ({TURNS}) WHERE conv_id % 7 <> 6")
def a4(spark, sf_dir):
    """Answers saved as a map by index (even conversations) or as a list, in files of a document a line; every seventh is broken."""
    item = F.struct("turn_ord", F.to_json(F.struct(F.col("text").alias("prediction"))).alias("j"))
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("r"))
    as_map = F.concat(F.lit("{"), F.array_join(F.transform("r", lambda x: F.concat(F.lit('"'), (x["turn_ord"] + 10).cast("string"), F.lit('":'), x["j"])), ","), F.lit("}"))
    as_list = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]"))
    even = F.col("conv_id") % 2 == 0
    body = F.concat(F.lit('{"method":"'), F.when(even, "map").otherwise("list"), F.lit('","conv_id":"'), "conv_id", F.lit('","records":'), F.when(even, as_map).otherwise(as_list), F.lit("}"))
    files = rows.select(F.when(F.col("conv_id") % 7 == 6, F.lit("{broken")).otherwise(body).alias("value"))
    path = shared_folder(spark)
    files.write.text(path)
    return stored_records.read_answers(spark, path).select("method", "conv_id", "q_index", "prediction")


@query("a6_layers_round_trip", MEMORY + "SELECT 'qa' AS layer, conv_id, qa_id AS id, segment_id AS parent, user_input AS text, array_to_string(entities, '|') AS list FROM qa UNION ALL SELECT 'segments', conv_id, segment_id, experience_id, intent, array_to_string(qa_ids, '|') FROM seg")
def a6(spark, sf_dir):
    """The exchanges and segments of a memory that were written and read again."""
    path, qa = shared_folder(spark), kept(hierarchy.exact_topic_memory(records(spark, sf_dir)))
    stored_records.write_layers({"qa": qa, "segments": hierarchy.segments_of(qa)}, path, 8)
    qa, segments = (stored_records.read_layer(spark, path, name) for name in ("qa", "segments"))
    first = qa.select(F.lit("qa").alias("layer"), "conv_id", F.col("qa_id").alias("id"), F.col("segment_id").alias("parent"), F.col("user_input").alias("text"), F.array_join("entities", "|").alias("list"))
    return first.union(segments.select(F.lit("segments"), "conv_id", "segment_id", "experience_id", "intent", F.array_join("qa_ids", "|")))


@query(
    "a7_json_columns",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(role) WHEN 2 THEN role ELSE '' END AS summary, CASE turn % 3 WHEN 0 THEN 1 ELSE 0 END AS n_entities FROM conversations""",
)
def a7(spark, sf_dir):
    k, role = F.col("turn") % 4, F.to_json(F.struct(F.lit(" ").alias("long"), F.col("role").alias("short")))
    summary = F.when(k == 0, F.col("text")).when(k == 1, F.to_json(F.struct(F.col("role").alias("summary")))).when(k == 2, role).otherwise(F.lit("{broken"))
    entities = F.when(F.col("turn") % 3 == 0, F.to_json(F.array("role", F.lit(" ")))).when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parse.summary_text(summary).alias("summary"), F.size(parse.json_strings(entities)).alias("n_entities"))


@query(
    "a8_compacted_log",
    "SELECT user_id AS id, max(event_id) AS seq_id, arg_max(value, event_id) AS vector, arg_max(event_type, event_id) AS metadata FROM events WHERE value IS NOT NULL AND event_id % 4 <> 0 GROUP BY user_id",
)
def a8(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("vector"), F.col("event_type").alias("metadata"))
    return stored_records.compacted(log).select("id", "seq_id", "vector", "metadata")


@query("a9_decoded_vectors", "SELECT vec_id, embedding AS vector, embedding IS NOT NULL AS same FROM embeddings")
def a9(spark, sf_dir):
    """Vectors packed as little-endian floats and decoded again."""
    @F.pandas_udf(T.BinaryType())
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes())

    rows = table(spark, sf_dir, "embeddings").withColumn("blob", pack("embedding"))
    return rows.select("vec_id", stored_records.float32_vector("blob").alias("vector"), (stored_records.float32_vector("blob") == F.col("embedding").cast("array<float>")).alias("same"))


@query("a10_vector_metadata", """SELECT 'qa:' || conv_id || '_' || turn AS key, CASE WHEN turn % 2 = 0 THEN '["' || role || '"]' END AS even, role, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS n_fields FROM conversations""")
def a10(spark, sf_dir):
    fields = F.create_map(F.lit("role"), F.col("role"), F.lit("even"), F.when(F.col("turn") % 2 == 0, F.to_json(F.array("role"))))
    key, given = stored_records.vector_metadata(F.lit("qa"), F.concat_ws("_", "conv_id", "turn"), fields)
    return table(spark, sf_dir, "conversations").select(key.alias("key"), F.try_element_at(given, F.lit("even")).alias("even"), F.try_element_at(given, F.lit("role")).alias("role"), F.size(given).alias("n_fields"))


@query("a11_trace", f"""SELECT conv_id AS q_index, i AS step_order, CASE i WHEN 0 THEN 'topic_extraction' ELSE 'retrieval' END AS step, CASE i WHEN 0 THEN '{{"topic":"' || topic || '"}}' ELSE '{{"dia_id":"' || dia_id || '"}}' END AS data FROM ({RECORDS}), (SELECT unnest([0, 1]) AS i)""")
def a11(spark, sf_dir):
    r = records(spark, sf_dir)
    return stored_records.trace({"topic_extraction": r.select(F.col("conv_id").alias("q_index"), "topic"), "retrieval": r.select(F.col("conv_id").alias("q_index"), "dia_id")})


@query("u1_model_responses", "SELECT conv_id, turn, CASE WHEN text LIKE '%a%' THEN upper(role) ELSE 'none' END AS response, text NOT LIKE '%a%' AS failed FROM conversations")
def u1(spark, sf_dir):
    """A stand-in model that fails on prompts without the letter a."""

    def model(prompts: list[str]) -> list[str]:
        if any("a" not in p.partition("|")[2] for p in prompts):
            raise ValueError("no a")
        return [p.partition("|")[0].upper() for p in prompts]

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", "text").alias("prompt"))
    return models.call_model(rows, "prompt", model, fallback="none", retries=0).select("conv_id", "turn", "response", F.col("error").isNotNull().alias("failed"))


@query(
    "u2_compared_methods",
    f"""WITH l AS (SELECT *, '[' || speaker || ']: ' || text AS line FROM ({TURNS}))
    SELECT 'full_context' AS method, a.conv_id * 1000000 + a.turn_ord AS query_id, string_agg(b.dia_id, ',' ORDER BY b.turn_ord) AS ids, string_agg(b.line, chr(10) ORDER BY b.turn_ord) AS context FROM l AS a JOIN l AS b USING (conv_id) GROUP BY ALL
    UNION ALL SELECT 'recent_turns', a.conv_id * 1000000 + a.turn_ord, string_agg(b.dia_id, ',' ORDER BY b.turn_ord DESC), string_agg(b.line, chr(10) ORDER BY b.turn_ord DESC) FROM l AS a JOIN l AS b ON a.conv_id = b.conv_id AND b.turn_ord BETWEEN a.turn_ord - 2 AND a.turn_ord GROUP BY ALL""",
)
def u2(spark, sf_dir):
    """Two memory methods behind one interface, asked the same questions."""
    rows = turns(spark, sf_dir)
    questions = rows.select("conv_id", "turn_ord", query_id(), F.col("text").alias("question"))
    found = models.compare([models.FullContext(), models.RecentTurns(3)], rows, questions)
    return found.select("method", "query_id", F.array_join("retrieved_ids", ",").alias("ids"), "context")


@query("a5_report_files", "SELECT f AS format, role AS method, count(*) AS n_questions, max(turn) AS last FROM conversations, (SELECT unnest(['json', 'csv']) AS f) GROUP BY ALL")
def a5b(spark, sf_dir):
    """A report written as JSON, CSV and Markdown, and read again."""
    report = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("method")).agg(F.count("*").alias("n_questions"), F.max("turn").cast("long").alias("last"))
    path = shared_folder(spark)
    stored_records.write_report(report, evaluation.markdown_rows(report, ["method"]), path)
    read = {"json": spark.read.schema(report.schema).json(f"{path}/json"), "csv": spark.read.schema(report.schema).option("header", True).csv(f"{path}/csv")}
    first, second = (rows.select(F.lit(name).alias("format"), *report.columns) for name, rows in read.items())
    return first.union(second)


def _streamed(spark, parts, job, mode="append"):
    """Run a streaming job over ``parts``, written to files one after the other first, until all are read; its output as a table."""
    path = shared_folder(spark)
    for rows in parts:
        rows.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    q = job(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").format("parquet").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _routed_files(spark, parts):
    """Keyed state needs its store; the setting is put back after the run."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ingest.STATE_STORE)
    try:
        return _streamed(spark, parts, ingest.routed_stream)
    finally:
        spark.conf.set(name, before)


@query("s1_streamed_routing")
def s1(spark, sf_dir):
    """Files in any order: later turns may come first, and what then comes late is rejected."""
    return _routed_files(spark, [hierarchy.with_defaults(records(spark, sf_dir)).repartition(4)])


@query("s1_streamed_in_order", ROUTED)
def s1b(spark, sf_dir):
    """Files in the order of the turns, a conversation's turns spread over several micro-batches: the rows of the batch job."""
    rows = hierarchy.with_defaults(records(spark, sf_dir)).repartition(4, "conv_id")
    return _routed_files(spark, [rows.where(when) for when in ("turn_ord < 1", "turn_ord >= 1 and turn_ord < 3", "turn_ord >= 3 and turn_ord < 5", "turn_ord >= 5")])


@query("s2_streamed_upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def s2(spark, sf_dir):
    """The latest event of each user, merged micro-batch by micro-batch; every file is delivered twice."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    rows.repartition(3).write.parquet(f"{path}/in")
    rows.repartition(3).write.mode("append").parquet(f"{path}/in")
    merged = ingest.BucketedTable(spark, f"{path}/table", rows.schema, "user_id", "event_id", buckets=16)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(merged.merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return merged.read()
