"""Streaming twins of the batch jobs: routing with state for each conversation, and upserts where the latest wins.

Rows of a conversation must come in order (turn_ord, rec_ord); inside a micro-batch they are sorted. Rows at or before
the last one seen are late: they come out with action ``rejected_late`` and change nothing, so replays are harmless.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memjobs.operators.routing import COLUMNS, INPUT, OUTPUT, Memory, Router, routed_row

#: Keyed state needs the store that keeps maps on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Kept(MutableMapping):
    """A map state as a mapping: an entry is read when it is first asked for, and written once, by ``flush``, if it changed."""

    def __init__(self, state, to_key: Callable, to_value: Callable, from_value: Callable):
        self.state, self.to_key, self.to_value, self.from_value = state, to_key, to_value, from_value
        self.known: dict = {}
        self.changed: set = set()

    def __getitem__(self, key):
        if key not in self.known:
            found = self.state.getValue(self.to_key(key))  # one call to the store; null if there is none
            if found is None:
                raise KeyError(key)
            self.known[key] = self.from_value(found)
        return self.known[key]

    def __setitem__(self, key, value) -> None:
        self.known[key] = value
        self.changed.add(key)

    def __delitem__(self, key) -> None:
        raise NotImplementedError("state only grows")

    def __iter__(self):
        raise NotImplementedError("entries are read one by one")

    def __len__(self) -> int:
        raise NotImplementedError("entries are read one by one")

    def flush(self) -> int:
        for key in self.changed:
            self.state.updateValue(self.to_key(key), self.to_value(self.known[key]))
        return len(self.changed)


class Routing(StatefulProcessor):
    """State of a conversation: a value for its counters, and map entries for experiences, segments and intents seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq int, current int, turn int, rec int, size int")
        self.experiences = handle.getMapState("experiences", "number int", "topic string, core_entity string, sums array<double>, segments int, recent array<int>, version int, fresh int")
        self.segments = handle.getMapState("segments", "experience int, number int", "intent string, size int, fresh int, version int")
        self.intents = handle.getMapState("intents", "experience int, intent string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        def fields(names: tuple[str, ...]) -> tuple[Callable, Callable]:
            return lambda v: tuple(v[n] for n in names), lambda t: {n: list(x) if n in ("sums", "recent") else x for n, x in zip(names, t, strict=True)}

        maps = (
            Kept(self.experiences, lambda k: (k,), *fields(Memory.EXPERIENCE)), Kept(self.segments, tuple, *fields(Memory.SEGMENT)),
            Kept(self.intents, tuple, lambda v: (v,), lambda t: t[0]),
        )
        names = ("seq", "current", "turn", "rec", "size")
        found = self.head.get()
        head = None if found is None else dict(zip(names, found, strict=True))
        router = Router(int(key[0]), memory=Memory(head, *maps))
        frame = pd.concat(list(rows)).sort_values(["turn_ord", "rec_ord"], kind="stable")
        yield routed_or_late(router, frame)
        self.head.update(tuple(router.memory.head[n] for n in names))
        for m in maps:
            m.flush()

    def close(self) -> None:
        pass


def routed_or_late(router: Router, rows: pd.DataFrame) -> pd.DataFrame:
    """Sorted rows routed; those at or before the last one seen are rejected."""
    out = []
    for values in zip(*(rows[c] for c in INPUT), strict=True):
        place = values[:2]
        if place <= router.last:
            out.append({c: None for c in COLUMNS} | {"conv_id": router.conv_id, "turn_ord": place[0], "rec_ord": place[1], "action": "rejected_late"})
        else:
            out.append(routed_row(router, *values))
    whole = ["turn_ord", "rec_ord", "seq", "segment_version", "experience_version"]
    return pd.DataFrame(out, columns=COLUMNS).astype({c: "Int32" for c in whole})


def routed_stream(records: DataFrame) -> DataFrame:
    """The streaming twin of ``operators.routing.routed``: the same rows for the same ordered input, whatever the batches.

    A micro-batch reads and writes the state entries that its records touch; where the topic changes it also reads the
    experiences of that conversation. ``spark.sql.streaming.stateStore.providerClass`` must be ``STATE_STORE``.
    """
    rows = records.select("conv_id", "turn_ord", "rec_ord", "topic", "core_entity", "intent")
    return rows.groupBy("conv_id").transformWithStateInPandas(Routing(), OUTPUT, "Append", "None")


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class BucketedTable:
    """A table of the latest row of each key, in buckets of keys; a micro-batch rewrites only the buckets that it touches.

    ``path/data/batch=N/bucket=B`` holds bucket B as micro-batch N left it, ``path/log/batch=N`` lists the buckets that N
    wrote. A bucket's rows are those of its last logged batch, so readers never see half a batch, and a batch that is
    delivered again writes the same files again. The number of buckets is fixed when the table is made; choose it so
    that a bucket is some hundred MB. Of rows with equal key and order any one stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, order: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/log") if there else None

    def _current(self, before: int | None, only: list[int] | None) -> DataFrame:
        """The rows of some buckets (all by default) as the batches before ``before`` left them."""
        log, empty = self._log(), self.spark.createDataFrame([], self.schema)
        if log is None:
            return empty
        log = log if before is None else log.where(F.col("batch") < before)
        log = log if only is None else log.where(F.col("bucket").isin(only))
        last = log.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # at most a row a bucket
        folders = [f"{self.path}/data/batch={r.batch}/bucket={r.bucket}" for r in last]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else empty

    def read(self) -> DataFrame:
        return self._current(None, None)

    def merge(self, batch: DataFrame, number: int) -> None:
        """A ``foreachBatch`` function. The batch is read twice: once for its buckets, once for its rows."""
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return
        names = [f.name for f in self.schema.fields]
        new = latest_rows(batch.select(*names), self.key, self.order)
        every = latest_rows(self._current(number, touched).unionByName(new), self.key, self.order)
        every.withColumn("bucket", self.bucket()).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
