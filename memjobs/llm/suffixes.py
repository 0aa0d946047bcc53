"""Removal of byte strings that occur anywhere else too, by suffix arrays sorted in two stages.

A window is a string of ``length`` bytes that starts in a document. A byte goes if a window that covers it also starts
at another place, of the same document or of another; windows are judged on the input and never cross documents.

Which passages must meet in one suffix array:

* Of the strings of about a third of a window ("anchors"), each window has one with the least hash. Equal windows have
  equal ones. Tasks list the anchors that are the least of some window, and Spark counts them by hash; those that stand
  at one place alone are dropped, as no window with such a least anchor repeats.
* A passage is a run of windows with one least anchor. Equal passages of a task are joined. Spark deals passages by
  anchor, so all windows that can be equal meet.

There a suffix array is made of many passages at a time, in two stages: suffixes smaller than their successors are sorted
directly, by eight bytes at a time and only as far as they are tied; all others are induced from them by one scan over
the buckets of first bytes. Windows are equal where neighbours in the array have a common prefix of ``length`` bytes, which
is compared byte by byte. Only window starts, and what is needed to induce them, enter the array.

Anchors that very many places share are dealt into ``salts`` parts, by a hash of the passage, so that no task gets a group
that grows with the input. Each part has its own suffix array and hands on one row for each different window, by a
128-bit digest; Spark counts these, which settles what repeats between parts.

Each row is a document: rows that repeat an id and a text are copies of each other, and all of their windows repeat. Null
ids are allowed, null texts are empty. An empty table gives no rows. Texts are used whole, whatever their length. Columns
other than id and text pass through ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import extended, mixed, raw_texts, set_aside, sliced, stored, table, window_hashes
from memjobs.llm.substrings import _sliding, chosen_windows

#: Anchors that a task gathers, bytes of passages that it joins, and bytes of a suffix array: these bound its memory, not the result.
ANCHORS, JOINED, SORTED = 500_000, 6_000_000, 2_000_000
#: Places of an anchor for each of its parts.
PART = 16_384
#: Between passages; matches end before it, so texts may hold it.
END = 0xFF
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
PLACE = np.dtype([("start", "<i4"), ("salts", "<i4"), ("hash", "<u8")])
MEMBER = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("start", "<i4")])


# -- the suffix array


def eight_bytes(text: np.ndarray, behind: int) -> np.ndarray:
    """The eight bytes from each place as one number that sorts like them; zeros follow the text, for ``behind`` more places."""
    padded = np.concatenate([text, np.zeros(behind + 8, dtype=np.uint8)]).astype(np.uint64)
    size = 1
    while size < 8:
        padded = (padded[:-size] << np.uint64(8 * size)) | padded[size:]
        size *= 2
    return padded


def _shift(depth: int, at: int) -> np.uint64:
    """How far the eight bytes at ``at`` reach beyond ``depth``, in bits."""
    return np.uint64(8 * max(0, at + 8 - depth))


def sorted_directly(keys: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the first ``depth`` bytes from each: eight more bytes a round, for those still tied that aren't all equal."""
    key = keys[places] >> _shift(depth, 0)
    order = np.argsort(key)
    out, key = places[order], key[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    slots = np.arange(len(out))
    for at in range(8, depth, 8):
        single = new & np.append(new[1:], True)
        slots, new = slots[~single], new[~single]
        if at in (32, 64, 128) and len(slots):  # by now most ties are copies: groups that are equal to the end need no more rounds
            group = np.cumsum(new) - 1
            lead, own = out[slots[new]], out[slots]
            same = np.ones(len(slots), dtype=bool)
            for ahead in range(at, depth, 8):
                live = np.flatnonzero(same)
                s = _shift(depth, ahead)
                same[live] = (keys[own[live] + ahead] >> s) == (keys[lead[group[live]] + ahead] >> s)
            mixed_groups = np.bincount(group, ~same) > 0
            slots, new = slots[mixed_groups[group]], new[mixed_groups[group]]
        if not len(slots):
            break
        group = np.cumsum(new).astype(np.uint64)
        key = keys[out[slots] + at] >> _shift(depth, at)
        order = np.argsort(key)
        rank = np.empty(len(key), dtype=np.uint64)
        step = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], (step[1:] != step[:-1])])).astype(np.uint64)
        both = (group << np.uint64(32)) | rank
        order = np.argsort(both)
        out[slots] = out[slots][order]
        both = both[order]
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """The ``wanted`` places (a mask) by the suffixes that start there; order among suffixes equal for ``depth`` bytes is open."""
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    keys = eight_bytes(text, depth) if keys is None else keys
    # runs of one byte share a type: smaller than the successor if a greater byte follows the run
    begins = np.concatenate([[0], np.flatnonzero(text[1:] != text[:-1]) + 1])
    sizes = np.diff(np.append(begins, n))
    heads = text[begins]
    rising = np.repeat(np.append(heads[1:] > heads[:-1], False), sizes)
    run = np.repeat(begins, sizes)
    # a falling suffix is induced from its successor, so that one is needed too
    at = np.arange(n)
    last_wanted = np.maximum.accumulate(np.where(wanted, at, -1))
    last_rising = np.concatenate([[-1], np.maximum.accumulate(np.where(rising, at, -1))[:-1]])
    needed = wanted | (last_wanted > last_rising)
    before = np.cumsum(needed) - needed
    falls, rises = np.bincount(text[needed & ~rising], minlength=256), np.bincount(text[needed & rising], minlength=256)
    start = np.cumsum(falls + rises) - falls - rises
    rise_start = start + falls
    out = np.empty(int(needed.sum()), dtype=np.int64)
    direct = sorted_directly(keys, np.flatnonzero(needed & rising), depth)
    first = np.cumsum(rises) - rises
    of = text[direct]
    out[rise_start[of] + np.arange(len(direct)) - first[of]] = direct
    head = start.copy()

    def induce(entries: np.ndarray, byte: int) -> None:
        """The predecessors that are falling and start with another byte, behind what stands in their buckets."""
        left = entries[entries > 0] - 1
        left = left[needed[left] & (text[left] > byte)]
        if len(left):
            into = text[left]
            order = np.argsort(into, kind="stable")
            left, into = left[order], into[order]
            counts = np.bincount(into, minlength=256)
            begin = np.cumsum(counts) - counts
            out[head[into] + np.arange(len(left)) - begin[into]] = left
            np.add(head, counts, out=head)

    if needed[-1]:  # the empty suffix is the least of all
        out[head[text[-1]]] = n - 1
        head[text[-1]] += 1
    for byte in np.flatnonzero(falls + rises):
        if falls[byte]:
            ends = out[start[byte] : head[byte]]  # last places of runs; then those one further from the end, and so on
            back = before[ends] - before[run[ends]]
            if back.any():
                source = np.repeat(np.arange(len(ends)), back + 1)
                far = np.arange(len(source)) - np.repeat(np.cumsum(back + 1) - back - 1, back + 1)
                order = np.argsort(far, kind="stable")
                ends = (ends[source] - far)[order]
                out[start[byte] : start[byte] + len(ends)] = ends
            induce(ends, byte)
        if rises[byte]:
            induce(out[rise_start[byte] : rise_start[byte] + rises[byte]], byte)
    return out[wanted[out]]


def equal_neighbours(keys: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each place but the first has a common prefix of ``depth`` bytes with the one before it."""
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        s = _shift(depth, at)
        live = live[(keys[order[live] + at] >> s) == (keys[order[live - 1] + at] >> s)]
    same = np.zeros(max(0, len(order) - 1), dtype=bool)
    same[live - 1] = True
    return same


def repeated_windows(passages: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For passages joined by ``END``: where each begins, the joined bytes, which places start a window that another place
    starts too, and one place for each different window."""
    sizes = np.array([len(p) + 1 for p in passages], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(x for p in passages for x in (p, b"\xff")), dtype=np.uint8)
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    whole = sizes - 1 >= length
    np.add.at(edge, begin[whole], 1)
    np.add.at(edge, (begin + sizes - length)[whole], -1)
    wanted = np.cumsum(edge)[:-1] > 0
    keys = eight_bytes(text, length)
    order = suffix_order(text, wanted, length, keys)
    same = equal_neighbours(keys, order, length)
    repeated = np.zeros(len(text), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return begin, text, repeated, order[np.concatenate([[True], ~same])[: len(order)]]


# -- which passages meet


def anchor_hashes(raw: bytes, anchor: int) -> np.ndarray:
    return window_hashes(BYTES[np.frombuffer(raw, dtype=np.uint8)], anchor)


def _binaries(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The items of ``rows`` from each of ``starts`` to the next as one binary value."""
    offsets = np.append(starts, len(rows)).astype(np.int64) * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the key of a document: its id (a fixed one for null) and 32 bits of its text."""
    return docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__tag": F.hash(F.col(text_col).cast("string"))})


def _rows(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, bytes]]:
    return zip(batch.column("__doc").to_pylist(), batch.column("__tag").to_pylist(), raw_texts(batch, text_col), strict=True)


def _anchors(docs: DataFrame, text_col: str, length: int, anchor: int) -> DataFrame:
    """hash, and its places in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                g, m = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                order = np.argsort(g, kind="stable")
                g, m = g[order], m[order]
                starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                whole = pa.RecordBatch.from_arrays([pa.array(g[starts].view(np.int64)), _binaries(m, starts)], names=["hash", "members"])
                yield from (whole.slice(at, 50_000) for at in range(0, whole.num_rows, 50_000))

        count = 0
        for batch in sliced(batches, 500):
            for doc, tag, raw in _rows(batch, text_col):
                if len(raw) < length:
                    continue
                g = anchor_hashes(raw, anchor)
                at = chosen_windows(g, length - anchor + 1)
                m = np.empty(len(at), dtype=MEMBER)
                m["doc"], m["tag"], m["start"] = doc, tag, at
                held.append((g[at], m))
                count += len(at)
                if count >= ANCHORS:
                    yield from flush()
                    count = 0
        yield from flush()

    return docs.select("__doc", "__tag", text_col).mapInArrow(run, "hash long, members binary")


def _shared_places(anchors: DataFrame) -> DataFrame:
    """The places of each document whose anchor stands at another place too."""
    n = F.sum(F.octet_length("members")).over(Window.partitionBy("hash")) / MEMBER.itemsize
    shared = anchors.withColumn("n", n.cast("long")).where("n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members").to_pylist()
            m = np.frombuffer(b"".join(lists), dtype=MEMBER)
            times = np.array([len(x) // MEMBER.itemsize for x in lists], dtype=np.int64)
            p = np.empty(len(m), dtype=PLACE)
            p["start"] = m["start"]
            p["hash"] = np.repeat(np.asarray(batch.column("hash")).view(np.uint64), times)
            p["salts"] = np.repeat(np.asarray(batch.column("n")) // PART + 1, times)
            order = np.lexsort((m["tag"], m["doc"]))
            m, p = m[order], p[order]
            starts = np.flatnonzero(np.concatenate([[True], (m["doc"][1:] != m["doc"][:-1]) | (m["tag"][1:] != m["tag"][:-1])])) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m["doc"][starts]), pa.array(m["tag"][starts]), _binaries(p, starts)], names=["__at_doc", "__at_tag", "places"])

    rows = shared.mapInArrow(run, "__at_doc long, __at_tag int, places binary")
    return rows.groupBy("__at_doc", "__at_tag").agg(F.collect_list("places").alias("__places"))


PASSAGES = "hash long, salt int, hot boolean, passage binary, members binary"


def _passages(docs: DataFrame, text_col: str, length: int, anchor: int) -> DataFrame:
    """``docs`` with their ``__places``: runs of windows with one least anchor; equal ones of a task are one row."""
    span = length - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[tuple[int, int, bytes], list[tuple[int, int, int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(joined.items())
            for at in range(0, len(items), 5000):
                part = items[at : at + 5000]
                hot = [salts > 1 for (_, salts, _), _ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([g for (g, _, _), _ in part], dtype=np.uint64).view(np.int64)),
                        pa.array([xxhash.xxh3_64_intdigest(p) % salts if salts > 1 else 0 for (_, salts, p), _ in part], pa.int32()), pa.array(hot),
                        pa.array([p for (_, _, p), _ in part], pa.binary()), pa.array([np.array(m, dtype=MEMBER).tobytes() for _, m in part], pa.binary()),
                    ],
                    names=["hash", "salt", "hot", "passage", "members"],
                )
            joined.clear()

        for batch in sliced(batches, 500):
            for (doc, tag, raw), parts in zip(_rows(batch, text_col), batch.column("__places").to_pylist(), strict=True):
                p = np.frombuffer(b"".join(parts), dtype=PLACE)
                least = np.full(len(raw) - anchor + 1, FREE)
                least[p["start"]] = p["hash"]
                least = _sliding(least, span, np.minimum)
                edges = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                of = dict(zip(p["hash"].tolist(), p["salts"].tolist(), strict=True)) if p["salts"].max() > 1 else None
                for a, b, g in zip(edges[:-1].tolist(), edges[1:].tolist(), least[edges[:-1]].tolist(), strict=True):
                    if g != 0xFFFFFFFFFFFFFFFF:
                        passage = raw[a : b + length - 1]
                        key = (g, of[g] if of else 1, passage)
                        if key not in joined:
                            joined[key] = []
                            size += len(passage) + 200
                        joined[key].append((doc, tag, a))
                        size += 60
                if size >= JOINED:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, PASSAGES)


HITS = "doc long, tag int, spans binary, w1 long, w2 long, settled boolean"


def _hits(passages: DataFrame, length: int) -> DataFrame:
    """Spans of documents that repeated windows cover, from a suffix array for each part of a sorted partition.

    For anchors in several parts also a row for each different window, with its digest: ``settled`` if it repeats here.
    """

    def found(part: list[tuple[bytes, bytes, bool]]) -> Iterator[pa.RecordBatch]:
        begin, text, repeated, each = repeated_windows([p for p, _, _ in part], length)
        times = np.array([len(m) // MEMBER.itemsize for _, m, _ in part], dtype=np.int64)
        members = np.frombuffer(b"".join(m for _, m, _ in part), dtype=MEMBER)
        first = np.cumsum(times) - times
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        at = np.flatnonzero(repeated)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        several = np.flatnonzero(times > 1)
        np.add.at(edge, begin[several], 1)
        np.add.at(edge, begin[several] + np.array([len(part[k][0]) for k in several], dtype=np.int64), -1)
        covered = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        low, high = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
        of = np.searchsorted(begin, low, side="right") - 1
        copies = times[of]
        who = members[np.repeat(first[of], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)]
        spans = np.stack([np.repeat(low - begin[of], copies) + who["start"], np.repeat(high - begin[of], copies) + who["start"]], axis=1)
        order = np.lexsort((spans[:, 0], who["tag"], who["doc"]))
        who, spans = who[order], spans[order].astype("<i4")
        starts = np.flatnonzero(np.concatenate([[True], (who["doc"][1:] != who["doc"][:-1]) | (who["tag"][1:] != who["tag"][:-1])])) if len(who) else np.empty(0, np.int64)
        none = pa.nulls(len(starts), pa.int64())
        pairs = spans.reshape(-1).view("<i8") if len(spans) else np.empty(0, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(who["doc"][starts]), pa.array(who["tag"][starts]), _binaries(pairs, starts), none, none, pa.array(np.ones(len(starts), bool))], names=names)
        hot = np.array([h for _, _, h in part])
        if hot.any():
            of = np.searchsorted(begin, each, side="right") - 1
            each, of = each[hot[of]], of[hot[of]]
            raw = text.tobytes()
            for lo in range(0, len(each), 20_000):
                e, o = each[lo : lo + 20_000], of[lo : lo + 20_000]
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a : a + length]) for a in e.tolist()), dtype="<i8").reshape(-1, 2)
                lead = members[first[o]]
                here = (lead["start"] + e - begin[o]).astype("<i4")
                pairs = np.stack([here, here + length], axis=1).astype("<i4").reshape(-1).view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead["doc"]), pa.array(lead["tag"]), _binaries(pairs, np.arange(len(e))), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(repeated[e] | (times[o] > 1))], names=names
                )

    names = [c.split()[0] for c in HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in sliced(batches):
            for g, salt, hot, passage, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORTED and (g, salt) != last:
                    yield from found(held)
                    held, size = [], 0
                held.append((passage, members, hot))
                size, last = size + len(passage), (g, salt)
        if held:
            yield from found(held)

    return passages.repartition("hash", "salt").sortWithinPartitions("hash", "salt").mapInArrow(run, HITS)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``docs`` with ``__spans``, lists of (first, end) byte places that repeated windows cover, or null."""
    anchor = max(1, length * 8 // 25)
    known = _documents(docs, id_col, text_col)
    places = stored(_shared_places(_anchors(known, text_col, length, anchor)), "shared-places")
    same = [F.col("__doc") == F.col("__at_doc"), F.col("__tag") == F.col("__at_tag")]
    # with the id too, though it isn't read, these are the shuffled rows of the last join in ``query``, which Spark then makes once
    met = known.join(places, same).select("__doc", "__tag", id_col, text_col, "__places")
    hits = _hits(_passages(met, text_col, length, anchor), length)
    # spans have keys of their own, so that only windows of anchors in several parts meet
    own = F.xxhash64("doc", "tag", "spans")
    keyed = hits.withColumns({"w1": F.coalesce("w1", own), "more": F.col("w2").isNotNull(), "w2": F.coalesce("w2", "doc")})
    times = F.count(F.lit(1)).over(Window.partitionBy("more", "w1", "w2"))
    kept = keyed.withColumn("times", times).where(F.when(F.col("more"), ~F.col("settled") & (F.col("times") > 1)).otherwise(True))
    spans = kept.groupBy(F.col("doc").alias("__at_doc"), F.col("tag").alias("__at_tag")).agg(F.collect_list("spans").alias("__spans"))
    return known.join(spans, same, "left").drop("__at_doc", "__at_tag", "__doc", "__tag")


def merged(parts: list[bytes] | None) -> np.ndarray:
    """Maximal spans, in order, of lists of (first, end)."""
    spans = np.frombuffer(b"".join(parts or []), dtype="<i4").reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(first[1:], True)
    return np.stack([spans[first, 0], reach[last]], axis=1)


def kept_bytes(raw: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return raw
    out, at = [], 0
    for low, high in spans.tolist():
        out.append(raw[at:low])
        at = high
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the bytes that are left in ``kept_bytes`` (binary: a cut may fall inside a character) and the removed
    places in ``removed_spans``. A column of ``docs`` with one of these names is replaced."""
    docs, back = set_aside(docs, ("__doc", "__tag", "__at_doc", "__at_tag", "__places", "__spans"))
    fields = [T.StructField("kept_bytes", T.BinaryType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType())))]

    def compute(batch: pa.RecordBatch):
        spans = [merged(x) for x in batch.column("__spans").to_pylist()]
        yield pa.array([kept_bytes(raw, s) for raw, s in zip(raw_texts(batch, text_col), spans, strict=True)], pa.binary())
        yield pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int32())))

    return extended(_with_spans(docs, id_col, text_col, length), compute, fields, docs.columns).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str, length: int = 200) -> DataFrame:
    rows = _with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", length)
    fields = [*(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]

    def compute(batch: pa.RecordBatch):
        texts = raw_texts(batch, "text")
        spans = [merged(x) for x in batch.column("__spans").to_pylist()]
        yield pa.array([len(t) for t in texts], pa.int64())
        yield pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64())
        yield pa.array([len(s) for s in spans], pa.int64())
        yield pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string())

    return extended(rows, compute, fields, ["doc_id"])


#: Texts as hexadecimal digits, two a byte; cut into pieces of 512 window starts first, since long strings are slow to index.
ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
    SELECT r, 512 * k AS first, substr(x, 1024 * k + 1, 1422) AS y FROM (SELECT r, x, unnest(range(0, length(x) // 1024 + 1)) AS k FROM d WHERE length(x) >= 400)
), w AS (
    SELECT r, first + i AS i, md5(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT r, first, y, unnest(range(0, length(y) // 2 - 199)) AS i FROM c WHERE length(y) >= 400)
), again AS (
    SELECT r, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)
), edge AS (
    SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS new FROM again
), span AS (
    SELECT r, min(i) AS low, max(i) + 200 AS high FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM edge) GROUP BY r, g
), gap AS (
    SELECT r, low, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS after, high FROM span
), cut AS (
    SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, max(high) AS last FROM span GROUP BY r
), kept AS (
    SELECT r, string_agg(substr(x, 2 * after + 1, 2 * (low - after)), '' ORDER BY low) AS head FROM gap JOIN d USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
