"""N-gram Jaccard join: documents whose sets of word 5-grams have a similarity of at least 0.75, and their components.

The plan, by the method of token-combination prefixes:

1. One pass makes each document's set of shingle hashes. Documents with equal sets are one *node* (its key is a 128-bit
   digest of the set). Hashes go to the bucket of their value, and each bucket finds those that several nodes have; all
   others can't be in an intersection, and their number is all that is kept of them. This gives exact document
   frequencies over all documents. Tokens travel packed: a row holds what a task has for one bucket, or a bucket for one
   group of nodes, so there are never more rows than tokens, and far fewer while tasks hold many tokens a bucket.
2. A node orders its tokens from rare to frequent. If two sets are similar enough, they share more tokens of their
   prefixes than could avoid a common signature: a rare token is a signature by itself; frequent tokens are dealt to
   ``GROUPS`` groups, and each two of a group form one. Each group with a token in the prefix lengthens it by one.
   Sets too small for that (see ``size_limits``) use single tokens throughout; sets near that size use both.
3. Each node is compared with the most central node that it shares a signature with (the one with the fewest tokens of
   its own), and the links found are contracted to parts. Nodes that are then connected by signatures whose nodes are
   in several parts form a cluster. In a cluster, the nodes outside its largest part are compared with all others, in
   blocks; nodes of the largest part aren't compared with each other, as pairs inside a part can't change the result.
   Pairs that don't link are never written out.
4. A comparison intersects the nodes' shared hashes; the similarity is computed in whole numbers, without tolerance.

Shingles are compared by their 64-bit hashes: for two sets of 500 shingles, the chance that unequal ones count as equal
is below 2e-14. A bucket holds its share of all tokens at a time, and for a token that many nodes have ten bytes a node.

Texts without words or null have an empty set, link with nothing and are components of their own. Texts of fewer than
five words have their whole sequence as one shingle. Texts of any length are used whole. Rows without an id get no
component (null). Rows that repeat an id and a text are one row in the result; an id with several texts has a row for
each set, and links of any of them are links of the id. An empty table gives no rows. Other columns aren't read, so
their names don't matter; ties between equal sets are settled by the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import WordHashes, lower_ascii, mixed, raw_texts, set_aside, sliced, space_words, stored, table, window_hashes

#: Frequent tokens are those of more than 2 ** RARE nodes.
RARE = 5
GROUPS = 16
#: What a task gathers before it hands it on, and about how many tokens a bucket has; they bound memory, not results.
CHUNK_TOKENS, CHUNK_DOCS = 800_000, 60_000
BUCKET_TOKENS = 1_500_000
_DOC = np.dtype([("id", "<i8"), ("n", "<i8"), ("node", "S16")])


def shingle_set(raw: bytes, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = space_words(lower_ascii(raw))
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    return np.unique(window_hashes(hashes.of(words), n))


def _packed(keys: np.ndarray, owners: np.ndarray, nodes: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes where they fit, owners as two bytes, and the nodes that occur."""
    present, owners = np.unique(owners, return_inverse=True)
    step = np.diff(keys)
    short = len(step) > 0 and int(step.max()) < 1 << 48
    head = np.array([len(keys), len(present), short], dtype="<i8").tobytes()
    if short:
        body = [keys[:1].tobytes(), (step >> np.uint64(32)).astype("<u2").tobytes(), step.astype("<u4").tobytes()]
    else:
        body = [keys.tobytes()]
    return b"".join([head, *body, owners.astype("<u2").tobytes(), nodes[present].tobytes()])


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, short = np.frombuffer(raw, "<i8", 3).tolist()
    at = 24
    if short:
        first = np.frombuffer(raw, "<u8", 1, at)
        high = np.frombuffer(raw, "<u2", n - 1, at + 8).astype(np.uint64)
        low = np.frombuffer(raw, "<u4", n - 1, at + 8 + 2 * (n - 1)).astype(np.uint64)
        keys = np.cumsum(np.concatenate([first, high << np.uint64(32) | low]), dtype=np.uint64)
        at += 8 + 6 * (n - 1)
    else:
        keys = np.frombuffer(raw, "<u8", n, at)
        at += 8 * n
    owners = np.frombuffer(raw, "<u2", n, at)
    return keys, owners, np.frombuffer(raw, "S16", m, at + 2 * n)


def _packed_nodes(names: np.ndarray, sizes: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> bytes:
    """Nodes, the number of keys of each, and all keys with their ranks, one node after the other."""
    return b"".join([len(names).to_bytes(8, "little"), names.tobytes(), sizes.astype("<u4").tobytes(), keys.tobytes(), ranks.tobytes()])


def _unpacked_nodes(raw: bytes) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    m = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, "<u4", m, 8 + 16 * m)
    cuts, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 8 + 20 * m
    keys = np.frombuffer(raw, "<u8", cuts[-1], at)
    ranks = np.frombuffer(raw, np.uint8, cuts[-1], at + 8 * int(cuts[-1]))
    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        yield raw[8 + 16 * k : 24 + 16 * k], keys[x:y], ranks[x:y]


def _node(keys: np.ndarray) -> bytes:
    """A digest of a set. It never ends in a zero byte, which fixed-width byte strings would lose."""
    raw = xxhash.xxh3_128_digest(keys.tobytes())
    return raw[:15] + bytes([raw[15] | 1])


def _emit(docs: DataFrame, n_gram: int, n_buckets: int) -> DataFrame:
    """Rows (bucket, kind, payload): tokens of a task's nodes by bucket, and its documents."""
    edges = np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], dtype=np.uint64)

    def flush(rows: list[tuple], sets: list[np.ndarray], nodes: list[bytes], turn: int):
        buckets, kinds, payloads = [], [], []
        if sets:
            keys = np.concatenate(sets)
            owners = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(keys, kind="stable").astype(np.int32)
            keys, owners, names = keys[order], owners[order], np.array(nodes, dtype="S16")
            sets.clear()
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    buckets.append(b)
                    kinds.append(0)
                    payloads.append(_packed(keys[x:y], owners[x:y], names))
        for k, at in enumerate(range(0, len(rows), 5000)):
            buckets.append((turn + k) % n_buckets)
            kinds.append(1)
            payloads.append(np.array(rows[at : at + 5000], dtype=_DOC).tobytes())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "kind": pa.array(kinds, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, sets, nodes, seen, count, turn = WordHashes(150_000), [], [], [], set(), 0, 0
        for batch in sliced(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text"), strict=True):
                turn = turn or hash(doc) % n_buckets
                keys = shingle_set(raw, hashes, n_gram)
                node = _node(keys)
                rows.append((doc, len(keys), node))
                if len(keys) and node not in seen:
                    seen.add(node)
                    sets.append(keys)
                    nodes.append(node)
                    count += len(keys)
                if count >= CHUNK_TOKENS or len(rows) >= CHUNK_DOCS:
                    yield flush(rows, sets, nodes, turn)
                    rows, sets, nodes, seen, count = [], [], [], set(), 0
        if rows:
            yield flush(rows, sets, nodes, turn)

    return docs.mapInArrow(run, "bucket int, kind int, payload binary")


SHARED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("grp", T.LongType()),
        T.StructField("pack", T.BinaryType()),
    ]
)


def _group(node: Column, n_groups: int) -> Column:
    """The group of nodes that a node is gathered with, by its first four bytes."""
    return F.conv(F.hex(F.substring(node, 1, 4)), 16, 10).cast("long") % n_groups


def _shared(rows: DataFrame, n_groups: int) -> DataFrame:
    """The documents; and of each bucket, a row for each group of nodes: their hashes that other nodes have too, with the
    log2 of the frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, names, base = [], [], [], 0
        for batch in batches:
            docs = []
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind:
                    docs.append(np.frombuffer(payload, _DOC))
                else:
                    k, o, n = _unpacked(payload)
                    keys.append(k)
                    owners.append(o.astype(np.int32) + base)
                    names.append(n)
                    base += len(n)
            if docs:
                d = np.concatenate(docs)
                columns = [pa.array(d["id"]), pa.array(d["n"]), pa.array(d["node"].tolist(), pa.binary()), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=SHARED.names)
        if not keys:
            return
        k, o = np.concatenate(keys), np.concatenate(owners)
        keys.clear(), owners.clear()
        # equal sets of different tasks are one node; nodes stand in the order of their groups
        nodes, number = np.unique(np.concatenate(names), return_inverse=True)
        names.clear()
        group = np.frombuffer(nodes.tobytes(), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % n_groups
        order = np.argsort(group, kind="stable")
        nodes, group, place = nodes[order], group[order], np.empty(len(nodes), dtype=np.int32)
        place[order] = np.arange(len(nodes), dtype=np.int32)
        o = place[number[o]]
        order = np.lexsort((o, k)).astype(np.int32)
        k, o = k[order], o[order]
        del order
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o = k[new], o[new]
        first = np.ones(len(k), dtype=bool)
        first[1:] = k[1:] != k[:-1]
        token = np.cumsum(first) - 1
        frequency = np.bincount(token)[token]
        several = frequency > 1
        k, o, rank = k[several], o[several], np.ceil(np.log2(frequency[several])).astype(np.uint8)
        order = np.argsort(o, kind="stable")
        k, o, rank = k[order], o[order], rank[order]
        present, sizes = np.unique(o, return_counts=True)
        if not len(present):
            return
        end = np.concatenate([[0], np.cumsum(sizes)])
        cuts = [0, *(np.flatnonzero(np.diff(group[present])) + 1).tolist(), len(present)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            pack = _packed_nodes(nodes[present[x:y]], sizes[x:y], k[end[x] : end[y]], rank[end[x] : end[y]])
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), pa.array([int(group[present[x]])]), pa.array([pack], pa.binary())], names=SHARED.names)

    return rows.mapInArrow(run, SHARED)


def size_limits(percent: int) -> tuple[int, int]:
    """Sets from the first size up index pairs of frequent tokens, sets up to the second one single tokens.

    From the first size up two similar sets share more than ``GROUPS`` tokens. A set above the second size has only
    partners of at least the first.
    """
    low = -(-(GROUPS + 1) * 100 // percent)
    return low, -(-low * 100 // percent)


def signatures(n: int, keys: np.ndarray, ranks: np.ndarray, percent: int = 75) -> np.ndarray:
    """Signatures of a set of ``n`` tokens, of which ``keys`` are those that other sets have."""
    order = np.lexsort((keys, ranks))
    keys, frequent = keys[order], ranks[order] > RARE
    overlap = (percent * n + 99) // 100
    prefix = n - overlap + 1 - (n - len(keys))  # tokens of the prefix that others have
    out, (low, high) = [], size_limits(percent)
    if n <= high:
        out.append(mixed(keys[: max(prefix, 0)]))
    if n >= low:
        part = (keys % np.uint64(GROUPS)).astype(np.int64)
        met, take = set(), 0
        while take < len(keys) and take < prefix + len(met):
            if frequent[take]:
                met.add(int(part[take]))
            take += 1
        if n > high:
            out.append(mixed(keys[:take][~frequent[:take]]))
        dense, part = keys[:take][frequent[:take]], part[:take][frequent[:take]]
        for g in met:
            a = np.sort(dense[part == g])
            i, j = np.triu_indices(len(a), 1)
            out.append(mixed(mixed(a[i]) * np.uint64(3) + a[j]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


NODES = "rep long, n long, keys binary, sigs array<long>"


def _nodes(packs: DataFrame, names: DataFrame, n_groups: int, percent: int) -> DataFrame:
    """rep (smallest document of the node), n, keys, sigs of all nodes that have a signature."""

    def run(packs: pa.Table, names: pa.Table) -> pa.Table:
        sets: dict[bytes, tuple[list, list]] = {}
        for raw in packs.column("pack").to_pylist():
            for node, keys, ranks in _unpacked_nodes(raw):
                found = sets.setdefault(node, ([], []))
                found[0].append(keys)
                found[1].append(ranks)
        rows: list[list] = [[], [], [], []]
        for node, rep, n in zip(*(names.column(c).to_pylist() for c in ("node", "rep", "n")), strict=True):
            if node in sets:
                keys, ranks = map(np.concatenate, sets.pop(node))
                sigs = signatures(n, keys, ranks, percent)
                if len(sigs):
                    for column, value in zip(rows, (rep, n, np.sort(keys).tobytes(), sigs.view(np.int64)), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["rep", "n", "keys", "sigs"])

    grouped = names.select("node", "rep", "n", _group(F.col("node"), n_groups).alias("grp")).groupBy("grp")
    return packs.groupBy("grp").cogroup(grouped).applyInArrow(run, NODES)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, with their similarity's whole numbers compared exactly."""
    left = nodes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"))
    right = nodes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "keys_a", "keys_b")), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (n_a + n_b - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "keys_a", "keys_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable): alternating stars, each a grouping and a join, until nothing changes.

    The least neighbours are written before they are joined, so that Spark can split the rows of a hub.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        # large star: the larger neighbours of each node go to its least neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = edges.join(least, "b").select("a", F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "edges")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


#: About how many nodes, or tokens, a block of a cluster has; two blocks are compared in a task.
BLOCK, BLOCK_TOKENS = 256, 1_000_000


def _block_links(percent: int):
    """Links between different parts among the nodes of one or two blocks, from one matrix of shared tokens."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(k, "<u8") for k in rows["keys"]]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        keys, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times > 1
        place = np.cumsum(several) - 1
        kept = several[number]
        owner, number = owner[kept], place[number[kept]]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        for at in range(0, int(several.sum()), 4096):
            x, y = np.searchsorted(number, [at, at + 4096])
            has = np.zeros((len(sets), 4096), dtype=np.float32)
            has[owner[x:y], number[x:y] - at] = 1
            both += has @ has.T
        n, part, rep = (rows[c].to_numpy() for c in ("n", "part", "rep"))
        both = both.round().astype(np.int64)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        link &= part[:, None] < part[None, :]
        # one link for each two parts is enough
        i, j = np.nonzero(link)
        _, first = np.unique(np.stack([part[i], part[j]]), axis=1, return_index=True) if len(i) else (None, np.empty(0, dtype=np.int64))
        return pd.DataFrame({"a": rep[i[first]], "b": rep[j[first]]})

    return run


def _blocks(kind: str) -> Column:
    """Into how many blocks a cluster's nodes of a kind go."""
    several = F.greatest(F.ceil(F.col(f"{kind}_nodes") / BLOCK), F.ceil(F.col(f"{kind}_tokens") / BLOCK_TOKENS))
    return several.cast("int").alias(f"{kind}_blocks")


def _dealt(cluster: DataFrame) -> DataFrame:
    """Rows of ``cluster`` (component, part, rep, n, keys), each once for every two blocks (i, j) that it is compared in.

    The nodes of the largest part go to blocks of their own, which meet only the blocks of the others. With b nodes in
    the largest part and s others this makes 2 b s / ``BLOCK`` + s^2 / ``BLOCK`` rows.
    """
    parts = cluster.groupBy("component", "part").agg(F.count("*").alias("nodes"), F.sum(F.octet_length("keys") / 8).alias("tokens"))
    whole = parts.groupBy("component").agg(
        F.max_by("part", F.struct("nodes", "part")).alias("largest"), F.max(F.struct("nodes", "part", "tokens")).alias("big"), F.sum("nodes").alias("nodes"), F.sum("tokens").alias("tokens")
    )
    sized = whole.select(
        "component", "largest", F.col("big.nodes").alias("big_nodes"), F.col("big.tokens").alias("big_tokens"),
        (F.col("nodes") - F.col("big.nodes")).alias("other_nodes"), (F.col("tokens") - F.col("big.tokens")).alias("other_tokens"),
    ).where("other_nodes > 0")
    sized = stored(sized.select("component", "largest", _blocks("big"), _blocks("other")), "sizes")
    rows = cluster.join(sized, "component").withColumn("is_big", F.col("part") == F.col("largest"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_big"), F.col("big_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    # blocks of others are 0, 1, ...; those of the largest part are -1, -2, ...
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    every = F.when(F.col("is_big"), others).otherwise(F.concat(others, F.sequence(-F.col("big_blocks"), F.lit(-1))))
    block = F.when(F.col("is_big"), -1 - F.col("own")).otherwise(F.col("own"))
    met = rows.withColumn("block", block).withColumn("met", F.explode(every))
    return met.select("component", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"), "rep", "n", "part", "keys")


def _links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links that give the same components as all links do."""
    single = F.col("n") - (F.octet_length("keys") / 8).cast("long")  # tokens that no other node has
    sigs = nodes.select("rep", "n", single.alias("single"), F.explode("sigs").alias("sig"))
    # a node with few tokens of its own is at the centre of its group: most of the others link with it
    lead = sigs.groupBy("sig").agg(F.min(F.struct("single", "rep")).alias("lead"), F.min("rep").alias("y"), F.max("rep").alias("z")).where("y < z")
    lead = stored(lead.select("sig", "lead"), "leads")
    star = sigs.join(lead, "sig").where(F.col("lead.rep") != F.col("rep")).groupBy(F.col("rep").alias("b")).agg(F.min("lead").alias("lead"))
    found = stored(_verified(star.select(F.col("lead.rep").alias("a"), "b"), nodes, percent), "links")
    part = stored(components(found), "parts")
    known = sigs.select("rep", "sig").join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    known = stored(known.select("rep", "sig", "part"), "signatures")
    # signatures whose nodes are still in several parts
    open_sigs = known.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("rep").alias("b")).where("p < q").select("sig", "b")
    open_sigs = stored(open_sigs, "open-signatures")
    others = stored(components(known.join(open_sigs, "sig").select(F.col("rep").alias("a"), "b")), "clusters")
    # components() leaves out the smallest node of each
    cluster = others.union(others.select("component", "component").distinct()).withColumnRenamed("node", "rep")
    rows = cluster.join(nodes.select("rep", "n", "keys"), "rep").join(part.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left")
    rows = rows.select("component", "rep", F.coalesce("part", "rep").alias("part"), "n", "keys")
    return found.union(_dealt(rows).groupBy("component", "i", "j").applyInPandas(_block_links(percent), "a long, b long"))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_gram: int = 5) -> tuple[DataFrame, int]:
    """The rows of ``SHARED``: documents with set sizes and nodes; and nodes with their shared hashes. The number of groups."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (6 * BUCKET_TOKENS) + 1)
    rows = _emit(base, n_gram, n_buckets).repartitionById(n_buckets, F.col("bucket"))
    return stored(_shared(rows, n_buckets), "shared-tokens"), n_buckets


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_gram: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id. ``percent``: the least Jaccard similarity, in hundredths."""
    shared, n_groups = document_sets(docs, id_col, text_col, n_gram)
    members = shared.where("pack is null").select("doc_id", "n", "node").distinct()
    names = stored(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "names")
    nodes = stored(_nodes(shared.where("pack is not null").select("grp", "pack"), names, n_groups, percent), "nodes")
    part = stored(components(_links(nodes, percent)), "components")
    reps = members.where("n > 0").join(names.select("node", "rep"), "node")
    placed = reps.join(part, F.col("rep") == part["node"], "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    empty = members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = placed.union(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    lost = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long"))
    return every.union(lost)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_gram: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row, that of the smallest id, for each component; rows without id stay.

    Rows with the same id are one document: of those that stay, the one with the smallest text (null first) is kept.
    """
    docs, back = set_aside(docs, ("__kept", "__nth"))
    found = similar_components(docs, id_col, text_col, n_gram, percent)
    kept = found.groupBy("component_id").agg(F.min("doc_id").alias("__kept")).select("__kept")
    chosen = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi")
    first = Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.col(text_col).asc_nulls_first())
    one = chosen.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return one.union(docs.where(F.col(id_col).isNull())).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS t
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
    SELECT x.a, x.b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s AS l JOIN s AS r ON l.t = r.t AND l.doc_id <> r.doc_id GROUP BY ALL) AS x
    JOIN n AS p ON p.doc_id = x.a JOIN n AS q ON q.doc_id = x.b WHERE 100 * k >= 75 * (p.n + q.n - k)
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""
