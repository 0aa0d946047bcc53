"""Two-stage suffix arrays and byte-level removal of repeats against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memjobs.llm import suffixes as S

SCHEMA = "doc_id long, text string, n_bytes string, spans string, doc string, salt string"


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 40), st.randoms(use_true_random=False))
def test_suffix_order_equals_sorting(raw, depth, rng):
    text = np.frombuffer(raw, dtype=np.uint8)
    wanted = np.array([rng.random() < 0.7 for _ in raw], dtype=bool)
    order = S.suffix_order(text, wanted, depth).tolist()
    assert sorted(order) == np.flatnonzero(wanted).tolist()
    padded = [raw[i : i + depth].ljust(depth, b"\0") for i in order]
    assert padded == sorted(padded)


@pytest.mark.parametrize("size", [3000, 40_000])
def test_suffix_order_of_texts(size):
    rng = random.Random(size)
    words = [bytes(rng.choices(b"etaoin", k=rng.randint(1, 7))) for _ in range(40)]
    raw = b" ".join(rng.choices(words, k=size // 5)) + b"z" * 900 + b"a" * 900
    raw = raw + raw[100:1500] + b"\xff"
    text = np.frombuffer(raw, dtype=np.uint8)
    order = S.suffix_order(text, np.ones(len(text), bool), 200)
    suffixes = [raw[i : i + 200] for i in order]
    assert sorted(order.tolist()) == list(range(len(raw))) and suffixes == sorted(suffixes)


def brute(texts, length):
    """Removed byte places of each text."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    return [{p for i in range(len(r) - length + 1) if times[r[i : i + length]] > 1 for p in range(i, i + length)} for r in raw]


def made_texts(seed, n=50):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ß中", k=rng.randint(1, 8))) for _ in range(200)]
    passage = " ".join(rng.choices(words, k=70))
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            w = list(rng.choice(out))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w) + 1) : rng.randrange(len(w) + 1)] = rng.choices("xyz", k=2)
            out.append("".join(w))
        elif kind < 0.65:
            out.append(" ".join(rng.choices(words, k=rng.randint(0, 60))) + passage[: rng.randint(100, 400)] + " ".join(rng.choices(words, k=20)))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(1, 120))))
    twice = " ".join(rng.choices(words, k=50))
    return [*out, twice + "|" + twice, "a" * 500, "b" * 199, "c" * 200, "c" * 200, "ab" * 300, "\x00" * 250, None, "", " \n", "é" * 101, "é" * 100 + "x"]


@pytest.mark.parametrize(("length", "part"), [(200, S.PART), (50, S.PART), (200, 3), (7, 2)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, length, part):
    """With small parts, anchors are dealt, and windows of different parts are counted by Spark."""
    if part != S.PART:
        monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "SORTED", 20_000)
    texts = made_texts(length + part)
    rows = [(i, t, "x", "y", "z", "v") for i, t in enumerate(texts)] + [(None, texts[0], *"abcd"), (None, None, *"abcd"), (None, "d" * 210, *"abcd")]
    rows += [rows[2], rows[2], (5, texts[8], *"abcd")]
    path = f"file://{tmp_path}/t"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    want = defaultdict(list)
    for r, gone in zip(rows, brute([r[1] for r in rows], length), strict=True):
        raw = (r[1] or "").encode()
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        spans = sum(p - 1 not in gone for p in gone)
        want[r[0]].append((len(raw), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = defaultdict(list)
    for r in S.query(spark, path, length).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_removed_rows_keep_their_columns(spark):
    text = "This very passage stands twice in the table, word for word. " * 5
    df = spark.createDataFrame([(1, text + "one", "n", "s", "d", "q"), (2, "two" + text, "n", "s", "d", "q")], SCHEMA)
    got = {r.doc_id: r for r in S.remove_repeats(df).collect()}
    assert (bytes(got[1].kept_bytes), bytes(got[2].kept_bytes)) == (b"one", b"two")
    assert got[1].removed_spans == [[0, 300]] and got[2].removed_spans == [[3, 303]]
    assert (got[1].n_bytes, got[1].spans, got[1].doc, got[1].salt) == ("n", "s", "d", "q")
