"""SentencePiece encoding and decoding with a Viterbi pass that words with a common beginning share.

Spaces become the mark U+2581, and no piece has a mark after another character, so a text falls apart into marked
words that are encoded on their own. Of each Arrow batch the distinct new words are sorted, which is the depth-first
order of their trie: the forward states of a word's characters stay while the next word begins the same.

The forward state depends on the model's kind:

* ``unigram``: the best score of the prefix and its last piece (plain Viterbi);
* ``bpe``: the last piece of the prefix's merge encoding. A piece may follow another if the two, put together, are
  merged back into exactly these two; for each prefix one piece ending there fits, so the pass gives the same ids as
  the merges do, without making them for each word.

Characters without a piece become byte pieces, or the unknown id in models without them. Results are those of the
public library with an identity normaliser, dummy prefix and no removal of extra spaces; ``load_model`` refuses others.

Null texts have null ids when encoded and null text when decoded; empty texts have no ids. Decoding gives the text
back, but for U+2581 itself, which reads as a space. Repeated rows are encoded alike, ties between segmentations go to
the longest last piece (``bpe``: the only fitting one). An empty table gives no rows, texts of any length are encoded
whole. Other columns pass through; one named as a computed column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from memjobs.llm.common import extended, table

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class PieceModel:
    """What encoding needs of a model file: pieces with scores, byte pieces, and the kind."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]
    unknown: int
    kind: str

    @cached_property
    def key(self) -> str:
        """A digest of everything that encoding depends on."""
        return hashlib.sha256(repr((self.pieces, self.scores, self.normal, self.byte_ids, self.unknown, self.kind)).encode()).hexdigest()


def load_model(path: str) -> PieceModel:
    """Read a ``.model`` file on the driver; the result (a megabyte or so) travels with the tasks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces:
        raise ValueError("only models with an identity normaliser, dummy prefix and kept spaces are supported")
    if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in spec.pieces):
        raise ValueError("models with suffix marks or user-defined pieces aren't supported")
    assert sentencepiece
    pieces = [p.piece for p in spec.pieces]
    if any(MARK in p.piece.lstrip(MARK) or p.piece.startswith(MARK * 2) and p.piece.strip(MARK) for p in spec.pieces if p.type == 1):
        raise ValueError("a piece has a mark inside; words can't be encoded on their own")
    marks = [p.score for p in spec.pieces if p.type == 1 and len(p.piece) > 1 and not p.piece.strip(MARK)]
    if marks and max(marks) >= min(p.score for p in spec.pieces if p.type == 1 and p.piece.strip(MARK)):
        raise ValueError("pieces of several marks must have the lowest scores")
    kinds = {1: "unigram", 2: "bpe"}
    bytes_at = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 6}
    return PieceModel(
        pieces, [p.score for p in spec.pieces], [p.type == 1 for p in spec.pieces],
        [bytes_at[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_at) == 256 else [],
        next(i for i, p in enumerate(spec.pieces) if p.type == 2), kinds[spec.trainer_spec.model_type],
    )


class Encoder:
    """Ids of marked words, kept for words seen before; forgets them when there are more than ``limit``."""

    def __init__(self, model: PieceModel, limit: int = 400_000):
        self.model, self.limit = model, limit
        self.id_of = {p: i for i, p in enumerate(model.pieces) if model.normal[i]}
        # pieces of several marks are joined after all others; see _marks
        self.inner = {p: i for p, i in self.id_of.items() if p.strip(MARK) or p == MARK}
        self.words: dict[str, tuple[int, ...]] = {}  # by the word without its mark
        self.fits: dict[int, bool] = {}
        self.marks: dict[int, tuple[int, ...]] = {}
        # the pieces, read from their ends: character -> [deeper level, id or -1]
        self.ends: dict[str, list] = {}
        for p, i in self.inner.items():
            level, node = self.ends, [self.ends, -1]
            for c in reversed(p):
                node = level.setdefault(c, [{}, -1])
                level = node[0]
            node[1] = i
        self.floor = min(model.scores, default=0.0) - 10.0

    # -- merges, for single pairs and for runs of marks

    def _merged(self, symbols: list[str], scores: dict[str, int]) -> list[str]:
        while len(symbols) > 1:
            best, at = None, -1
            for k, (a, b) in enumerate(pairwise(symbols)):
                i = scores.get(a + b)
                if i is not None and (best is None or self.model.scores[i] > best):
                    best, at = self.model.scores[i], k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _fit(self, a: int, b: int) -> bool:
        """May piece ``b`` follow piece ``a``? -1: nothing stands before."""
        key = a << 24 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 600_000:
                self.fits.clear()
            p, q = self.model.pieces[a] if a >= 0 else "", self.model.pieces[b]
            found = self.fits[key] = self._merged(list(p + q), self.inner) == ([p, q] if p else [q])
        return found

    def _marks(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` marks that belong to no word: joined after all else, by score and then from the left."""
        if n not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[n] = self._merged_marks(n) if self.model.kind == "bpe" else self._unigram_marks(n)
        return self.marks[n]

    def _merged_marks(self, n: int) -> tuple[int, ...]:
        size, right, left = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(at: int) -> None:
            if 0 <= at and right[at] < n and (i := self.id_of.get(MARK * (size[at] + size[right[at]]))) is not None:
                heapq.heappush(heap, (-self.model.scores[i], at, size[at] + size[right[at]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, at, total = heapq.heappop(heap)
            other = right[at] if size[at] else n
            if other >= n or size[at] + size[other] != total:
                continue
            size[at], size[other], right[at] = total, 0, right[other]
            if right[at] < n:
                left[right[at]] = at
            offer(at)
            offer(left[at])
        return tuple(self.id_of[MARK * k] for k in size if k)

    def _unigram_marks(self, n: int) -> tuple[int, ...]:
        best = [(0.0, ())]
        for j in range(1, n + 1):
            best.append(max(((best[j - k][0] + self.model.scores[self.id_of[MARK * k]], (*best[j - k][1], self.id_of[MARK * k]))
                             for k in range(1, j + 1) if MARK * k in self.id_of), default=(self.floor * j, (self.model.unknown,) * j)))
        return best[n][1]

    # -- the shared forward pass

    def learn(self, new: Sequence[str]) -> None:
        """Encode words not seen before, in the order of their trie."""
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
        before = ""
        # of each prefix: last piece (negative: a character without one), where it starts, score
        states: list[tuple[int, int, float]] = [(-1, 0, 0.0)]
        step = self._step_bpe if self.model.kind == "bpe" else self._step_unigram
        for bare in sorted(new):
            word = MARK + bare
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(step(word, end, states))
            self.words[bare] = self._back(word, states)
            before = word

    def _ending(self, word: str, end: int) -> list[tuple[int, int]]:
        """(id, start) of the pieces that end at ``end``, the shortest first."""
        level, at, out = self.ends, end, []
        while at:
            node = level.get(word[at - 1])
            if node is None:
                break
            at -= 1
            if node[1] >= 0:
                out.append((node[1], at))
            level = node[0]
        return out

    def _step_bpe(self, word: str, end: int, states: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        fits = self.fits
        for i, start in reversed(self._ending(word, end)):
            # after a character without a piece, or at the start, nothing can be merged across
            last = max(states[start][0], -1)
            fit = fits.get(last << 24 | i)
            if self._fit(last, i) if fit is None else fit:
                return i, start, 0.0
        return -2, end - 1, 0.0

    def _step_unigram(self, word: str, end: int, states: list[tuple[int, int, float]]) -> tuple[int, int, float]:
        best = (-2, end - 1, states[end - 1][2] + self.floor)
        for i, start in self._ending(word, end):
            score = states[start][2] + self.model.scores[i]
            if score > best[2]:
                best = (i, start, score)
        return best

    def _back(self, word: str, states: list[tuple[int, int, float]]) -> tuple[int, ...]:
        out: list[int] = []
        end = len(word)
        while end:
            i, start, _ = states[end]
            if i >= 0:
                out.append(i)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[b] for b in reversed(word[start:end].encode())]
            else:
                out.append(self.model.unknown)
            end = start
        return tuple(reversed(out))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        split = [None if t is None else t.replace(MARK, " ").split(" ") if t else [] for t in texts]
        used = set().union(*(ws for ws in split if ws))
        used.discard("")
        if not used <= self.words.keys():
            self.learn(list(used - self.words.keys()))
            if not used <= self.words.keys():  # the limit made it forget
                self.learn(list(used - self.words.keys()))
        known, mark = self.words, self.id_of.get(MARK, -1)
        out: list[np.ndarray | None] = []
        for ws in split:
            if ws is None:
                out.append(None)
                continue
            if "" not in ws:
                parts = map(known.__getitem__, ws)
            else:
                parts, free = [], 0
                for w in ws:
                    if not w:
                        free += 1
                        continue
                    ids = known[w]
                    if free and ids[0] == mark:  # the word's own mark stayed alone and joins those before it
                        parts += [self._marks(free + 1), ids[1:]]
                    else:
                        parts += [self._marks(free), ids] if free else [ids]
                    free = 0
                if free:
                    parts.append(self._marks(free))
            out.append(np.fromiter(chain.from_iterable(parts), dtype=np.int32))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a list of ids; bytes that aren't UTF-8 become the replacement character."""
        if not hasattr(self, "raw"):
            low = {i: bytes([b]) for b, i in enumerate(self.model.byte_ids)}
            self.raw = [low.get(i) or (p.replace(MARK, " ").encode() if self.model.normal[i] else b"") for i, p in enumerate(self.model.pieces)]
            self.raw[self.model.unknown] = " ⁇ ".encode()
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(model: PieceModel) -> Encoder:
    """One encoder for each worker process and model, so that words stay known from batch to batch."""
    if model.key not in _encoders:
        _encoders.clear()
        _encoders[model.key] = Encoder(model)
    return _encoders[model.key]


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None, rows: int = 500) -> DataFrame:
    """``docs`` with the ids of each text. ``rows``: how many texts are encoded at once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch):
        encoder, texts, out = _encoder(shared.value), batch.column(text_col), []
        for at in range(0, batch.num_rows, rows):
            out += encoder.encode(texts.slice(at, rows).to_pylist())
        yield pa.array(out, pa.list_(pa.int32()))

    return extended(docs, compute, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], keep)


def decode(tokens: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with the text of each list of ids."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch):
        encoder = _encoder(shared.value)
        yield pa.array([None if x is None else encoder.decode(x) for x in batch.column(ids_col).to_pylist()], pa.string())

    return extended(tokens, compute, [T.StructField(text_col, T.StringType())], keep)


DIGEST_FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("round_trip", T.BooleanType()),
]


def encode_digest(docs: DataFrame, model: PieceModel, text_col: str = "text", keep: list[str] | None = None, rows: int = 500) -> DataFrame:
    """``docs`` with the number of ids, the SHA-256 of the ids (as little-endian 32-bit numbers) and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch):
        encoder, n, digests, same = _encoder(shared.value), [], [], []
        for at in range(0, batch.num_rows, rows):
            texts = batch.column(text_col).slice(at, rows).to_pylist()
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                ids = np.empty(0, dtype=np.int32) if ids is None else ids
                n.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                same.append(encoder.decode(ids.tolist()) == (text or ""))
        yield pa.array(n, pa.int64())
        yield pa.array(digests, pa.string())
        yield pa.array(same, pa.bool_())

    return extended(docs, compute, DIGEST_FIELDS, keep)


def query(spark: SparkSession, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digest(docs, load_model(model_path), keep=["doc_id"])
