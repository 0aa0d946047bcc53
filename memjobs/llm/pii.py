"""Personal data: weak labelers vote on candidate spans, expectation-maximisation weighs the votes.

Base spans (email, ip, card, phone) follow fixed rules and always stay. Looser patterns propose further
candidates. Six labelers (pattern, structure, gazetteer, context, boundary, format) vote for, against or not at
all on every candidate. ``fit_pii`` counts the vote patterns of the whole table (their number is bounded:
kinds x 3^6 votes x 4 lengths), estimates by EM how reliable each labeler is, and trains a logistic span
classifier on the EM posteriors. ``label_spans`` and ``redact`` then run it over every text in one pass.

Null texts are empty and have no spans. Offsets count code points, ends are exclusive. Repeated rows are
labelled alike; other columns pass through and don't count, one named as a computed column is replaced. A secret stands
whole around base spans and may overlap them. Of candidates that overlap each other, the earlier and then the longer one is taken, then the kind listed first. An empty table gives no rows and
a model that accepts no candidates. Texts of any length are searched whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memjobs.llm.common import extended, sliced, table

#: Kinds in the order of the contract, then the kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Candidates beyond the base rules: kind, strings of which the text must have one, pattern.
_LOOSE = (
    ("email", ("at)", "at]", "AT)", "AT]"), re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[](?:dot|DOT)[)\]] ?)[A-Za-z0-9-]++)++")),
    ("phone", ("-", ".", " "), re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("card", (".", "/"), re.compile(r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])")),
    ("secret", ("AKIA",), re.compile(r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])")),
    ("secret", ("ghp", "gho", "sk", "pk"), re.compile(r"(?:ghp|gho|sk|pk)[_-][A-Za-z0-9_-]{16,}+")),
    ("secret", ("=", ":"), re.compile(r"(?i)(?:password|passwd|secret|token|api[_-]?key) {0,2}[=:] {0,2}\"?[^\s\"]{6,}+\"?")),
    ("iban", ("",), re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
)

#: Gazetteers and cue words.
TOP_DOMAINS = frozenset("com net org edu gov mil int info io co uk de fr es it nl eu us ca au jp cn br ru in ch se".split())
CALLING_CODES = ("+1", "+7", "+33", "+34", "+39", "+41", "+43", "+44", "+46", "+49", "+55", "+61", "+81", "+86", "+91")
CUES = {
    "email": ("mail", "contact", "write to", "correo", "adresse"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon"),
    "secret": ("password", "passwd", "token", "secret", "key"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"),
}
AGAINST = ("version", "isbn", "issn", "chapter", "page", "order no", "section", "figure")
N_LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed rules, each kind leftmost and without overlaps."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        size = len(local) - len(local.rstrip(LOCAL))
        m = _DOMAIN.match(text, at + 1) if size else None
        if m:
            out.append((0, at - size, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns; earlier and longer ones first, no overlaps among them.

    Secrets stand whole, whatever base spans lie in them; other kinds only where they meet no base span.
    """
    found = []
    for kind, marks, pattern in _LOOSE:
        if any(m in text for m in marks):
            found += [(KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)]
    taken, out = sorted((s, e) for _, s, e in base), []
    starts = np.array([s for s, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], dtype=np.int64)) if taken else starts
    end = -1
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        i = np.searchsorted(starts, e) - 1
        if s >= end and (KINDS[k] == "secret" or not (i >= 0 and reach[i] > s)):
            out.append((k, s, e))
            end = e
    return out


def vote_code(text: str, kind: int, start: int, end: int, strict: bool) -> int:
    """Kind, the six votes (0 against, 1 none, 2 for) and a length class as one number."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    left = text[max(0, start - 32) : start].lower()
    votes = [1] * N_LABELERS
    votes[0] = 2 if strict or name == "secret" and span.startswith(("AKIA", "ghp", "gho")) else 1
    if name == "email":
        last = re.split(r"[.\])]", span)[-1].strip().lower()
        votes[1], votes[2] = 2 if span.count("@") == 1 else 1, 2 if last in TOP_DOMAINS else 0
    elif name == "ip":
        first = int(span.split(".")[0][-3:])
        votes[1], votes[2] = 2 if 1 <= first <= 223 else 0, 0 if first in (0, 127) else 1
    elif name == "card":
        votes[1], votes[2] = 2 if luhn(digits) else 0, 2 if digits[0] in "3456" else 0
    elif name == "phone":
        votes[1] = 2 if 10 <= len(digits) <= 15 else 0
        votes[2] = 2 if span.startswith(CALLING_CODES) else 1
    elif name == "secret":
        value = re.split(r"[=:]\s*", span, maxsplit=1)[-1].strip('"')
        mix = sum(any(t(c) for c in value) for t in (str.isdigit, str.islower, str.isupper))
        votes[1] = 2 if mix >= 2 and len(set(value)) >= 8 else 0
        votes[2] = 2 if re.match(r"AKIA|gh[po]_|[sp]k[_-]|(?i:passw|token|secret|api)", span) else 1
    else:
        body = span.replace(" ", "")
        turned = "".join(str(int(c, 36)) for c in body[4:] + body[:4])
        votes[1] = 2 if int(turned) % 97 == 1 else 0
    if any(c in left for c in CUES[name]):
        votes[3] = 2
    elif any(c in left for c in AGAINST):
        votes[3] = 0
    inside = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    votes[4] = 0 if inside else 2
    votes[5] = 2 if name in ("phone", "card") and re.search(r"[()\- ]", span) else 1
    code = kind
    for v in votes:
        code = code * 3 + v
    return code * 4 + min(3, (end - start) // 12)


@dataclass
class PiiModel:
    """``accepted``: codes of the candidates that the classifier takes; ``reliability``: by labeler, from EM."""

    accepted: frozenset[int] = frozenset()
    reliability: list[float] = field(default_factory=list)


def _unpacked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, rest = codes % 4, codes // 4
    votes = np.stack([rest // 3 ** (N_LABELERS - 1 - i) % 3 for i in range(N_LABELERS)], axis=1)
    return rest // 3**N_LABELERS, votes, size


def fit_votes(codes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> PiiModel:
    """EM over the vote patterns, then logistic regression of the posteriors on kind, votes and length."""
    if len(codes) == 0:
        return PiiModel()
    kind, votes, size = _unpacked(codes)
    weight = counts.astype(float)
    right = np.full(N_LABELERS, 0.8)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior))[kind]
        step = np.log(right / (1 - right))
        posterior = 1 / (1 + np.exp(-np.clip(odds + ((votes - 1) * step).sum(axis=1), -30, 30)))
        agree = np.where(votes == 2, posterior[:, None], 1 - posterior[:, None])
        cast = votes != 1
        # a labeler's reliability has a prior of 16 right and 4 wrong votes, which also keeps the classes apart
        right = ((agree * cast * weight[:, None]).sum(axis=0) + 16) / ((cast * weight[:, None]).sum(axis=0) + 20)
        right = np.clip(right, 0.55, 0.99)
        hits = np.bincount(kind, posterior * weight, len(KINDS)) + 2
        prior = np.clip(hits / (np.bincount(kind, weight, len(KINDS)) + 4), 0.02, 0.98)
    x = np.concatenate(
        [np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, i]] for i in range(N_LABELERS)), np.eye(4)[size]], axis=1
    )
    beta = np.zeros(x.shape[1])
    share = np.sqrt(weight)  # so that a pattern with a million places doesn't drown the others
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (share * (posterior - p)) - 0.1 * beta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(hessian, gradient)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return PiiModel(frozenset(int(c) for c in codes[p >= 0.5]), [round(float(r), 4) for r in right])


def fit_pii(docs: DataFrame, text_col: str = "text") -> PiiModel:
    """Vote patterns are counted over every text; only the counts (a bounded number) reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                for strict, spans in ((True, base), (False, _more_spans(text, base))):
                    for k, s, e in spans:
                        code = vote_code(text, k, s, e, strict)
                        counts[code] = counts.get(code, 0) + 1
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return fit_votes(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64))


def spans_of(text: str, model: PiiModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by start and kind."""
    base = base_spans(text)
    more = [s for s in _more_spans(text, base) if vote_code(text, *s, False) in model.accepted]
    return base, sorted(base + more, key=lambda s: (s[1], s[0]))


SPAN_FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def label_spans(docs: DataFrame, model: PiiModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts of base spans by kind, and ``base_spans`` and ``spans`` as ``kind:start:end`` lists."""

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def compute(batch: pa.RecordBatch):
        rows = [spans_of(t or "", model) for t in batch.column(text_col).to_pylist()]
        for k in range(4):
            yield pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64())
        yield pa.array([joined(base) for base, _ in rows], pa.string())
        yield pa.array([joined(every) for _, every in rows], pa.string())

    return extended(docs, compute, SPAN_FIELDS, keep)


def redact(docs: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets; overlapping spans become one mark."""
    kept_type = docs.schema[text_col]

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for k, s, e in spans_of(text, model)[1]:
            if s >= end:
                out += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join([*out, text[end:]]) if end else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    assert isinstance(kept_type.dataType, T.StringType)
    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = label_spans(docs, fit_pii(docs), keep=["doc_id"])
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
