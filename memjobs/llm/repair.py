"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation's role initials must read ``(s?(ua)+)?``. Every row is kept (cost 0), given the role user or
assistant (3) or deleted (4, which blank and duplicate rows must be); rows with an empty text may be inserted anywhere (3);
a truncated row that isn't deleted adds 3. Of the cheapest edits those are taken whose letters (D, I, K, R in order) are
least as a string.

The edits are a shortest path through a small graph: a node is a row and one of four states (nothing yet, after s, after
u, after a). A path's weight is one integer: its high digits hold the cost, below them stand the letters as digits of
fixed width at fixed places, first letter highest, with zeros behind the last one, so that the least integer is the
cheapest path with the least string, and an ordinary minimum at each node decides everything. Two paths of equal cost
that reach a node have letters of which neither begins the other (they consume the same rows, and more inserts cost
more), so the minimum is safe. Rows are taken in blocks of ``BLOCK``; between blocks the letters so far are replaced by
one digit, the rank of the four states' strings, so integers stay short for conversations of any length.

Spark finds duplicates by the first row of each role and text (a partial aggregation, so that a text which is repeated
without end is one row a task), sorts rows within conversations and streams them through: a task holds one block and the
letters so far. One conversation is one task, since a digest of its whole text is sequential.

Rows are ordered by turn, null turns first; rows with one turn by role and then by the SHA-256 of the text. Null roles
and texts are one space. A row without a role initial of s, u or a can't be kept. A repeated row is a duplicate. A
conversation without rows has zeros, an empty audit and the hash of the empty string; a null conversation id is one
conversation. An empty table gives no rows. Only the four named columns are read, other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memjobs.llm.common import sliced, stored, table

#: Rows that one integer's digits cover.
BLOCK = 64
#: States, and the one that a row or an insert with role user or assistant leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
COSTS = {"keep": 0, "rerole": 3, "delete": 4, "insert": 3, "truncated": 3}
BLANKS = " \t\n\x0b\x0c\r"


def kept_state(state: int, initial: str) -> int | None:
    """Where a kept row with this initial leads, if anywhere."""
    if initial == "s":
        return SYSTEM if state == START else None
    following = NEXT[state]
    return following if initial == ROLES[following][0] else None


@lru_cache(maxsize=1 << 15)
def solved(symbols: str, begin: tuple[tuple[int, int, int], ...]) -> tuple[tuple[int, int, str, int], ...]:
    """(state, cost, letters, state before) after the rows, states by the order of all their letters.

    ``begin``: (state, cost, rank) before them. A symbol is a row's role initial (``x`` for others), in upper case if it is
    truncated, or ``d`` if it must be deleted. Inserts stand before rows; those behind the last row are added at the end.
    """
    digits = 3 * len(symbols)
    unit = 1 << 3 * (digits + 1)  # of cost; the digit below it is the rank
    front = {state: (cost * unit + (rank << 3 * digits), 0) for state, cost, rank in begin}

    def step(into: dict[int, tuple[int, int]], state: int, weight: int, place: int, cost: int, letter: int) -> None:
        found = (weight + cost * unit + (letter << 3 * (digits - 1 - place)), place + 1)
        into[state] = min(into.get(state, found), found)

    for symbol in symbols:
        for _ in range(2):
            for state, (weight, place) in list(front.items()):
                step(front, NEXT[state], weight, place, COSTS["insert"], INSERT)
        after: dict[int, tuple[int, int]] = {}
        more = COSTS["truncated"] if symbol.isupper() else 0
        for state, (weight, place) in front.items():
            step(after, state, weight, place, COSTS["delete"], DELETE)
            if symbol != "d":
                to = kept_state(state, symbol.lower())
                if to is not None:
                    step(after, to, weight, place, COSTS["keep"] + more, KEEP)
                step(after, NEXT[state], weight, place, COSTS["rerole"] + more, REROLE)
        front = after
    low = (1 << 3 * (digits + 1)) - 1
    before = {rank: state for state, _, rank in begin}
    out = []
    for state, (weight, place) in sorted(front.items(), key=lambda s: s[1][0] & low):
        letters = "".join(LETTERS[weight >> 3 * (digits - 1 - p) & 7] for p in range(place))
        out.append((state, weight // unit, letters, before[weight >> 3 * digits & 7]))
    return tuple(out)


class Conversation:
    """Takes a conversation's rows in order and keeps what the report needs: a block of rows, the letters and running hashes."""

    def __init__(self):
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last_turn = self.last_initial = None
        self.symbols: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.front: tuple[tuple[int, int, str, int], ...] = ((START, 0, "", START),)
        self.past: list[dict[int, tuple[str, int]]] = []
        self.hashes = {START: (hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least, self.most, self.last_turn = turn if self.least is None else self.least, turn, turn
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        symbol = initial if initial in ("s", "u", "a") else "x"
        told = text.strip(BLANKS)
        if not told:
            self.blank, symbol = self.blank + 1, "d"
        elif not first:
            self.duplicate, symbol = self.duplicate + 1, "d"
        elif told[-1] not in ".!?":
            self.truncated, symbol = self.truncated + 1, symbol.upper()
        if len(self.symbols) == BLOCK:
            self._close()
            self.hashes = {state: self._hashed(state) for state, *_ in self.front}
            self.symbols, self.rows = [], []
        self.symbols.append(symbol)
        self.rows.append((role, text if symbol != "d" else ""))

    def _close(self) -> None:
        """The rows of the block as the next step of all paths."""
        begin = tuple((state, cost, rank) for rank, (state, cost, _, _) in enumerate(self.front))
        self.front = solved("".join(self.symbols), begin)
        self.past.append({state: (letters, before) for state, _, letters, before in self.front})

    def _hashed(self, state: int, behind: str = ""):
        """The running hash of the best path to ``state``, over the block's rows and inserts ``behind`` them."""
        letters, before = self.past[-1][state] if self.past else ("", START)
        known, any_line = self.hashes[before]
        digest = known.copy()
        for role, text in edited(letters + behind, before, self.rows):
            digest.update(("\n" if any_line else "").encode() + f"{role}:{text}".encode())
            any_line = True
        return digest, any_line

    def report(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired conversation."""
        if self.symbols:
            self._close()
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, state = min((cost + COSTS["insert"] * len(ends[state]), rank, state) for rank, (state, cost, _, _) in enumerate(self.front))
        digest, _ = self._hashed(state, ends[state])
        audit, at = [ends[state]], state
        for block in reversed(self.past):
            letters, at = block[at]
            audit.append(letters)
        return cost, "".join(reversed(audit)), digest.hexdigest()


def edited(audit: str, state: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired rows; the letters tell every role."""
    given = iter(rows)
    for letter in audit:
        if letter == "D":
            next(given)
            continue
        role, text = ("", "") if letter == "I" else next(given)
        to = kept_state(state, role[:1]) if letter == "K" else NEXT[state]
        state = to
        yield (role if letter == "K" else ROLES[state]), text


def _laid(turns: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows and markers of each conversation in order: its header, then each row, the first of a role and text behind a marker.

    ``headers`` (conv_id, text). The marker of a first row sorts directly before the rows of its turn, role and text.
    """
    rows = turns.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    none = F.lit(None)
    names = ["conv_id", "turn", "role", "digest", "kind", "text"]
    parts = headers.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.lit(0).alias("kind"), "text")
    parts = parts.unionByName(first.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), none.cast("string").alias("text")))
    parts = parts.unionByName(rows.select("conv_id", "turn", "role", "digest", F.lit(2).alias("kind"), "text"))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind").select(*names)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, first) of each row; headers have role None and their text."""
    marked = None
    for batch in sliced(batches):
        for conv, turn, role, digest, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                yield conv, None, None, text, False
            elif kind == 1:
                marked = (conv, turn, role, digest)
            else:
                first = marked == (conv, turn, role, digest)
                marked = None if first else marked
                yield conv, turn, role, text, first


def filled(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = F.lit(" ")
    return turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
    )


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    def closed(conv, c: Conversation) -> tuple:
        gaps = 0 if c.least is None else c.most - c.least + 1 - c.turns
        return conv, gaps, c.blank, c.duplicate, c.truncated, c.illegal, *c.report()

    current, now = None, None
    for conv, turn, role, text, first in _streamed(batches):
        if role is None:  # a header opens the next conversation
            if now is not None:
                out.append(closed(current, now))
            current, now = conv, Conversation()
            if len(out) >= 10_000:
                yield batch()
        else:
            now.add(turn, role, text, first)
    if now is not None:
        out.append(closed(current, now))
    if out:
        yield batch()


def repair_report(turns: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: gaps in its turns, faults, the cheapest cost, the edits' letters and the digest of what they give.

    ``every`` (one column) names conversations that must be listed though they may have no rows.
    """
    rows = filled(turns, conv_col, turn_col, role_col, text_col)
    ids = rows.select("conv_id") if every is None else every.select(F.col(every.columns[0]).cast("long").alias("conv_id"))
    headers = ids.distinct().withColumn("text", F.lit(None).cast("string"))
    return _laid(rows, headers).mapInArrow(_reports, REPORT)


def repaired_turns(turns: DataFrame, report: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (I, K or R), turn (null for inserts), role, text."""
    rows = filled(turns, conv_col, turn_col, role_col, text_col)
    known = report if report is not None else stored(repair_report(turns, None, conv_col, turn_col, role_col, text_col), "repair-report")
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, audit, at, state, place = None, "", 0, START, 0

        def put(letter: str, turn: int | None, role: str, text: str) -> None:
            nonlocal state, place
            state = kept_state(state, role[:1]) if letter == "K" else NEXT[state]
            out.append((conv, place, letter, turn, role if letter == "K" else ROLES[state], text))
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", None, "", "")
                at += 1

        for of, turn, role, text, _ in _streamed(batches):
            if role is None:
                inserts()
                conv, audit, at, state, place = of, text or "", 0, START, 0
            else:
                inserts()
                if audit[at] != "D":
                    put(audit[at], turn, role, text)
                at += 1
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out.clear()
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    laid = _laid(rows, known.select("conv_id", F.col("audit").alias("text")))
    return laid.mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32(``conv_id:turn``) % 20; nulls are one space."""

    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = turns.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damaged(turns), turns.select("conv_id"))


#: CRC-32 from its polynomial, and the same repair as a recursion that keeps the cheapest letters and lines of each state.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
), c AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
    FROM conversations, t
), d AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
    FROM c WHERE code <> 0
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, substr(role, 1, 1) AS initial FROM d
), k AS (
    SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before,
           CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM o
), nxt(state, role) AS (VALUES ('', 'user'), ('s', 'user'), ('u', 'assistant'), ('a', 'user')
), ins AS (
    SELECT state, state AS mid, 0 AS cost, '' AS letters, CAST([] AS VARCHAR[]) AS lines FROM nxt
    UNION ALL SELECT state, substr(role, 1, 1), 3, 'I', [role || ':'] FROM nxt
    UNION ALL SELECT x.state, substr(y.role, 1, 1), 6, 'II', [x.role || ':', y.role || ':'] FROM nxt AS x JOIN nxt AS y ON y.state = substr(x.role, 1, 1)
), fold AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM conversations
    UNION ALL
    SELECT conv_id, n, state, cost, audit, lines FROM (
        SELECT k.conv_id, k.n, e.letter, CASE e.letter WHEN 'D' THEN ins.mid WHEN 'K' THEN k.initial ELSE substr(nxt.role, 1, 1) END AS state,
               f.cost + ins.cost + CASE e.letter WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e.letter <> 'D' AND k.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
               f.audit || ins.letters || e.letter AS audit,
               list_concat(f.lines, ins.lines, CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [k.role || ':' || k.text] ELSE [nxt.role || ':' || k.text] END) AS lines
        FROM fold AS f JOIN k ON k.conv_id IS NOT DISTINCT FROM f.conv_id AND k.n = f.n + 1 JOIN ins ON ins.state = f.state JOIN nxt ON nxt.state = ins.mid, (VALUES ('D'), ('K'), ('R')) AS e(letter)
        WHERE e.letter = 'D' OR (k.fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR k.initial = substr(nxt.role, 1, 1) OR (k.initial = 's' AND ins.mid = '')))
    ) QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1
), s AS (
    SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM k GROUP BY conv_id
), ends AS (
    SELECT f.conv_id, f.n, f.cost + ins.cost AS cost, f.audit || ins.letters AS audit, list_concat(f.lines, ins.lines) AS lines
    FROM fold AS f LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id JOIN ins ON ins.state = f.state
    WHERE f.n = coalesce(s.n, 0) AND ins.mid IN ('', 'a') QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY f.cost + ins.cost, f.audit || ins.letters) = 1
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       e.cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM ends AS e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
