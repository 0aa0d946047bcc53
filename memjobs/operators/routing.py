"""Routing of ordered topic records into experiences and segments, with vectors: sequential within a conversation.

``Router`` holds the state of one conversation and is a pure fold: the batch job and the streaming job share it, so
both give the same rows. Rows are sorted in their partitions and streamed, so a task holds one conversation's state, which
grows with its topics and segments, not with its records. A record takes the same time whatever came before; a change of
topic compares one vector for each experience.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from memjobs.functions.embed import HashingEmbedder
from memjobs.operators.hierarchy import SUMMARY_EVERY, cuts

MATCH = 0.82
OUTPUT = (
    "conv_id long, turn_ord int, rec_ord int, seq int, topic string, intent string, qa_id string, segment_id string, experience_id string, "
    "action string, segment_version int, experience_version int"
)
INPUT = ("turn_ord", "rec_ord", "topic", "core_entity", "intent")
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class Memory:
    """A conversation's state, entry by entry, so that a step reads and writes only the entries that it touches.

    ``head``: seq, current, turn, rec, size (number of experiences). ``experiences``: by number, the fields of
    ``EXPERIENCE``. ``segments``: by (experience, number), the fields of ``SEGMENT``. ``intents``: (experience, intent) seen.
    The three are mappings; a streaming job puts its keyed state behind them.
    """

    EXPERIENCE = ("topic", "core_entity", "sums", "segments", "recent", "version", "fresh")
    SEGMENT = ("intent", "size", "fresh", "version")

    def __init__(self, head: dict | None = None, experiences: MutableMapping | None = None, segments: MutableMapping | None = None, intents: MutableMapping | None = None):
        self.head = head or {"seq": 0, "current": -1, "turn": -1, "rec": -1, "size": 0}
        self.experiences, self.segments, self.intents = ({} if m is None else m for m in (experiences, segments, intents))


class Router:
    """Routes one conversation's records in order. State: its experiences with their segments, and the counters since the last summaries.

    An experience's document is its topic, entity, intents and the intents of the three segments touched last. The embedder adds
    up tokens, so ``sums`` holds the part that only grows, and a record adds its new intent; nothing is embedded again.
    """

    def __init__(self, conv_id, embedder: HashingEmbedder | None = None, match: float = MATCH, every: int = SUMMARY_EVERY, memory: Memory | None = None):
        self.conv_id, self.match, self.every = conv_id, match, every
        self.embed = embedder or HashingEmbedder()
        self.memory = memory or Memory()
        self.vectors: np.ndarray | None = None

    @property
    def last(self) -> tuple[int, int]:
        return self.memory.head["turn"], self.memory.head["rec"]

    def _vector(self, number: int) -> np.ndarray:
        m = self.memory
        e = m.experiences[number]
        total = np.array(e["sums"], dtype=np.float64)
        for s in e["recent"]:
            total = total + self.embed.token_sum(m.segments[number, s]["intent"])
        return self.embed.scaled(total)

    def _nearest(self, topic: str, core_entity: str) -> int | None:
        """Reads every experience's vector, once for a router; later ones follow the records."""
        size = self.memory.head["size"]
        if not size:
            return None
        if self.vectors is None:
            self.vectors = np.array([self._vector(i) for i in range(size)])
        near = np.clip(self.vectors[:size] @ self.embed(f"Topic: {topic}\nEntity: {core_entity}"), 0, 1)
        best = int(np.lexsort((np.arange(len(near)), -np.round(near, 12)))[0])
        return best if near[best] >= self.match else None

    def _summarise_segment(self, number: int) -> None:
        m = self.memory
        e = m.experiences[number]
        if e["recent"]:
            at = number, e["recent"][0]
            s = m.segments[at]
            if s["size"]:
                m.segments[at] = {**s, "version": s["version"] + 1, "fresh": 0}

    def _summarise_experience(self, number: int) -> None:
        e = self.memory.experiences[number]
        self.memory.experiences[number] = {**e, "version": e["version"] + 1, "fresh": 0}

    def _opened(self, topic: str, core_entity: str) -> int:
        m = self.memory
        number = m.head["size"]
        sums = self.embed.token_sum(f"Topic: {topic}\nEntity: {core_entity}\nIntent: ")
        m.experiences[number] = {"topic": topic, "core_entity": core_entity, "sums": sums.tolist(), "segments": 0, "recent": [], "version": 1, "fresh": 0}
        m.head["size"] = number + 1
        if self.vectors is not None:
            if number >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros((max(16, len(self.vectors)), self.embed.dimensions))])
            self.vectors[number] = 0
        return number

    def add(self, topic: str, core_entity: str, intent: str) -> dict:
        """Route one record; returns its ids, the action and the versions after it."""
        m = self.memory
        m.head["seq"] += 1
        action, now = "append_segment", m.head["current"]
        if now < 0 or m.experiences[now]["topic"] != topic:
            if now >= 0:
                self._summarise_segment(now)
                self._summarise_experience(now)
            found = self._nearest(topic, core_entity)
            action = "new_experience" if found is None else "switch_experience"
            now = m.head["current"] = self._opened(topic, core_entity) if found is None else found
        e = m.experiences[now]
        at = e["recent"][0] if e["recent"] else None
        segment = None if at is None else m.segments[now, at]
        if segment is None or cuts(intent, segment["intent"], segment["size"]):
            if segment is not None:
                self._summarise_segment(now)
            at = e["segments"]
            segment = {"intent": intent, "size": 0, "fresh": 0, "version": 1}
            e = {**e, "segments": at + 1, "fresh": e["fresh"] + 1}
            action = "new_segment" if action == "append_segment" else action
        segment = {**segment, "size": segment["size"] + 1, "fresh": segment["fresh"] + 1}
        if segment["fresh"] >= self.every:
            segment = {**segment, "version": segment["version"] + 1, "fresh": 0}
        m.segments[now, at] = segment
        if not e["recent"] or e["recent"][0] != at:
            e = {**e, "recent": [at, *(s for s in e["recent"] if s != at)][:3]}
        if (now, intent) not in m.intents:
            m.intents[now, intent] = True
            e = {**e, "sums": (np.array(e["sums"]) + self.embed.token_sum(intent)).tolist()}
        if e["fresh"] >= self.every:
            e = {**e, "version": e["version"] + 1, "fresh": 0}
        m.experiences[now] = e
        if self.vectors is not None:
            self.vectors[now] = self._vector(now)
        return {
            "seq": m.head["seq"], "topic": topic, "intent": intent, "qa_id": f"qa_{self.conv_id}_{m.head['seq']}", "segment_id": f"seg_{self.conv_id}_{now + 1}_{at + 1}",
            "experience_id": f"exp_{self.conv_id}_{now + 1}", "action": action, "segment_version": segment["version"], "experience_version": e["version"],
        }


def routed_row(router: Router, turn: int, rec: int, topic: str, entity: str, intent: str) -> dict:
    row = {"conv_id": router.conv_id, "turn_ord": turn, "rec_ord": rec, **router.add(topic, entity, intent)}
    router.memory.head |= {"turn": int(turn), "rec": int(rec)}
    return row


def route_frame(router: Router, frame: pd.DataFrame) -> list[dict]:
    """Rows of one conversation, in order."""
    return [routed_row(router, *values) for values in zip(*(frame[c] for c in INPUT), strict=True)]


def routed(records: DataFrame) -> DataFrame:
    """The routed exchanges of valid records. One shuffle by conversation, then a stream through sorted rows."""
    rows = records.select("conv_id", "turn_ord", "rec_ord", "topic", "core_entity", "intent")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder, router = HashingEmbedder(), None
        for frame in frames:
            out = []
            for conv, part in frame.groupby("conv_id", sort=False):
                if router is None or router.conv_id != conv:
                    router = Router(int(conv), embedder)
                out += route_frame(router, part)
            yield pd.DataFrame(out, columns=COLUMNS)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_ord", "rec_ord").mapInPandas(run, OUTPUT)
