"""Fitting candidate trees into a token budget: greedy removal, then shorter summaries, then shorter texts.

A tree is small and the steps depend on each other, so each query's tree is fitted by a plain function inside a task;
trees stay where they are, without a shuffle. Sizes are kept and subtracted, not counted anew for each step.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Tree = list[dict]

#: The headers that summaries may have, and those of them that stay when a tree is too large.
EXPERIENCE_HEADERS = ("目标", "总体状态", "阶段总结", "当前推进", "长期信息", "下一步")
EXPERIENCE_KEPT = ("阶段总结", "长期信息")
SEGMENT_HEADERS = ("阶段概述", "关键过程", "阶段结论", "关键事实")
SEGMENT_KEPT = ("关键过程", "阶段结论", "关键事实")


@dataclass(frozen=True)
class Headers:
    """The headers that summaries of each layer may have, and those whose sections are kept. A parameter of both policies."""

    experience: tuple[str, ...] = EXPERIENCE_HEADERS
    experience_kept: tuple[str, ...] = EXPERIENCE_KEPT
    segment: tuple[str, ...] = SEGMENT_HEADERS
    segment_kept: tuple[str, ...] = SEGMENT_KEPT


def size_of(node: object) -> int:
    """UTF-8 bytes of the compact JSON of a node."""
    return len(json.dumps(node, ensure_ascii=False, separators=(",", ":")).encode())


def tokens(tree: Tree) -> int:
    return -(-size_of(tree) // 3)


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def segment_score(s: dict) -> float:
    own = sorted((q["local_score"] for q in s["qas"]), reverse=True)
    return clamp(0.65 * (own[0] if own else 0.0) + 0.20 * (sum(own[:3]) / len(own[:3]) if own else 0.0) + 0.15 * s["local_score"])


def experience_score(e: dict) -> float:
    own = sorted(map(segment_score, e["segments"]), reverse=True)
    return clamp(0.60 * (own[0] if own else 0.0) + 0.25 * (sum(own[:2]) / len(own[:2]) if own else 0.0) + 0.15 * e["local_score"])


def shortened(text: str, limit: int) -> str:
    text = (text or "").strip()
    return text if len(text) <= limit else text[:limit].rstrip() + "..."


def named_sections(text: str, headers: Sequence[str]) -> dict[str, str]:
    """Header to body. A header opens a line and is followed by a colon; a body ends where the next header stands."""
    pieces = re.split(rf"(?m)^\s*({'|'.join(map(re.escape, headers))})\s*[：:]\s*", (text or "").strip())
    return {name: body.strip() for name, body in zip(pieces[1::2], pieces[2::2], strict=True)}


def with_sections(sections: dict[str, str], kept: Sequence[str]) -> str:
    return "\n\n".join(f"{name}：{sections[name]}" for name in kept if name in sections)


def kept_summary(text: str, headers: Sequence[str], kept: Sequence[str]) -> str:
    """Only the ``kept`` sections; a summary without any of the headers stays as it is."""
    sections = named_sections(text, headers)
    return with_sections(sections, kept) if sections else (text or "").strip()


def cut_by_a_fifth(text: str, headers: Headers = Headers()) -> str:
    """Each section cut by a fifth, down to 32 characters; a summary without sections as a whole, down to 96."""
    sections = named_sections(text, headers.experience_kept + headers.segment_kept)
    if not sections:
        return text if len(text) <= 96 else shortened(text, max(96, int(len(text) * 0.8)))
    limits = {name: max(32, int(len(body) * 0.8)) for name, body in sections.items()}
    if all(len(body) <= limits[name] for name, body in sections.items()):
        return text
    return with_sections({name: shortened(body, limits[name]) for name, body in sections.items()}, list(sections))


class _Fit:
    """A tree and its size in bytes; ``total`` and the sizes of its nodes follow every change. Removed nodes are marked, and
    taken out of their lists at the end, so that a removal takes the same time in a tree of any size."""

    def __init__(self, tree: Tree, budget: int, count: Callable[[Tree], int] | None):
        self.tree, self.budget, self.count = tree, budget, count
        self.total = size_of(tree)
        self.gone: set[int] = set()
        self.left = {id(tree): len(tree)}
        self.sizes: dict[int, int] = {}
        for e in tree:
            self.left[id(e["segments"])] = len(e["segments"])
            for s in e["segments"]:
                self.left[id(s["qas"])] = len(s["qas"])

    def over(self) -> bool:
        return (self.count(self.pruned()) if self.count else -(-self.total // 3)) > self.budget

    def size(self, node: dict) -> int:
        """Of a node as it is now; counted once and then followed."""
        if id(node) not in self.sizes:
            self.sizes[id(node)] = size_of(node)
        return self.sizes[id(node)]

    def drop(self, items: list, node: dict, *above: dict) -> None:
        around = [self.size(n) for n in above]
        saved = self.size(node) + (self.left[id(items)] > 1)  # with its comma
        self.gone.add(id(node))
        self.left[id(items)] -= 1
        self.total -= saved
        for n, size in zip(above, around, strict=True):
            self.sizes[id(n)] = size - saved

    def pruned(self) -> Tree:
        """The tree without what was removed."""
        if self.gone:
            self.tree[:] = [e for e in self.tree if id(e) not in self.gone]
            for e in self.tree:
                e["segments"][:] = [s for s in e["segments"] if id(s) not in self.gone]
                for s in e["segments"]:
                    s["qas"][:] = [q for q in s["qas"] if id(q) not in self.gone]
        return self.tree

    def keep_sections(self, headers: Headers) -> None:
        for e in self.tree:
            self.put(e, "summary", kept_summary(e["summary"], headers.experience, headers.experience_kept))
            for s in e["segments"]:
                self.put(s, "summary", kept_summary(s["summary"], headers.segment, headers.segment_kept))

    def put(self, node: dict, field: str, value: str) -> bool:
        if node[field] == value:
            return False
        self.total += size_of(value) - size_of(node[field])
        node[field] = value
        return True


def fit(
    tree: Tree, budget: int = 30_000, least_experiences: int = 1, least_segments: int = 2, clips: tuple[tuple[int, int], ...] = ((800, 400), (300, 160)),
    count: Callable[[Tree], int] | None = None, headers: Headers = Headers(),
) -> tuple[Tree, dict]:
    """The fitted tree and what was done. Lowest score goes first, ties by id; it stops as soon as the tree fits.

    1. exchanges, as long as their segment keeps one; 2. segments, as long as their experience keeps one and
    ``least_segments`` stay in all; 3. experiences, within both minima; 4. summaries reduced to their kept sections, then
    cut to the limits of ``clips``;
    5. the longest exchange text cut by a quarter, down to 96 characters, 256 times at most.

    Each step takes its nodes from a queue that is filled once: what a removal changes elsewhere only makes nodes that wait
    unfit to go, for good, and such are skipped when their turn comes. So a tree of n nodes takes n log n steps.
    """
    tree = json.loads(json.dumps(tree))
    tree.sort(key=lambda e: (-experience_score(e), e["id"]))
    for e in tree:
        e["segments"].sort(key=lambda s: (-segment_score(s), s["id"]))
        for s in e["segments"]:
            s["qas"].sort(key=lambda q: (-q["local_score"], q["id"]))
    f = _Fit(tree, budget, count)
    done: dict = {"tokens_before": (count or tokens)(tree), "removed_qa": [], "removed_segments": [], "removed_experiences": [], "clipped": 0}
    n_exp, n_seg = len(tree), sum(len(e["segments"]) for e in tree)
    least_experiences, least_segments = min(least_experiences, n_exp), min(least_segments, n_seg)
    for q, s, e in sorted(((q, s, e) for e in tree for s in e["segments"] for q in s["qas"]), key=lambda x: (x[0]["local_score"], x[0]["id"])):
        if not f.over():
            break
        if f.left[id(s["qas"])] > 1:
            f.drop(s["qas"], q, s, e)
            done["removed_qa"].append(q["id"])
    f.pruned()
    waiting = sorted(((segment_score(s), s["id"], k, e, s) for k, (e, s) in enumerate((e, s) for e in tree for s in e["segments"])), key=lambda x: x[:3]) if f.over() else []
    for _, name, _, e, s in waiting:
        if n_seg <= least_segments or not f.over():
            break
        if f.left[id(e["segments"])] > 1:  # once an experience has one segment left, it keeps it
            f.drop(e["segments"], s, e)
            n_seg -= 1
            done["removed_segments"].append(name)
    f.pruned()
    waiting = sorted(((experience_score(e), e["id"], k, e) for k, e in enumerate(tree)), key=lambda x: x[:3]) if f.over() else []
    for _, name, _, e in waiting:
        if n_exp <= least_experiences or not f.over():
            break
        if n_seg - len(e["segments"]) >= least_segments:  # the left side only falls
            f.drop(tree, e)
            n_exp, n_seg = n_exp - 1, n_seg - len(e["segments"])
            done["removed_experiences"].append(name)
    f.pruned()
    if f.over():
        f.keep_sections(headers)
    for top, low in clips:
        if f.over():
            for e in tree:
                f.put(e, "summary", shortened(e["summary"], top))
                for s in e["segments"]:
                    f.put(s, "summary", shortened(s["summary"], low))
    fields = enumerate((q, c) for e in tree for s in e["segments"] for q in s["qas"] for c in ("assistant_output", "user_input"))
    longest = [(-len(q[c]), k, q, c) for k, (q, c) in fields if len(q[c] or "") > 96] if f.over() else []
    heapq.heapify(longest)  # of equally long ones the first, as their places differ
    for _ in range(256):
        if not longest or not f.over():
            break
        n, k, q, c = heapq.heappop(longest)
        f.put(q, c, q[c][: max(96, int(-n * 0.75)) - 1].rstrip() + "…")
        if len(q[c]) > 96:
            heapq.heappush(longest, (-len(q[c]), k, q, c))
        done["clipped"] += 1
    done["tokens_after"] = (count or tokens)(tree)
    done["context_overflow_unresolved"] = f.over()
    return tree, done


def old_branch_score(e: dict) -> float:
    leaves = [q["local_score"] for s in e["segments"] for q in s["qas"]]
    return clamp(0.6 * max(leaves, default=0.0) + 0.3 * max((s["local_score"] for s in e["segments"]), default=0.0) + 0.1 * e["local_score"])


def fit_branches(tree: Tree, budget: int = 30_000, least_experiences: int = 6, count: Callable[[Tree], int] | None = None, headers: Headers = Headers()) -> tuple[Tree, dict]:
    """The older policy: whole experiences go, the lowest first; then summaries are reduced to their kept sections, and the
    longest one that can be is cut by a fifth, 24 times at most."""
    tree = sorted(json.loads(json.dumps(tree)), key=lambda e: (-old_branch_score(e), e["id"]))
    f, removed = _Fit(tree, budget, count), []
    while f.over() and len(tree) > max(1, least_experiences):
        removed.append(tree[-1]["id"])
        f.drop(tree, tree[-1])
        tree.pop()
    if f.over():
        f.keep_sections(headers)
    for _ in range(24):
        nodes = sorted((n for e in tree for n in [e, *e["segments"]] if n["summary"]), key=lambda n: (-len(n["summary"]), n["id"]))
        if not f.over() or not any(f.put(n, "summary", cut_by_a_fifth(n["summary"], headers)) for n in nodes):
            break
    return tree, {"removed_experiences": removed, "context_overflow_unresolved": f.over(), "tokens_after": (count or tokens)(tree)}


FITTED = (
    "query_id long, tree string, tokens_before int, tokens_after int, overflow boolean, removed_qa array<string>, removed_segments array<string>, removed_experiences array<string>, clipped int"
)


def fit_trees(trees: DataFrame, **options) -> DataFrame:
    """``trees`` (query_id, tree as JSON) fitted, each in its task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for query, text in zip(frame["query_id"], frame["tree"], strict=True):
                tree, done = fit(json.loads(text), **options)
                out.append((query, json.dumps(tree, ensure_ascii=False, separators=(",", ":")), done["tokens_before"], done["tokens_after"], done["context_overflow_unresolved"],
                            done["removed_qa"], done["removed_segments"], done["removed_experiences"], done["clipped"]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")])

    return trees.select("query_id", "tree").mapInPandas(run, FITTED)
