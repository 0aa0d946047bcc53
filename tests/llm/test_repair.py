"""Repair of conversations against enumeration of all edits, and against a plain dynamic program over strings."""

import hashlib
import itertools
import random
import re
import zlib

from memjobs.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost string"
FORM = re.compile(r"(s?(ua)+)?")


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        told = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows, kinds):
    """Least (cost, audit) and the repaired lines over all edits with up to two inserts at a place."""
    inserts = [x for k in range(3) for x in itertools.product("ua", repeat=k)]
    best = None
    choices = []
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        each = [("D", 4, None)]
        if kind not in ("blank", "duplicate"):
            more = 3 * (kind == "truncated")
            each += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        choices.append(each)
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for picks in itertools.product(*choices):
            cost = sum(p[1] for p in picks) + 3 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for gap, pick in itertools.zip_longest(gaps, picks):
                audit += "I" * len(gap)
                lines += [({"u": "user", "a": "assistant"}[g], "") for g in gap]
                if pick:
                    audit += pick[0]
                    lines += [pick[2]] if pick[2] else []
            if all(r for r, _ in lines) and FORM.fullmatch("".join(r[0] for r, _ in lines)):
                best = min(best, (cost, audit, lines), key=lambda x: x[:2]) if best else (cost, audit, lines)
    return best


def by_strings(rows, kinds):
    """Least (cost, audit), states as strings: the same problem without integers or blocks."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    front = {"": (0, "")}

    def better(into, state, found):
        into[state] = min(into.get(state, found), found)

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit) in list(states.items()):
                better(states, follow[state], (cost + 3, audit + "I"))

    for (_, role, _), kind in zip(rows, kinds, strict=True):
        inserted(front)
        after = {}
        for state, (cost, audit) in front.items():
            better(after, state, (cost + 4, audit + "D"))
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                better(after, follow[state], (cost + 3 + more, audit + "R"))
                if role[:1] == follow[state] or (role[:1] == "s" and state == ""):
                    better(after, role[:1], (cost + more, audit + "K"))
        front = after
    inserted(front)
    return min(v for k, v in front.items() if k in ("", "a"))


def report_of(rows, kinds):
    c = R.Conversation()
    for (turn, role, text), kind in zip(rows, kinds, strict=True):
        c.add(turn, role, text, kind != "duplicate")
    return c


def random_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", " ", "u", ""]
    return [(t, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(["Yes.", "no", "", "One. ", "two?", "x!\n", f"t{t}.", f"t{t}"])) for t in range(n)]


def test_every_small_conversation_is_repaired_at_least_cost():
    rng = random.Random(4)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, *[3] * 12):
        rows = random_rows(rng, n)
        kinds = faults(rows)
        cost, audit, lines = enumerated(rows, kinds)
        told = "\n".join(f"{r}:{t}" for r, t in lines)
        assert report_of(rows, kinds).report() == (cost, audit, hashlib.sha256(told.encode()).hexdigest())


def test_blocks_change_nothing():
    rng = random.Random(8)
    for n in (R.BLOCK - 1, R.BLOCK, R.BLOCK + 1, 5 * R.BLOCK, 900):
        rows = random_rows(rng, n)
        kinds = faults(rows)
        cost, audit, digest = report_of(rows, kinds).report()
        assert (cost, audit) == by_strings(rows, kinds)
        told = "\n".join(f"{r}:{t}" for r, t in R.edited(audit, R.START, [(r, t) for _, r, t in rows]))
        assert digest == hashlib.sha256(told.encode()).hexdigest()


def test_query_on_odd_tables(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, r, x, "a", "b") for c in range(60) for t, r, x in random_rows(rng, rng.randint(1, 12))]
    rows += [(None, 1, "user", "Hi.", None, None), (None, None, None, None, None, None), (70, None, "user", "A.", "", ""), (70, None, None, None, "", ""), (71, 5, "user", "B " * 100_000, "", "")]
    rows += rows[:9]
    rows += [(72, t, "user", "the same.", "", "") for t in range(300)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/t/conversations.parquet")
    got = {r.conv_id: r for r in R.query(spark, f"file://{tmp_path}/t").collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = [d for r in rows if r[0] == conv for d in damage(*r[:4])]
        mine.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1], hashlib.sha256(d[2].encode()).digest()))
        kinds, r = faults(mine), got[conv]
        turns = [t for t, *_ in mine if t is not None]
        initials = [role[:1] for _, role, _ in mine]
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(kinds.count, ("blank", "duplicate", "truncated")))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert (r.cost, r.audit) == by_strings(mine, kinds)
    pieces = R.repaired_turns(R.damaged(spark.read.parquet(f"file://{tmp_path}/t/conversations.parquet"))).orderBy("conv_id", "place").collect()
    for conv in got:
        lines = [p for p in pieces if p.conv_id == conv]
        assert [p.place for p in lines] == list(range(len(lines)))
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{p.role}:{p.text}" for p in lines).encode()).hexdigest()
        assert "".join(p.edit for p in lines) == got[conv].audit.replace("D", "")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/t/conversations.parquet")
    assert R.query(spark, f"file://{tmp_path}/t").count() == 0
