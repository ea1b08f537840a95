import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from helixflow.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, edit string, cost string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_script(rows):
    """(cost, audit, roles and texts) of every list of edits with at most two inserts between rows."""
    fault = faults(rows)
    fill = [x for n in range(3) for x in itertools.product(["user", "assistant"], repeat=n)]

    def go(i, cost, audit, made):
        for new in fill:
            c, a, m = cost + 3 * len(new), audit + "I" * len(new), made + [(r, "") for r in new]
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "x" for r, _ in m)):
                    yield c, a, m
                continue
            _, role, text = rows[i]
            yield from go(i + 1, c + 4, a + "D", m)
            if fault[i] not in ("blank", "duplicate"):
                extra = 3 if fault[i] == "truncated" else 0
                if role:
                    yield from go(i + 1, c + extra, a + "K", [*m, (role, text)])
                for to in ("user", "assistant"):
                    yield from go(i + 1, c + 3 + extra, a + "R", [*m, (to, text)])

    return go(0, 0, "", [])


def plain(rows):
    """The same by a table of (rows read, end of the initials)."""
    fault, ways = faults(rows), {"": (0, "", [])}

    def better(new, w, out):
        end = new and ("s" if new == "s" else new[-1])
        if re.fullmatch("s?(ua)*u?", new) and (end not in out or w[:2] < out[end][:2]):
            out[end] = w

    def inserted(ways):
        out = dict(ways)
        for end, (c, a, m) in ways.items():
            for role in ("user", "assistant"):
                better(follow(end, role[0]), (c + 3, a + "I", [*m, (role, "")]), out)
        return out

    def follow(end, initial):
        return {"": initial, "s": "s" + initial, "u": "u" + initial, "a": "ua" + initial}[end]

    for i, (_, role, text) in enumerate(rows):
        out = {}
        for end, (c, a, m) in inserted(ways).items():
            if end not in out or (c + 4, a + "D") < out[end][:2]:
                out[end] = (c + 4, a + "D", m)
            if fault[i] not in ("blank", "duplicate"):
                extra = 3 if fault[i] == "truncated" else 0
                better(follow(end, role[:1] or "x"), (c + extra, a + "K", [*m, (role, text)]), out)
                for to in ("user", "assistant"):
                    better(follow(end, to[0]), (c + 3 + extra, a + "R", [*m, (to, text)]), out)
        ways = out
    ways = inserted(inserted(ways))
    return min((w for end, w in ways.items() if end in ("", "a")), key=lambda x: x[:2])


def test_plain_table_against_all_scripts(conversations):
    for conv in range(60):
        rows = [tuple(r) for c, *r in conversations if c == conv][:2]
        assert plain(rows) == min(every_script(rows), key=lambda x: x[:2])


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, made = plain(rows)
    fault, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [fault.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def reported(found):
    return {r["conv_id"]: tuple(r)[1:] for r in repair.report(found).collect()}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Ünï.", "Done. \t\n"]
    roles = ["user", "assistant", "system", "tool", ""]
    out = []
    for conv in range(60):
        for _ in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)))
    return out


@pytest.mark.parametrize("block", [1, 2, 256])
def test_cheapest_edits_against_all_scripts(spark, conversations, block):
    got = reported(repair.edits(frame(spark, conversations), block=block))
    by_conv = {}
    for conv, *row in conversations:
        by_conv.setdefault(conv, []).append(tuple(row))
    assert got == {conv: expected(rows) for conv, rows in by_conv.items()}


def test_long_conversations_in_blocks():
    """Blocks of any size give what one search over the whole conversation gives, and texts leave early."""
    rng = random.Random(9)
    for n in (40, 150, 700):
        kinds = [rng.choice("ssuuuaaax") + rng.choice("gttfffffff") for _ in range(n)]
        whole = repair._search("".join(kinds), 0, True)
        for block in (1, 7, 64):
            now, audit, most = repair._Conversation(1, block), "", 0
            for k in kinds:
                audit += "".join(e[2] for e in now.add((0, "r", "t", None, k)))
                most = max(most, len(now.held))
            audit += "".join(e[2] for e in now.end())
            assert audit == next(iter(whole.values()))[1]
            assert most <= block + 40


def test_damage_and_report(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Text {c} {t}. Wait! Why?") for c in range(80) for t in range(4)]
    rows += [(None, None, None, None), (500, 1, "user", "x")]
    got = reported(repair.edits(repair.damaged(frame(spark, rows)), live=F.col("live")))
    live = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            one = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            live[c] += [one] * (2 if kind == 3 else 1)
    assert got == {c: expected(r) for c, r in live.items()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[None] == (0, 1, 0, 0, 0, 4, "D", none)


def test_edits_and_repaired_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "tool", "So?"), (1, 2, "user", ""), (1, 3, "user", "more"), (2, 0, "system", "S.")]
    found = repair.edits(frame(spark, rows))
    assert [tuple(r) for r in found.filter("conv_id = 1").select("edit", "was", "role", "text", "fault", "cost").collect()] == [
        ("K", "user", "user", "Hi.", None, 0), ("R", "tool", "assistant", "So?", None, 3), ("D", "user", None, "", "blank", 4), ("D", "user", None, "more", "truncated", 4),
    ]
    assert [tuple(r) for r in repair.repaired(found).collect()] == [(1, "user", "Hi."), (1, "assistant", "So?")]


def test_repair_edges(spark):
    empty = frame(spark, []).limit(0)
    assert repair.report(repair.edits(empty)).count() == 0
    long = "word " * 200_000 + "."
    rows = [(7, 0, "user", long), (7, 0, "user", long), (7, 1, "assistant", "A."), (8, 0, "user", "gone")]
    got = reported(repair.edits(frame(spark, rows), live=F.col("conv_id") == 7))
    assert got[7][6] == "KDK" and got[7][7] == hashlib.sha256(f"user:{long}\nassistant:A.".encode()).hexdigest()
    assert got[8] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
