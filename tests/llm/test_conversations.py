"""Conversation repair against every possible repair of short conversations, and its defined cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from scholium.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def every_repair(rows):
    """(cost, audit, repaired) over all edits with up to two inserts in each gap."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        core = text.rstrip(SPACE)
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    fillers = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    each = []
    for (_, _, role, text), kind in zip(rows, kinds):
        moves = [(2, "D", ())]
        if kind not in ("blank", "duplicate"):
            more = 5 * (kind == "truncated")
            moves += [(more, "K", ((role, text),)), (1 + more, "R", (("user", text),)), (1 + more, "R", (("assistant", text),))]
        each.append([(5 * len(f) + m, "I" * len(f) + e, tuple((r, "") for r in f) + t) for f in fillers for m, e, t in moves])
    each.append([(5 * len(f), "I" * len(f), tuple((r, "") for r in f)) for f in fillers])
    best = None
    for found in itertools.product(*each):
        turns = [t for _, _, ts in found for t in ts]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
            key = (sum(f[0] for f in found), "".join(f[1] for f in found))
            if best is None or key < best[0]:
                best = (key, "\n".join(f"{r}:{t}" for r, t in turns))
    return *best[0], hashlib.sha256(best[1].encode()).hexdigest(), kinds


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    cost, audit, digest, kinds = every_repair(rows)
    turns = {r[1] for r in rows} - {None}
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, digest,
    )


def sample(seed, n=40):
    rnd = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rnd.randrange(5)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rnd.choice(["Yes.", "No!", "half", "", " \n", None, "é? ", "Yes."])
            out.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_repair(spark, seed):
    rows = sample(seed)
    groups = {}
    for row in damage(rows):
        groups.setdefault(row[0], []).append(row)
    small = {k for k in {r[0] for r in rows} if len(groups.get(k, [])) <= 3}
    want = {k: expected(groups.get(k, [])) for k in small}
    df = spark.createDataFrame([r for r in rows if r[0] in small], SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in c.repair_rows(c.damaged(df)).collect()}
    assert got == want and len(want) > 20


def test_moves_by_brute_force_without_spark():
    rnd = random.Random(7)
    for _ in range(60):
        rows = [(1, i, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["a.", "b.", "c", "", "d?", "e."])) for i in range(rnd.randrange(4))]
        now = c.Conversation(1, c.Steps())
        seen = set()
        for _, turn, role, text in rows:
            core = text.rstrip(SPACE)
            now.add(turn, role, text, not core, (role, text) in seen, bool(core) and core[-1] not in ".!?")
            seen.add((role, text))
        assert now.close()[1:] == expected(rows)


def test_a_long_conversation_has_few_layers(spark):
    """Moves are looked up: their number does not grow with the conversation, and long runs of deletions cost nothing more."""
    rnd = random.Random(3)
    steps = c.Steps()
    now = c.Conversation(1, steps)
    for i in range(20_000):
        now.add(i, rnd.choice(["user", "assistant", "system", "tool"]), f"t{i}", rnd.random() < 0.3, False, rnd.random() < 0.5)
    assert len(now.close()[7].replace("I", "")) == 20_000 and len(steps.steps) < 3000
    now = c.Conversation(1, steps)
    now.add(0, "system", "s.", False, False, False)
    for i in range(5000):
        now.add(i + 1, "user", "", True, False, False)
    assert now.close()[6:8] == (10_002, "D" * 5001)


def test_defined_cases(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (5, 1, "user", "Hi."), (5, 1, "user", "Hi."), (5, 2, "assistant", "long. " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", audit long, gone string")
    got = {r["conv_id"]: r for r in c.repair_rows(c.undamaged(df)).collect()}
    assert (got[None]["blank"], got[None]["audit"], got[None]["cost"]) == (1, "DD", 4)
    assert (got[5]["duplicate"], got[5]["audit"], got[5]["cost"], got[5]["gaps"]) == (1, "KDK", 2, 0)
    assert c.repair_rows(c.damaged(df.limit(0))).count() == 0
    assert c.repair_rows(c.damaged(df)).count() == 2
    gone = spark.createDataFrame([(i, t, "user", "x.") for i in range(3) for t in range(60)], SCHEMA)
    gone = c.damaged(gone).filter("gone")
    assert {tuple(r)[1:] for r in c.repair_rows(gone).collect()} == {(0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_repaired_turns_follow_the_audit(spark):
    rows = c.undamaged(spark.createDataFrame([r for r in sample(4) if r[0] % 3], SCHEMA))
    lines = {r["conv_id"]: r for r in c.repair_rows(rows).collect()}
    turns = {}
    for r in c.repaired_turns(rows).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, line in lines.items():
        own = sorted(turns.get(conv, []), key=lambda r: r["place"])
        assert "".join(r["edit"] for r in own) == line["audit"].replace("D", "")
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(text.encode()).hexdigest() == line["repaired_sha256"]
