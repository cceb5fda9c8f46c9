"""Repair of conversations against an exhaustive search, for whole conversations and for ones cut into segments."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from farelens.llm import conversations

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, c STRING, segment STRING, case STRING"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "s", "x") for r in rows], SCHEMA).repartition(3)


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else "".join(x for x in text if x not in ".!?") if case == 2 else text
        out += [(c, t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def searched(rows):
    """(cost, audit, written rows) by trying every edit, up to two inserts in a row; rows are (role, text, must go, truncated)."""
    best = [None]

    def accepted(roles):
        rest = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (len(rest) > 0 and rest == "ua" * (len(rest) // 2))

    def go(at, audit, cost, written, inserts):
        roles = "".join(w[0][:1] for w in written)
        rest = roles[1:] if roles[:1] == "s" else roles
        if any(w[0] == "" for w in written) or rest != ("ua" * len(rest))[: len(rest)]:
            return
        if best[0] is not None and cost > best[0][0]:
            return
        if at == len(rows) and accepted(roles) and (best[0] is None or (cost, audit) < best[0][:2]):
            best[0] = cost, audit, written
        if inserts < 2:
            for role in ("user", "assistant"):
                go(at, audit + "I", cost + 2, [*written, (role, "")], inserts + 1)
        if at == len(rows):
            return
        role, text, must, cut = rows[at]
        go(at + 1, audit + "D", cost + 3, written, 0)
        if not must:
            go(at + 1, audit + "K", cost + cut, [*written, (role, text)], 0)
            for other in ("user", "assistant"):
                go(at + 1, audit + "R", cost + 2 + cut, [*written, (other, text)], 0)

    go(0, "", 0, [], 0)
    return best[0]


def plain(rows, every, solve):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role, text))
    out = []
    for c in {r[0] for r in every}:
        told = sorted(groups[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, facts, faults = set(), [], Counter()
        for _, role, text in told:
            bare = not text.strip(SPACE)
            again = not bare and (role, text) in seen
            cut = not bare and not again and text.rstrip(SPACE)[-1] not in ".!?"
            seen.add((role, text))
            faults.update(blank=bare, duplicate=again, truncated=cut)
            facts.append((role, text, bare or again, int(cut)))
        cost, audit, written = solve(facts)
        turns = {t for t, _, _ in told if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for _, role, _ in told]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in written).encode()).hexdigest()
        out.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def talk(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "", " \t", "a b c", "Why? ", "Ünd.", "x\n", "Yes."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "USER"]
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice((0, 1, 1, 1, 1, 3))
            rows.append((c, rng.choice((turn, turn, turn, turn, None)), rng.choice(roles), rng.choice(texts)))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_against_search(spark):
    rows = talk(1, 150, 7)
    rows += [(None, None, "user", "Hi."), (None, 3, None, None), (None, 3, None, None), (-5, 1, "user", "x" * 300_000), (7, 1, "user", "Yes.")]
    found = conversations.repair_conversations(conversations.damaged(frame(spark, rows)), frame(spark, rows))
    assert got(found) == plain(plain_damage(rows), rows, searched)


def test_ends_and_empties(spark):
    empty = frame(spark, talk(1, 2, 3)).limit(0)
    assert got(conversations.repair_conversations(empty, empty)) == []
    some = conversations.repair_conversations(empty, frame(spark, [(4, 0, "user", "x"), (4, 1, "user", "x")]))
    assert got(some) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_damage(spark):
    rows = talk(3, 80, 9)
    left = conversations.damaged(frame(spark, rows)).collect()
    assert Counter(map(tuple, left)) == Counter(plain_damage(rows))


def step_by_step(facts):
    """The least (cost, letters) for each last role, kept as texts: a plain version for long conversations."""
    best = {"": (0, "", ())}
    follow = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for role, text, must, cut in facts:
        options = defaultdict(list)
        before = list(best.items())
        before += [(follow[n][:1], (c + 2, w + "I", (*out, (follow[n], "")))) for n, (c, w, out) in best.items()]
        for node, (cost, word, out) in before:
            options[node].append((cost + 3, word + "D", out))
            if not must:
                target = follow[node]
                options[target[:1]].append((cost + 2 + cut, word + "R", (*out, (target, text))))
                if role[:1] == target[:1] or (node == "" and role[:1] == "s"):
                    options[role[:1]].append((cost + cut, word + "K", (*out, (role, text))))
        best = {node: min(found, key=lambda f: f[:2]) for node, found in options.items()}
    ends = []
    for node, (cost, word, out) in best.items():
        while node not in ("", "a"):
            cost, word, out, node = cost + 2, word + "I", (*out, (follow[node], "")), follow[node][:1]
        ends.append((cost, word, out))
    return min(ends, key=lambda f: f[:2])


@pytest.mark.parametrize("seed", [5, 6])
def test_long_conversations_are_cut(spark, monkeypatch, seed):
    """Conversations of many pieces and segments, one of them of rows that are all the same, give what one task gives."""
    rng = random.Random(seed)
    rows = [(c, t, role, f"{text} {rng.randrange(40)}" if rng.random() < 0.5 else text) for c, t, role, text in talk(seed, 3, 400)]
    rows += [(8, None, "user", "Same.")] * 300 + [(None, t, "user", "Never.") for t in range(200)]
    rows += [(9, t, "user", f"Only {t}.") for t in range(150)]
    expected = plain(rows, rows, step_by_step)
    assert got(conversations.repair_conversations(frame(spark, rows), frame(spark, rows))) == expected
    assert got(conversations.repair_conversations(frame(spark, rows), frame(spark, rows), long=20)) == expected


def test_plain_versions_agree():
    rng = random.Random(9)
    for _ in range(300):
        facts = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randrange(6))]
        assert searched(facts)[:2] == step_by_step(facts)[:2]
        rows = [conversations.Row(role[:1], must, bool(cut)) for role, _, must, cut in facts]
        cut_facts = [(r, t, m, 0 if m else c) for r, t, m, c in facts]
        assert conversations.repair(rows) == searched(cut_facts)[:2]
