from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest

from panelspark.llm import conversation_repair as repair

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, block STRING, kind INT, number INT, audit STRING"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def by_every_edit(turns):
    """(cost, audit) by Dijkstra-like search over states of the grammar, one turn after another."""
    best = {("0", 0): (0, "")}
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for i in range(len(turns) + 1):
        for _ in range(3):
            for state, role in itertools.product("0sua", "ua"):
                if (state, role) in step and (state, i) in best:
                    c, a = best[state, i]
                    to = (step[state, role], i)
                    best[to] = min(best.get(to, (1e9, "")), (c + 3, a + "I"))
        if i == len(turns):
            break
        initial, fault = turns[i]
        for state in "0sua":
            if (state, i) not in best:
                continue
            c, a = best[state, i]
            ways = [(state, 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways += [(step[state, initial], extra, "K")] if (state, initial) in step else []
                ways += [(step[state, r], extra + 3, "R") for r in "ua" if (state, r) in step and r != initial]
            for to, cost, edit in ways:
                best[to, i + 1] = min(best.get((to, i + 1), (1e9, "")), (c + cost, a + edit))
    return min(best[s, len(turns)] for s in "0a" if (s, len(turns)) in best)


def expected(rows, after=None):
    after = damaged(rows) if after is None else after
    out = []
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
        own = sorted((r for r in after if r[0] == conv), key=key)
        seen, turns, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in own:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1], fault))
            if fault:
                count[fault] += 1
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = by_every_edit(turns)
        n = len(audit) - audit.count("D")
        want, rest, whole = "s" * (n % 2) + "ua" * (n // 2), iter(own), []
        for edit in audit:
            _, _, role, text = next(rest) if edit != "I" else (0, 0, "", "")
            if edit != "D":
                at = want[len(whole)]
                whole.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[at]}:{text}")
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(whole).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(partitions)


def mean_conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["Yes.", "No!", "why", "Really? ", "", " \t", None, "ok.\n", "said \"so.\"", f"line {turn}.", f"{rng.random()}."])
            rows.append((None if conv == 7 else conv, None if rng.random() < 0.1 else turn + rng.randrange(3), rng.choice(roles), text))
    rows += [(200, t, ["user", "assistant"][t % 2], "w " * 30_000 + f"{t}.") for t in range(4)]
    rows += [(201, 1, "user", "same.")] * 25 + [(202, None, None, None)] * 3 + [(203, None, "user", "Hi."), (203, None, "assistant", "Hi.")]
    rows += [(300, t, rng.choice(["user", "user", "assistant", "system"]), f"Turn {t}" + rng.choice([".", "", "!"])) for t in range(400)]
    return rows


@pytest.mark.parametrize("bits", [repair.BLOCK_BITS, 3])
def test_against_brute_force(spark, docs_of, bits):
    docs_of([])
    rows = mean_conversations()
    assert sorted(map(tuple, repair.conversation_digest(table(spark, rows), bits).collect()), key=str) == expected(rows)


def test_every_short_conversation():
    for n in range(5):
        for turns in itertools.product([("s", ""), ("u", ""), ("a", ""), ("t", ""), ("u", "truncated"), ("a", "blank")], repeat=n):
            code = "".join("d" if f == "blank" else i.upper() if f else i if i in "sua" else "x" for i, f in turns)
            found = repair.part_transfers(code, True, True) if code else {("0", "0"): (0, "")}
            assert min(found[p] for p in (("0", "0"), ("0", "a")) if p in found) == by_every_edit(turns), turns


def test_parts_compose_to_the_whole(monkeypatch):
    rng = random.Random(1)
    whole = ["".join(rng.choice("suaxUAd") for _ in range(12)) for _ in range(30)]
    want = [repair.part_transfers(t, True, True) for t in whole]
    monkeypatch.setattr(repair, "CHUNK", 3)
    for turns, all_ in zip(whole, want):
        assert {p: v for p, v in repair.part_transfers(turns, True, True).items()} == all_


def test_band_holds_all_least_paths():
    rng = random.Random(2)
    for _ in range(300):
        turns = "".join(rng.choice("suaxUAd") for _ in range(rng.randrange(9)))
        wanted = ("s" if rng.random() < 0.5 else "") + "ua" * rng.randrange(5)
        free = repair.align(turns, wanted, float("inf"))
        if free is None:
            continue
        assert repair.align(turns, wanted, free[0]) == free
        assert free[0] == 0 or repair.align(turns, wanted, free[0] - 1) is None


def test_repaired_turns_follow_the_grammar(spark, docs_of):
    docs_of([])
    got = {}
    for r in sorted(repair.repaired_turns(table(spark, [r for r in mean_conversations() if r[0] is not None]), 4).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(r.role[0])
    for roles in got.values():
        text = "".join(roles).removeprefix("s")
        assert text and text == "ua" * (len(text) // 2)


def test_no_rows_and_all_dropped(spark, docs_of):
    docs_of([])
    assert repair.conversation_digest(table(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    rows = [(gone, 1, "user", "Hi.")]
    assert [tuple(r) for r in repair.conversation_digest(table(spark, rows)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
