"""Small tables that hold every awkward case."""

from __future__ import annotations

import random

WORDS = "the of stone rivér and to a in Wind over small Häuser copper letter morning field bridge seven winter garden paper".split()


def prose(seed: int, n: int, line: int = 9) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", ",", "."]) + str(rng.randrange(60)) * (rng.random() < 0.3) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) for i in range(0, n, line))


def mean_rows() -> list[tuple]:
    """Nulls, empty and blank texts, one very long text, copies, near copies, repeated rows, one id with two texts, a null id."""
    a, b, c = prose(1, 160), prose(2, 220), prose(3, 90)
    near = a.replace("stone", "STONE").replace("winter", "summer", 1)
    passage = "\n".join(prose(9, 70).split("\n"))
    return [(1, a), (2, b), (3, a), (4, near), (5, c), (5, c), (6, None), (7, ""), (8, " \t\n "), (None, b + "\nlast words"), (9, prose(4, 30) + "\n" + passage),
            (10, passage + "\n" + prose(5, 50)), (11, passage), (12, prose(6, 6000)), (13, c + "\n" + prose(7, 20)), (13, prose(8, 40)), (14, "one two"),
            (15, "one  TWO"), (16, "x"), (17, None), (18, "\n\n\n"), (19, "ß é 漢字 漢字 " * 30), (20, "ab" * 900)]
