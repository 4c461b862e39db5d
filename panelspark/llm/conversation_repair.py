"""Conversation structure repair: the cheapest edits that give roles of the form ``(s?(ua)+)?``.

Turns are aligned, by Wagner and Fischer's table of edit costs, to each length of the alternating string that the
incumbent still lets be cheaper; Ukkonen's band keeps the table to cells that a path of at most the incumbent's cost
can pass.  Audits are traced back through the table and compared, so ties go to the ASCII-least.

Turns are in order of conversation, turn and digest over a range partitioning, and cut into blocks of 512.  A block aligns
its part of every conversation, 16 turns at a time, from each state of the grammar to each state that it may
end in; costs and audits of parts compose, so a conversation of any length is many blocks, and what comes to its end is one row
a block.  The last step streams a conversation's turns past its audit, holding one turn at a time: the hash of
the repaired text is sequential and makes that one task's work for one conversation, and the audit is one value.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate turns must go), Insert an empty user or assistant turn 3;
a truncated turn that stays adds 3.

Defined results: a null role or text is one space; a null conversation id is a conversation; null turns come first; turns of one
number are in order of the SHA-256 of role and text, so copies are neighbours and repeated rows are duplicates; a
conversation without turns has zeros, an empty audit and the hash of the empty string; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.rows import parts
from panelspark.llm.textbytes import give_back
from panelspark.scratch import materialise

SPACES = " \t\n\x0b\x0c\r"
BLOCK_BITS = 9
CHUNK = 16
START, SYSTEM, USER, ASSISTANT = "0sua"
STATES = START + SYSTEM + USER + ASSISTANT
PAIRS = [(e, x) for e in STATES for x in STATES if (x != START or e == START) and (x != SYSTEM or e in (START, SYSTEM))]
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}


# -- alignment ----------------------------------------------------------------------------------------------------------------


def target(entry: str, exit_: str, n: int) -> str | None:
    """The string of n role initials that leads from one state of the grammar to another, if there is one."""
    if n == 0:
        return "" if entry == exit_ else None
    if entry == START:
        if exit_ == SYSTEM:
            return "s" if n == 1 else None
        lead = "s" if exit_ in "ua" and n % 2 == (exit_ == ASSISTANT) and n > 1 else ""
    else:
        lead = ""
    rest = ("au" if entry == USER else "ua") * n
    found = lead + rest[:n - len(lead)]
    return found if found[-1] == exit_ and exit_ in "ua" else None


def align(turns: str, wanted: str, limit: float) -> tuple[int, str] | None:
    """Least cost of editing turns into the wanted initials, and its ASCII-least audit; None if it is over the limit.

    A turn is its initial (x: another), upper case where truncated, or d where it must go."""
    m, n = len(turns), len(wanted)

    def least(d: int) -> int:  # through a cell d deletions ahead of its insertions
        rest = m - n - d
        return (4 * d if d > 0 else -3 * d) + (4 * rest if rest > 0 else -3 * rest)

    low = high = 0
    if least(low) > limit:
        return None
    while low > -n and least(low - 1) <= limit:
        low -= 1
    while high < m and least(high + 1) <= limit:
        high += 1
    never = float("inf")
    table = [[never] * (n + 2) for _ in range(m + 2)]
    table[m][n] = 0
    for i in range(m, -1, -1):
        here, below = table[i], table[i + 1]
        turn = turns[i] if i < m else "d"
        extra = 3 if turn.isupper() else 0
        initial = turn.lower()
        for j in range(min(n, i - low), max(0, i - high) - 1, -1):
            best = here[j]
            if i < m:
                best = min(best, below[j] + 4)
            if j < n:
                want = wanted[j]
                if initial == want:
                    best = min(best, below[j + 1] + extra)
                elif want != "s":
                    if initial != "d":
                        best = min(best, below[j + 1] + extra + 3)
                if want != "s":
                    best = min(best, here[j + 1] + 3)
            here[j] = best
    if table[0][0] > limit or table[0][0] == never:
        return None
    audit, i, j = [], 0, 0
    while i < m or j < n:
        cost, turn = table[i][j], turns[i] if i < m else "d"
        extra, want = 3 if turn.isupper() else 0, wanted[j] if j < n else ""
        if i < m and table[i + 1][j] + 4 == cost:
            audit.append("D")
            i += 1
        elif want and want != "s" and table[i][j + 1] + 3 == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turn.lower() == want else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


@lru_cache(maxsize=100_000)
def transfer(turns: str, entry: str, exit_: str) -> tuple[int, str]:
    """Least cost and ASCII-least audit that take the grammar from one state to another over these turns."""
    if (entry, exit_) == (START, SYSTEM) and SYSTEM not in turns.lower():
        return float("inf"), ""  # a system turn can only be kept
    gone = turns.count("d")
    stay = len(turns) - gone
    best: tuple[float, str] = (float("inf"), "")
    for distance in range(1 << 30):
        open_ = False
        for n in {stay - distance, stay + distance}:
            least = 4 * gone + (3 * (n - stay) if n > stay else 4 * (stay - n))
            if n < 0 or least > best[0]:
                continue
            open_ = True
            wanted = target(entry, exit_, n)
            found = None if wanted is None else align(turns, wanted, best[0])
            if found is not None and found < best:
                best = found
        if not open_:
            return best
    raise AssertionError


def compose(first: dict, second: dict) -> dict:
    """Parts one after another: of all ways through the state between them, the cheapest, then the ASCII-least."""
    out: dict = {}
    for (e, mid), (c1, a1) in first.items():
        for (mid2, x), (c2, a2) in second.items():
            if mid == mid2:
                own = (c1 + c2, a1 + a2)
                if (e, x) not in out or own < out[e, x]:
                    out[e, x] = own
    return out


def part_transfers(turns: str, begins: bool, ends: bool) -> dict[tuple[str, str], tuple[int, str]]:
    """Costs and audits of a part of a conversation, for each pair of states that it may lie between."""
    chunks = [turns[i:i + CHUNK] for i in range(0, len(turns), CHUNK)]
    last = len(chunks) - 1
    found = []
    for k, chunk in enumerate(chunks):
        own = {(e, x): transfer(chunk, e, x) for e, x in PAIRS
               if (e == START or k or not begins) and (x in (START, ASSISTANT) or k < last or not ends)}
        found.append({pair: way for pair, way in own.items() if way[0] < float("inf")})
    return reduce(compose, found)


# -- rows ---------------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with every fault planted by the checksum of conversation and turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
                                 F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), code.alias("code"))
            .where("code <> 0")
            .select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


def _keyed(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
                        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"))


def _features(turns: DataFrame) -> DataFrame:
    """What the alignment needs of a turn: its order, its initial and its own faults."""
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    return _keyed(turns).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), (F.rtrim("text", F.lit(SPACES)) == "").alias("blank"),
                                (~end.isin(".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("row"))


_PART = ("conv_id BIGINT, block BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, first_initial STRING, last_initial STRING, "
         "min_turn BIGINT, max_turn BIGINT, first_turn BIGINT, n_turns BIGINT, pairs ARRAY<STRING>, costs ARRAY<BIGINT>, audits ARRAY<STRING>")
_PART_ARROW = pa.schema([(name, {"BIGINT": pa.int64(), "STRING": pa.string(), "ARRAY<STRING>": pa.list_(pa.string()), "ARRAY<BIGINT>": pa.list_(pa.int64())}[kind])
                         for name, kind in (f.split(" ") for f in _PART.split(", "))])


def _parts(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """One block: a row for each conversation that has turns in it."""
    rows = rows.sort_by("number").to_pylist()
    first = set(firsts.column("number").to_pylist())
    cuts = [i for i in range(len(rows)) if i == 0 or rows[i]["conv_id"] != rows[i - 1]["conv_id"]] + [len(rows)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        own, turns = rows[a:b], []
        blank = duplicate = truncated = illegal = 0
        for row in own:
            initial = row["initial"] if row["initial"] in ("s", "u", "a") else "x"
            if row["blank"]:
                blank, turn = blank + 1, "d"
            elif row["number"] not in first:
                duplicate, turn = duplicate + 1, "d"
            elif row["truncated"]:
                truncated, turn = truncated + 1, initial.upper()
            else:
                turn = initial
            turns.append(turn)
        illegal = sum(p["initial"] + q["initial"] not in LEGAL for p, q in zip(own, own[1:]))
        numbered = [r["turn"] for r in own if r["turn"] is not None]
        found = part_transfers("".join(turns), a > 0, b < len(rows))
        out.append({"conv_id": own[0]["conv_id"], "block": own[0]["block"], "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
                    "first_initial": own[0]["initial"], "last_initial": own[-1]["initial"], "min_turn": min(numbered, default=None), "max_turn": max(numbered, default=None),
                    "first_turn": numbered[0] if numbered else None, "n_turns": len(set(numbered)), "pairs": [e + x for e, x in found],
                    "costs": [int(c) for c, _ in found.values()], "audits": [a for _, a in found.values()]})
    return pa.Table.from_pylist(out, _PART_ARROW)


def conversation_parts(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Every block's part of every conversation: its faults, and the cheapest edits between states of the grammar."""
    spark = turns.sparkSession
    keys = ["conv_id", "turn", "digest", "row"]
    features = materialise(_features(turns), "turn-features")  # ranges are sampled from it; row splits equal turns
    ranged = features.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumn("number", F.monotonically_increasing_id())
                         .withColumn("block", F.shiftright("number", block_bits)).drop("row"), "turns")
    firsts = placed.where("not blank").groupBy("conv_id", "digest").agg(F.min("number").alias("number"))
    firsts = firsts.select(F.shiftright("number", block_bits).alias("block"), "number")
    return placed.drop("digest").groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_parts, _PART)


class _Conversation:
    """A conversation as its rows stream past: parts first, then turns in order."""

    def __init__(self, conv_id):
        self.conv_id, self.found, self.last = conv_id, {(START, START): (0, "")}, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = self.seen = None
        self.turns, self.audit, self.at, self.place = 0, None, 0, 0

    def part(self, row: dict) -> None:
        self.found = compose(self.found, {tuple(p): (c, a) for p, c, a in zip(row["pairs"], row["costs"], row["audits"])})
        for name in self.counts:
            self.counts[name] += row[name]
        if self.last is not None and self.last + row["first_initial"] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = row["last_initial"]
        if row["n_turns"]:
            self.turns += row["n_turns"] - (row["first_turn"] == self.seen)
            self.seen = self.most = row["max_turn"]
            self.least = row["min_turn"] if self.least is None else self.least

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(v for (e, x), v in self.found.items() if x in (START, ASSISTANT))
            length = len(self.audit) - self.audit.count("D")
            self.wanted = "s" * (length % 2) + "ua" * (length // 2)

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        self.settle()
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", ROLES[self.wanted[self.place]], ""
            self.at, self.place = self.at + 1, self.place + 1

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What this turn becomes, after what is inserted before it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, role if edit == "K" else ROLES[self.wanted[self.place]], text
            self.place += 1

    def digest_row(self) -> dict:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": int(self.cost), "audit": self.audit}


_DIGEST = ("conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, audit STRING, repaired_sha256 STRING")
_TURNS = "conv_id BIGINT, place BIGINT, edit STRING, role STRING, text STRING"


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if k == "BIGINT" else pa.string()) for n, k in (f.split(" ") for f in ddl.split(", "))])


def _stream(digest: bool):
    """Sorted rows (conversations, parts, turns): a digest of each conversation, or its repaired turns."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_DIGEST if digest else _TURNS)
        now, sha, out = None, None, []

        def take(turns) -> None:
            for edit, role, text in turns:
                if digest:
                    sha.update(f"{chr(10) if now.written else ''}{role}:{text}".encode())
                else:
                    out.append({"conv_id": now.conv_id, "place": now.written, "edit": edit, "role": role, "text": text})
                now.written += 1

        def end() -> None:
            take(now.inserted())
            if digest:
                out.append(now.digest_row() | {"repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    if now is not None:
                        end()
                    now, sha = _Conversation(row["conv_id"]), hashlib.sha256()
                    now.written = 0
                if row["kind"] == 1:
                    now.part(row)
                elif row["kind"] == 2:
                    take(now.turn(row["role"], row["text"]))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now is not None:
            end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
        give_back()

    return run


def _streamed(turns: DataFrame, conversations: DataFrame, digest: bool, block_bits: int) -> DataFrame:
    spark = turns.sparkSession
    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().withColumn("kind", F.lit(0))
    found = materialise(conversation_parts(turns, block_bits), "parts").withColumn("kind", F.lit(1))
    rows = _keyed(turns).withColumn("kind", F.lit(2))
    keys = ["conv_id", "kind", "block", "turn", "digest"]
    union = found.unionByName(rows, allowMissingColumns=True).unionByName(ids, allowMissingColumns=True)
    return (union.repartition(parts(spark), "conv_id").sortWithinPartitions(*keys).drop("digest")
            .mapInArrow(_stream(digest), _DIGEST if digest else _TURNS))


def repaired_turns(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, place, edit (K, R or I), role and text of every conversation's turns after the cheapest edits."""
    return _streamed(turns, turns, False, block_bits)


def repair_audit(turns: DataFrame, conversations: DataFrame | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Faults, cost, audit and the hash of the repaired text of every conversation (of ``conversations``, if given)."""
    return _streamed(turns, turns if conversations is None else conversations, True, block_bits)


def conversation_digest(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The audit of the conversations after faults are planted."""
    return repair_audit(damaged(conversations), conversations, block_bits)
