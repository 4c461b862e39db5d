"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models count which character follows which: the random one in values that the patterns find, the ordinary one
in words.  Both learn from bounded samples of rows (about ``SAMPLE_ROWS`` and ``ORDINARY_ROWS``).  Tokens of 16 characters or more with letters and
digits are compared by the ratio of the two likelihoods and added where it is clear.  All of it is DataFrame
expressions: positions come from lengths, as a pattern with a lazy lead cuts a text into leads and matches; scores
from folding a token's characters over a table of ratios, which is a literal of 66 x 66 numbers.

Kinds are assign, access, hex and (added) random; places are code points, ends exclusive.  Defined results: null
and empty texts hold nothing; added spans never touch a base span; rows are judged by themselves, so ids may be
null or repeat.  Without labelled values the random model is uniform.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
SAMPLE_ROWS, ORDINARY_ROWS = 20_000, 1_000
KEYS = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:{KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
MIXED = "[A-Za-z][+/_=-]*[0-9]|[0-9][+/_=-]*[A-Za-z]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
WIDTH = len(ALPHABET) + 1
#: Natural logarithm of the odds from which a token is added, in all and for each character.
LEAST_RATIO, LEAST_PER_CHARACTER = 12.0, 0.5


def matches(text: Column, pattern: str, kind: int, groups: int, guard: Column) -> Column:
    """array<struct<a, k, b, own>> of all leftmost matches; ``own`` is the last group of the pattern, or the match.

    ``guard`` holds wherever there is a match: most texts are passed over by it."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else hits
    found = F.when(guard, F.arrays_zip(F.split(text, pattern, -1).alias("lead"), hits.alias("hit"), own.alias("own")))
    none = F.expr("cast(array() as array<struct<a:int,k:int,b:int,own:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):  # the last lead has no hit after it
        a = acc["at"] + F.char_length(x["lead"])
        b = a + F.char_length(x["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("a"), F.lit(kind).alias("k"), b.alias("b"), x["own"].alias("own")))).alias("out"))

    spans = F.aggregate(found, start, step, lambda acc: acc["out"])
    return F.coalesce(F.filter(spans, lambda m: m["own"].isNotNull()), none)


def base_columns(text: Column) -> tuple[Column, Column, Column]:
    assign = F.filter(matches(text, ASSIGN, 0, 1, text.rlike(f"(?i){KEYS}")), lambda m: F.char_length(m["own"]) >= 8)
    return assign, matches(text, ACCESS, 1, 0, text.contains("AKIA")), matches(text, HEX, 2, 0, text.rlike("[0-9a-f]{32}"))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the base matches of every row."""
    text = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    assign, access, hexes = base_columns(F.col("text"))
    return text.withColumns({"assign": assign, "access": access, "hex": hexes})


def pairs(tokens: DataFrame) -> DataFrame:
    """How often each character follows each, over column ``token``; 0 stands for a token's start and for other characters."""
    marked = tokens.select(F.concat(F.lit("^"), "token").alias("s"))
    i = F.explode(F.sequence(F.lit(2), F.char_length("s"))).alias("i")
    place = lambda at: F.expr(f"locate(substring(s, {at}, 1), '{ALPHABET}')")
    return marked.where(F.char_length("s") > 1).select("s", i).groupBy(place("i - 1").alias("p"), place("i").alias("c")).agg(F.count("*").alias("n"))


def log_likelihoods(counts: list, prior: float) -> list[float]:
    table = [[prior / WIDTH] * WIDTH for _ in range(WIDTH)]
    for p, c, n in counts:
        table[p][c] += n
    return [math.log(v / sum(row)) for row in table for v in row]


def sampled(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows by their hash, however many there are."""
    cut = min(2**63 - 1, int(min(1.0, rows / max(1, total)) * 2**63))
    return docs.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= F.lit(cut))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> list[float]:
    """The table of log ratios (random over ordinary), row by row.

    Both sums come from samples of rows that don't grow with docs, and are 66 x 66 counts whatever they hold."""
    total = docs.count()
    found = with_base(sampled(docs, sample_rows, total))
    values = found.select(F.explode(F.concat("assign", "access", "hex")).alias("m")).select(F.col("m.own").alias("token"))
    plain = sampled(docs, ordinary_rows, total)
    words = plain.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z_]{3,}[0-9]{0,3}"), F.lit(0))).alias("token"))
    words = words.where(~F.col("token").rlike(f"(?i){KEYS}|AKIA")).distinct()
    random = log_likelihoods(pairs(values).collect(), 200.0 * WIDTH)
    ordinary = log_likelihoods(pairs(words).collect(), 1.0)
    return [r - o for r, o in zip(random, ordinary)]


def ratio(token: Column, table: Column) -> Column:
    """Log odds of the token's characters, each after the one before it."""
    marked = F.concat(F.lit("^"), token)

    def step(acc, i):
        before, own = F.substring(marked, i - 1, F.lit(1)), F.substring(marked, i, F.lit(1))
        return acc + F.element_at(table, _place(before) * WIDTH + _place(own) + 1)

    return F.aggregate(F.sequence(F.lit(2), F.char_length(marked)), F.lit(0.0), step)


def _place(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def secret_spans(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, text and all spans of every row: ``base`` and ``added`` as array<struct<a, k, b, own>>."""
    ratios = F.lit(table if table is not None else train(docs))
    found = with_base(docs).withColumn("base", F.concat("assign", "access", "hex"))
    tokens = matches(F.col("text"), TOKEN, 3, 0, F.col("text").rlike(MIXED))

    def random(m):
        score = ratio(m["own"], ratios)
        return (m["own"].rlike("[0-9]") & m["own"].rlike("[A-Za-z]") & (score >= LEAST_RATIO) & (score >= LEAST_PER_CHARACTER * F.char_length(m["own"])))

    def added(both):  # a lambda's variable is computed once, a column named inside a lambda once for each element
        free = lambda m: ~F.exists(both["base"], lambda b: (b["a"] < m["b"]) & (m["a"] < b["b"]))
        return F.struct(both["base"].alias("base"), F.filter(F.filter(both["tokens"], free), random).alias("added"))

    both = F.transform(F.array(F.struct(F.col("base"), tokens.alias("tokens"))), added)
    return found.select("doc_id", "text", "assign", "access", "hex", F.get(both, F.lit(0)).alias("both")).select("*", "both.base", "both.added")


def _shown(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m["a"].alias("a"), m["k"].alias("k"), m["b"].alias("b"))))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", name(m["k"]), m["a"].cast("string"), m["b"].cast("string"))), ",")


def secret_digest(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, number of base spans by kind, base_sha256 and all spans of every row of docs."""
    found = secret_spans(docs, table)
    count = [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("assign", "access", "hex")]
    return found.select("doc_id", *count, F.sha2(_shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _shown(F.concat("base", "added")).alias("spans"))
