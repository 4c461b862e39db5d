"""Personal data: fixed patterns, and a character tagger (BiLSTM with a CRF) that adds what looks like them.

Labelled spans are the patterns' own matches in whole texts of about ``SAMPLE_ROWS`` of the rows that hold a digit or
@, or of all if there are fewer, by hash of the row; of the windows around them and elsewhere, which tasks cut, those of
the smallest hashes train the tagger (``QUOTAS``, the one bound on what reaches the driver).  The tagger goes to the
tasks by value (a few thousand numbers).  Every whole text is then tagged in overlapping windows; where two overlap, each has
the half away from its edge, and spans are read off the text's joined tags.  A span that the patterns have not
touched is added if it holds what its kind needs (see ``plausible``).

Kinds are email, ip, card, phone; places are code points, ends exclusive.  Defined results: null or empty
texts have no spans; no labelled spans in the sample, no tagger, base spans alone; every row is judged by itself,
so ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bilstm_crf import PAD, Tagger, symbols
from panelspark.llm.textbytes import Slice, frames, ranges
from panelspark.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 20_000
TRAIN_WINDOWS, TRAIN_STEPS = 2_400, 96
#: Windows of each kind, and of places that no pattern touches.
QUOTAS = (*[TRAIN_WINDOWS // 8] * len(KINDS), TRAIN_WINDOWS // 2)
#: Windows cut around a place, each at an offset of its own.
CUTS = 3
WINDOW, OVERLAP, BATCH = 256, 32, 2048
_PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_DIGIT = re.compile("[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in text.split("."))


def passes(kind: int, match: str) -> bool:
    if kind == 1:
        return _octets(match)
    if kind == 2:
        return 14 <= len(digits(match)) <= 19 and luhn(digits(match))
    return kind == 0 or 10 <= len(digits(match)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every match that passes, by start and kind."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in _PATTERNS[0].finditer(text)]
    if _DIGIT.search(text):
        for kind in (1, 2, 3):
            if kind == 2 or (("." if kind == 1 else "+") in text):
                found += [(m.start(), kind, m.end()) for m in _PATTERNS[kind].finditer(text) if passes(kind, m[0])]
    return sorted(found)


def plausible(kind: int, text: str) -> bool:
    """What an added span must hold: an address's sign and dot, four numbers up to 255, a card's check digit, or as many
    digits as a phone number has."""
    n = len(digits(text))
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s?(@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9].*?[A-Za-z0-9]", text)) and len(text) >= 6
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= n <= 19 and luhn(digits(text))
    return 10 <= n <= 15


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def training_windows(text: str, seed: int = 17) -> list[tuple[int, int, bytes, bytes]]:
    """(kind, key, symbols, tags) of windows around a text's labelled spans, and elsewhere; those of the smallest keys."""
    rng = np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")])
    spans = base_spans(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sym, tags = symbols(codes), np.zeros(len(codes), np.uint8)
    for a, k, b in reversed(spans):  # the kind listed first wins where two overlap
        tags[a:b] = k + 1
    spots = [(a, k) for a, k, _ in spans]
    spots += [(m.start(), len(KINDS)) for m in re.finditer(r"[0-9][0-9 .()-]{2,}", text) if not tags[m.start():m.end()].any()]
    spots.append((int(rng.integers(0, max(1, len(codes)))), len(KINDS)))
    place, kind = np.repeat(np.array(spots, np.int64), CUTS, axis=0).T
    keys, back = rng.integers(0, 2**63 - 1, len(place)), rng.integers(0, TRAIN_STEPS - 30, len(place))
    out = []
    for k, quota in enumerate(QUOTAS):
        own = np.flatnonzero(kind == k)
        for i in own[np.argsort(keys[own])[:quota]]:
            at = max(0, min(int(place[i] - back[i]), len(sym) - TRAIN_STEPS))
            x, y = np.full(TRAIN_STEPS, PAD, np.uint8), np.zeros(TRAIN_STEPS, np.uint8)
            part = slice(at, at + TRAIN_STEPS)
            x[:len(sym[part])], y[:len(sym[part])] = sym[part], tags[part]
            out.append((k, int(keys[i]), x.tobytes(), y.tobytes()))
    return out


_WINDOWS = "kind INT, key BIGINT, x BINARY, y BINARY"


def cut_windows(batches) -> Iterator[pa.RecordBatch]:
    """A task's training windows of the smallest keys, at most ``QUOTAS`` of them."""
    best: list[list] = [[] for _ in QUOTAS]
    for _, part in frames(batches):
        for i in range(len(part)):
            for window in training_windows(part.text(i).decode("utf-8", "replace")):
                best[window[0]].append(window)
            best = [sorted(set(b))[:q] if len(b) > 4 * q else b for b, q in zip(best, QUOTAS)]
    rows = [w for b, q in zip(best, QUOTAS) for w in sorted(set(b))[:q]]
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in rows], t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in _WINDOWS.split(", ")])


def training_set(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Symbols and tags (windows, steps), as many as ``QUOTAS`` of each kind that docs hold; None without labelled spans."""
    marked = docs.select(F.col("doc_id").cast("bigint"), "text").where(F.col("text").rlike("[0-9@]"))
    cut = int(min(1.0, sample_rows / max(1, marked.count())) * 2**63)
    chosen = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) <= F.lit(min(cut, 2**63 - 1))
    windows = materialise(marked.where(chosen).mapInArrow(cut_windows, _WINDOWS).dropDuplicates(["kind", "key"]), "windows")
    drawn = [windows.where(F.col("kind") == k).orderBy("key").limit(q).collect() for k, q in enumerate(QUOTAS)]
    if not any(drawn[:-1]):
        return None
    rows = [own[i % len(own)] for own, q in zip(drawn, QUOTAS) if own for i in range(q)]
    return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.uint8).reshape(-1, TRAIN_STEPS) for c in ("x", "y"))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Tagger | None:
    """A tagger trained on the labelled spans of a sample that doesn't grow with docs; None if it has none."""
    windows = training_set(docs, sample_rows)
    if windows is None:
        return None
    tagger = Tagger(len(KINDS) + 1)
    tagger.fit(*windows)
    return tagger


def tag_slice(tagger: Tagger, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tags of all characters of some texts, each decoded in overlapping windows that are joined."""
    sizes = np.diff(offsets)
    step = WINDOW - OVERLAP
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // step)), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    k = ranges(count)
    start = offsets[doc] + k * step
    end = np.minimum(start + WINDOW, offsets[doc + 1])
    # A window has the text's ends whole, and half of what it shares with a neighbour.
    first = np.where(k == 0, start, start + OVERLAP // 2)
    last = np.where(k == count[doc] - 1, end, np.minimum(end, start + WINDOW - OVERLAP // 2))
    tags = np.zeros(len(sym), np.uint8)
    padded = np.concatenate([sym, np.full(WINDOW, PAD, np.uint8)])
    steps = np.arange(WINDOW)[:, None]
    for at in range(0, len(start), BATCH):
        s, e = start[at:at + BATCH], end[at:at + BATCH]
        x = padded[s + steps]
        x[steps >= e - s] = PAD
        got = tagger.decode(x)
        hit = np.flatnonzero(got.any(axis=0))
        for w in hit:
            a, b = first[at + w], last[at + w]
            tags[a:b] = got[a - s[w]:b - s[w], w]
    return tags


def cut_from_number(text: str, a: int, b: int) -> bool:
    """Whether a span is a part of a longer run of digits."""
    return (a > 0 and bool(_DIGIT.match(text[a - 1])) and bool(_DIGIT.match(text[a]))
            or b < len(text) and bool(_DIGIT.match(text[b])) and bool(_DIGIT.match(text[b - 1])))


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one tag that no base span touches, that hold what their kind needs, and that are no part of a longer number."""
    if not tags.any():
        return []
    taken = np.zeros(len(tags) + 1, bool)
    for a, _, b in base:
        taken[a:b] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]]).astype(np.int16)))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if tags[a] and not taken[a:b].any():
            own = text[a:b]
            a, b = a + len(own) - len(own.lstrip()), b - len(own) + len(own.rstrip())
            if a < b and not cut_from_number(text, a, b) and plausible(int(tags[a]) - 1, text[a:b]):
                out.append((a, int(tags[a]) - 1, b))
    return out


def judge(part: Slice, tagger: Tagger | None) -> tuple[list[str], list[list], list[list]]:
    """Texts of a slice with their base spans and added spans."""
    texts = [part.text(i).decode("utf-8", "replace") for i in range(len(part))]
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return texts, base, [[] for _ in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sym = symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
    tags = tag_slice(tagger, sym, offsets)
    return texts, base, [added_spans(t, tags[offsets[i]:offsets[i + 1]], base[i]) for i, t in enumerate(texts)]


_FOUND = "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, base_sha256 STRING, spans STRING"


def personal_spans(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, number of base spans by kind, base_sha256 and all spans of every row of docs."""
    tagger = tagger or train(docs)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            _, base, more = judge(part, tagger)
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b in base]),
                 pa.array([spans_text(b + m) for b, m in zip(base, more)])], names=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, _FOUND)


def masked(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; columns as they are."""
    tagger = tagger or train(docs)
    place = docs.columns.index("text")

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, k, b in sorted(spans):
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def scan(batches) -> Iterator[pa.RecordBatch]:
        for rows, part in frames(batches):
            texts, base, more = judge(part, tagger)
            new = pa.array([hide(t, b + m) for t, b, m in zip(texts, base, more)])
            old = rows.column(place)
            columns = rows.columns
            columns[place] = pa.array([n if v else None for n, v in zip(new.to_pylist(), old.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return docs.mapInArrow(scan, docs.schema)
